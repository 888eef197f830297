"""Language identification: a linear-chain CRF labels every word with a language.

Corpus statistics are counted over all training documents by Spark: how often each
word (lexicon), affix and inner letter n-gram occurs per language, hashed into tables
of fixed size. A word's features are its log odds in the three tables; the CRF learns
their weights, a bias per language and the transitions between neighbouring words,
from code-switched sequences spliced from spans of at most ``max_docs`` training
documents, as many of each language. Forward-backward labels the words of whole texts; a
document's language has the largest marginal mass, weighted by word length.

A word is a run of letters of any length; all its n-grams count. The cells of a batch of words
are hashed side by side from their code points.

Defined cases: a text without letters (null, empty, digits, numerals such as a half or a Roman
eight) is ``und`` with score 0; repeated rows are labelled one by one; a null language is
not learned; with no training text everything is ``und``; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.llm import crf

_RUNS = re.compile(r"[^\W\d_]+")
#: Cells of the tables: lexicon, affixes, n-grams. Powers of two.
SIZES = (1 << 16, 1 << 14, 1 << 15)
OFFSETS = (0, SIZES[0], SIZES[0] + SIZES[1])
CELLS = sum(SIZES)
MAX_DOCS = 2000
VOCAB_MEMORY = 400_000      # distinct words a task remembers before it starts afresh
PREFIXES, SUFFIXES, GRAMS = (1, 2, 3), (1, 2, 3, 4), (2, 3)
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. The pattern's classes leave numerals in, which are no letters."""
    if not text:
        return []
    words = _RUNS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for w in words for c in (*w, " ")).split()


def _cell(h: np.ndarray, table: int) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _ODD[4]
    return OFFSETS[table] + (h >> _U(64 - (SIZES[table].bit_length() - 1))).astype(np.int64)


def cells_of(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cells, index of the word) in each of the three tables for non-empty words."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
    end = np.cumsum(n)
    start = end - n
    which = np.arange(len(words))
    owner = np.repeat(which, n)
    place = np.arange(len(c)) - np.repeat(start, n)
    power = np.cumprod(np.full(int(n.max(initial=0)) + 1, _ODD[0]))
    lex = np.add.reduceat(c * power[place], start) + n.astype(_U) if len(words) else c
    affix, at = [], []
    for k, base, step in [*((k, start, 1) for k in PREFIXES), *((k, end - 1, -1) for k in SUFFIXES)]:
        some = which[n >= k]
        h = np.full(len(some), _U(k if step > 0 else 16 + k))
        for j in range(k):
            h = (h + c[base[some] + step * j]) * _ODD[1]
        affix.append(h)
        at.append(some)
    grams, of = [], []
    left = np.repeat(n, n) - place      # letters from here to the word's end
    for k in GRAMS:
        some = np.flatnonzero(left >= k)
        h = np.full(len(some), _U(k))
        for j in range(k):
            h = (h + c[some + j]) * _ODD[2]
        grams.append(h)
        of.append(owner[some])
    return [(_cell(lex, 0), which), (_cell(np.concatenate(affix), 1), np.concatenate(at)), (_cell(np.concatenate(grams), 2), np.concatenate(of))]


def word_cells(word: str) -> tuple[list[int], list[int], list[int]]:
    """Cells of a word in the three tables."""
    return tuple(c.tolist() for c, _ in cells_of([word]))


def count_cells(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, cell, n) over all given documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, words in held.items():
                if not words:
                    continue
                n = np.fromiter(words.values(), float, len(words))
                total = sum(np.bincount(c, n[w], CELLS) for c, w in cells_of(list(words)))
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "cell": at.astype(np.int32), "n": total[at].astype(np.int64)})
            held.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > VOCAB_MEMORY:
                yield from flush()
        yield from flush()

    part = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(
        run, "lang string, cell int, n long")
    return part.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


@dataclass
class WordModel:
    langs: list[str]
    table: np.ndarray                       # (CELLS, languages) log odds
    theta: np.ndarray                       # three feature weights, then a bias per language
    trans: np.ndarray
    start: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "rows": None}

    def features(self, words: list[str]) -> np.ndarray:
        """(words, 3, languages): mean log odds of each table's cells."""
        k = len(self.langs)
        out = np.zeros((len(words), 3, k))
        if not words:
            return out
        for g, (cells, owner) in enumerate(cells_of(words)):
            n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
            for j in range(k):
                out[:, g, j] = np.bincount(owner, self.table[cells, j], len(words)) / n
        return out

    def emission(self, feats: np.ndarray) -> np.ndarray:
        return np.einsum("ngk,g->nk", feats, self.theta[:3]) + self.theta[3:]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Emission scores; those of words met before are remembered."""
        if len(self.cache) > VOCAB_MEMORY:
            self.cache, self.rows = {}, None
        row = np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(row < 0)
        if len(new):
            first = list(dict.fromkeys(words[i] for i in new.tolist()))
            got = self.emission(self.features(first))
            have, need = len(self.cache), len(self.cache) + len(first)
            if self.rows is None or need > len(self.rows):  # grows by doubling
                more = np.empty((2 * need, len(self.langs)))
                if have:
                    more[:have] = self.rows[:have]
                self.rows = more
            self.rows[have:need] = got
            self.cache.update(zip(first, range(have, need)))
            row[new] = [self.cache[words[i]] for i in new.tolist()]
        return self.rows[row]

    def label_words(self, texts: list[list[str]]) -> np.ndarray:
        """Marginals of all words of a batch, end to end."""
        flat = list(chain.from_iterable(texts))
        if not flat:
            return np.zeros((0, len(self.langs)))
        return crf.marginals(self.word_scores(flat), self.trans, self.start, np.array([len(t) for t in texts], int))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) for t in texts]
        lengths = np.array([len(t) for t in split], int)
        if not self.langs or not lengths.sum():
            return ["und"] * len(texts), np.zeros(len(texts))
        doc = np.repeat(np.arange(len(texts)), lengths)
        size = np.fromiter(map(len, chain.from_iterable(split)), float, int(lengths.sum()))
        g = self.label_words(split)
        mass = np.column_stack([np.bincount(doc, g[:, j] * size, len(texts)) for j in range(len(self.langs))])
        best = mass.argmax(axis=1)
        share = np.minimum(1.0, mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1e-300))
        return [self.langs[b] if n else "und" for b, n in zip(best, lengths)], np.where(lengths > 0, share, 0.0)


def spliced(texts: list[tuple[str, list[str]]], langs: list[str], seed: int = 7) -> tuple[list[list[str]], list[int]]:
    """Code-switched training sequences: spans of 4 to 40 words of the texts in random order,
    30 spans a sequence. Returns the sequences and the language of every word."""
    rng = np.random.default_rng(seed)
    spans = []
    for lang, words in texts:
        i = 0
        while i < len(words):
            n = int(rng.integers(4, 41))
            spans.append((langs.index(lang), words[i : i + n]))
            i += n
    order = rng.permutation(len(spans))
    seqs, gold = [], []
    for i in range(0, len(order), 30):
        seqs.append([w for j in order[i : i + 30] for w in spans[j][1]])
        gold += [spans[j][0] for j in order[i : i + 30] for _ in spans[j][1]]
    return seqs, gold


def sample_keys(docs: DataFrame, text_col: str, lang_col: str, max_docs: int) -> DataFrame:
    """(lang, h): the texts with the smallest hashes, as many of each language (the common ones
    have the places that rare ones leave). Only hashes are sorted; a task sends at most
    ``max_docs`` of each language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, h in b.groupby("lang")["h"]:
                held[lang] = np.unique(np.concatenate([held.get(lang, np.zeros(0, np.int64)), h.to_numpy()]))[:max_docs]
        for lang, h in held.items():
            yield pd.DataFrame({"lang": lang, "h": h})

    keys = docs.where(F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    keys = keys.mapInPandas(run, "lang string, h long").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # tasks x max_docs rows at most
    return keys.withColumn("place", place).where(F.col("place") <= max_docs).orderBy("place", "h").limit(max_docs).select("lang", "h")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = 150) -> WordModel:
    """``docs`` are the training documents. Table counts cover all of them; the CRF's weights
    are learned from ``max_docs`` different texts, as many of each language, and of each from
    ``max_words`` words in five spans spread over the whole text."""
    docs = docs.where(F.col(lang_col).isNotNull())
    # at most CELLS rows of one array each
    rows = (count_cells(docs, text_col, lang_col).groupBy("cell")
            .agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m")).collect())
    langs = sorted({x for r in rows for x in r["m"]})
    k = len(langs)
    counts = np.zeros((CELLS, k))
    for r in rows:
        for lang, n in r["m"].items():
            counts[r["cell"], langs.index(lang)] = n
    if not k:
        return WordModel([], counts, np.zeros(3), np.zeros((0, 0)), np.zeros(0))
    table = np.zeros((CELLS, k))
    for g, size in enumerate(SIZES):
        c = counts[OFFSETS[g] : OFFSETS[g] + size]
        share = (c.sum(axis=1, keepdims=True) + 0.1) / (c.sum() + 0.1 * size)  # smoothing towards all languages
        p = (c + 2.0 * size * share / 16) / (c.sum(axis=0) + 2.0 * size / 16)
        table[OFFSETS[g] : OFFSETS[g] + size] = np.log(p / share)
    model = WordModel(langs, table, np.ones(3 + k) * 0.0, np.zeros((k, k)), np.zeros(k))
    keys = F.broadcast(sample_keys(docs, text_col, lang_col, max_docs))  # max_docs rows
    some = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(
        keys, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                w = words_of(text)
                if len(w) > max_words:
                    size = -(-max_words // 5)
                    w = [x for i in range(5) for at in [i * (len(w) - size) // 4] for x in w[at : at + size]]
                yield pd.DataFrame({"lang": [lang], "words": [" ".join(w)]})

    texts = sorted((r["lang"], r["words"]) for r in some.mapInPandas(spans, "lang string, words string").collect())
    seqs, gold = spliced([(a, b.split(" ")) for a, b in texts if b], langs)
    flat = [w for s in seqs for w in s]
    if flat:
        vocab = list(dict.fromkeys(flat))
        at = {w: i for i, w in enumerate(vocab)}
        feats = model.features(vocab)[[at[w] for w in flat]]
        theta0 = np.concatenate([np.full(3, 0.5), np.zeros(k)])
        model.theta, model.trans, model.start = crf.fit(
            lambda th: np.einsum("ngk,g->nk", feats, th[:3]) + th[3:],
            lambda d: np.concatenate([np.einsum("ngk,nk->g", feats, d), d.sum(axis=0)]),
            theta0, k, np.array(gold), np.array([len(s) for s in seqs]), steps=60)
    return model


def predict(docs: DataFrame, model: WordModel, text_col: str = "text", out: str = "lang") -> DataFrame:
    """``docs`` with a struct column (lang, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x languages numbers

    @F.pandas_udf("lang string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            done = [m.predict(list(texts[i : i + 500])) for i in range(0, len(texts), 500)]  # bounds a batch's words
            yield pd.DataFrame({"lang": [x for a, _ in done for x in a], "score": np.concatenate([s for _, s in done] or [np.zeros(0)])})

    return docs.withColumn(out, of(F.col(text_col)))


def label_words(docs: DataFrame, model: WordModel, text_col: str = "text", out: str = "words") -> DataFrame:
    """``docs`` with an array of (word, lang, score): every word with its likeliest language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<word:string,lang:string,score:double>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in parts:
            split = [words_of(t) for t in texts]
            g = m.label_words(split) if m.langs else np.zeros((0, 0))
            got, at = [], 0
            for ws in split:
                p = g[at : at + len(ws)] if m.langs else None
                at += len(ws)
                got.append([{"word": w, "lang": m.langs[int(p[i].argmax())] if m.langs else "und",
                             "score": float(p[i].max()) if m.langs else 0.0} for i, w in enumerate(ws)])
            yield pd.Series(got, dtype=object)

    return docs.withColumn(out, of(F.col(text_col)))
