"""Public tokenizer files as (ids of a text, bytes of an id), loaded once per Python worker."""

from __future__ import annotations

import functools
import os
import re
from dataclasses import dataclass

import numpy as np

#: Fixed value: the published splitting pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond Latin letters, the character classes of two pattern engines may be of different Unicode versions.
_BEYOND = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where
    it is printable Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(0x100 + i)] = b
    return out


@dataclass(frozen=True)
class ByteBpe:
    """A byte-level BPE file of the ``tokenizers`` library. Special tokens' strings are plain text.
    Texts of Latin letters go through ``tiktoken`` with the ranks of the same file, if its merges
    are in the order of their ids, which gives the same ids in less time."""

    path: str

    @property
    def bytes(self) -> list[bytes]:
        return _byte_bpe(self.path)[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        _, slow, fast = _byte_bpe(self.path)
        if fast is None:
            return [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
        return [slow.encode(t, add_special_tokens=False).ids if _BEYOND.search(t) else fast.encode_ordinary(t) for t in texts]


    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The same ids as arrays."""
        _, slow, fast = _byte_bpe(self.path)
        if fast is None:
            return [np.array(x, np.uint32) for x in self.encode(texts)]
        return [np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32) if _BEYOND.search(t)
                else fast.encode_to_numpy(t, disallowed_special=()) for t in texts]


@functools.lru_cache(maxsize=4)
def _byte_bpe(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tok = Tokenizer.from_str(json.dumps(spec))
    tok.encode_special_tokens = True
    alphabet = byte_alphabet()
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    table = [b""] * (max([*spec["model"]["vocab"].values(), *special]) + 1)
    for piece, i in spec["model"]["vocab"].items():
        table[i] = special.get(i) or bytes(alphabet[c] for c in piece)
    for i, b in special.items():
        table[i] = b
    pre = spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"][a + b] for a, b in merges]
    plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not spec.get("normalizer") and made == sorted(made) and not spec["model"].get("ignore_merges"))
    ranks = {b: i for i, b in enumerate(table) if i not in special}
    fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if plain else None
    return table, tok, fast


@dataclass(frozen=True)
class Pieces:
    """A ``sentencepiece`` model with byte fallback."""

    path: str

    @property
    def bytes(self) -> list[bytes]:
        return _pieces(self.path)[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return _pieces(self.path)[1].encode(texts, num_threads=1)

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.encode(texts)]


@functools.lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        table.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
    return table, sp
