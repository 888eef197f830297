"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The renders
of successive turn prefixes are compared: if each extends the one before, the new part
is the turn's span; if not, the template rewrites history, and the turn is reported.
Inside a span the text's own place is found by rendering the turn with two probe texts:
what both probes share before and after is the template's.

The built-in template marks turns and escapes control strings in texts by one more
backslash after their first character, so unescaping takes one away again.

Turns of a conversation reach one task in order (``repartition`` and sort), as rows
that are streamed: a task holds one conversation at a time, which is also one output
row. Rendering all prefixes is quadratic in the turns of that one conversation.

Defined cases: null text or role is empty; turns are ordered by turn, role, text (nulls
first), repeated rows are turns of their own; a null conv_id is a conversation; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: The control strings of the built-in template.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|ROLE |/ROLE\])")
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", " </s>")}


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"[ROLE {quote(role, safe='')}] ", " [/ROLE]")


def inst_template(turns: list[Turn]) -> str:
    out = ["<s>"]
    for role, text in turns:
        head, tail = marks(role)
        out += (head, escape(text), tail)
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text of ``inst_template``."""
    at, turns = len("<s>"), []
    while at < len(formatted):
        if m := re.compile(r"\[ROLE ([^\]]*)\] ").match(formatted, at):
            role, head, tail = unquote(m[1]), m[0], " [/ROLE]"
        else:
            role = next(r for r, (h, _) in MARKS.items() if formatted.startswith(h, at))
            head, tail = MARKS[role]
        start = at + len(head)
        end = formatted.index(tail, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(tail)
    return turns


def shared(a: str, b: str, end: bool = False) -> int:
    """Length of the common prefix (with ``end``: suffix), by halving: slices compare at once."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        same = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if end else a[low:mid] == b[low:mid]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def locate(render: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """(rendered text, spans, rewrites): (start, end, text start, text end) of every turn, and
    the turns whose rendering changed what stood before. A span after a rewrite is what the
    render added past the part that both share."""
    before, spans, rewrites = render([]), [], []
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1])
        if now.startswith(before):
            start = len(before)
        else:
            rewrites.append(k)
            start = shared(before, now)
        one, two = (render([*turns[:k], (role, p)]) for p in ("a", "z"))
        head = shared(one, two)
        tail = min(shared(one, two, end=True), len(one) - head)
        spans.append((start, len(now), head, max(head, len(now) - tail)))
        before = now
    return before, spans, rewrites


SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", render: Template = inst_template, loss_roles=("assistant",)) -> DataFrame:
    """One row per conversation: id, formatted, spans (with the loss mask), rewrites."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(conv, rows: list[Turn]) -> dict:
            text, spans, rewrites = locate(render, rows)
            return {"id": conv, "formatted": text, "rewrites": rewrites, "spans": [
                {"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "loss": r in loss_roles}
                for (r, _), (a, b, c, d) in zip(rows, spans)]}

        current, rows, out, size = None, [], [], 0
        for batch in batches:
            for conv, role, text in zip(batch["id"], batch["role"], batch["text"]):
                if conv != current and rows:
                    out.append(done(current, rows))
                    size += len(out[-1]["formatted"])
                    rows = []
                    if size > 1_000_000:
                        yield pd.DataFrame(out)
                        out, size = [], 0
                current = conv
                rows.append((role or "", text or ""))
        if rows:
            out.append(done(current, rows))
        if out:
            yield pd.DataFrame(out)

    # ids travel as text: pandas would turn integers beside nulls into floats
    d = turns.select(F.col(id_col).cast("string").alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                     F.col(text_col).alias("text"))
    d = d.repartition("id").sortWithinPartitions("id", "turn", "role", "text").drop("turn")
    d = d.mapInPandas(run, f"id string, formatted string, rewrites array<int>, spans {SPANS}")
    return d.withColumn("id", F.col("id").cast(turns.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from the output of ``format_conversations``: the turns by parsing
    the text, the loss text by the spans."""
    def of(text: str, spans) -> dict:
        turns = parse(text)
        loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        return {"n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(),
                "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(),
                "formatted_chars": len(text)}

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read_back(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(t, s) for t, s in zip(text, spans)],
                            columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("d", read_back("formatted", "spans")).select(id_col, "d.*", F.size("rewrites").alias("n_rewrites"))
