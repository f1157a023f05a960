"""Chat formatting with a template that is only called, never read.

Successive prefixes of a conversation are rendered and consecutive outputs compared: what a prefix
adds is its last turn's span. A turn's text is located in its span by rendering it with two other
texts; the common beginning and end of those outputs frame the text. A template whose output for a
prefix isn't a beginning of its output for the next one rewrites history, and is reported.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of

Template = Callable[[list[tuple[str, str]]], str]
START, END = "<|im_start|>", "<|im_end|>"
_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64())), ("turn_ends", pa.list_(pa.int64())), ("rewrites_history", pa.bool_())])
_OUT_SQL = "conv_id long, n_turns long, formatted string, loss_spans array<long>, turn_ends array<long>, rewrites_history boolean"


def escaped(text: str, more: str = "") -> str:
    """Text in which no control string can occur: `\\` becomes `\\\\` and `<|` becomes `<\\|`; for `more`, newlines become `\\n`."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if more else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def chatml(turns: list[tuple[str, str]]) -> str:
    """Marks each turn: start mark, role, newline, text, end mark, newline; roles and texts are escaped."""
    return "".join(f"{START}{escaped(role, 'role')}\n{escaped(text)}{END}\n" for role, text in turns)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of chatml output."""
    turns = []
    for part in formatted.split(f"{END}\n"):
        if part:
            role, _, text = part.removeprefix(START).partition("\n")
            turns.append((unescaped(role), unescaped(text)))
    return turns


def located(template: Template, turns: list[tuple[str, str]]) -> tuple[str, list[int], list[tuple[int, int]], bool]:
    """Output, end of each turn's span, span of each turn's text, and whether the template rewrites history.

    Every prefix is rendered whole, as a template may look at any earlier turn; work grows with the
    square of a conversation's length.
    """
    done, ends, spans = "", [], []
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        if not now.startswith(done):
            return template(turns), [], [], True
        one, two = (template([*turns[:i], (role, x)])[len(done) :] for x in ("X", "YY"))
        head = len(os.path.commonprefix([one, two]))
        tail = len(one) - head - 1
        ends.append(len(now))
        spans.append((len(done) + head, len(now) - tail))
        done = now
    return done, ends, spans, False


def _render(template: Template, roles: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                turns = [(t["role"] or "", t["text"] or "") for t in turns]
                text, ends, spans, rewrites = located(template, turns)
                loss = [x for (role, _), span in zip(turns, spans) if role in roles for x in span]
                rows.append((conv_id, len(turns), text, loss, ends, rewrites))
            yield batch_of(_OUT, *(zip(*rows, strict=True) if rows else [[]] * 6))

    return run


def format_conversations(conversations: DataFrame, template: Template = chatml, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conv_id: conv_id, n_turns, formatted, loss_spans, turn_ends, rewrites_history.

    conversations has conv_id long, turn, role and text, a row for each turn; rows are ordered by
    turn, ties by role and text, and repeated rows are turns of their own. Null roles and texts are
    empty; null conv_ids form one conversation; other columns are ignored; an empty table gives no
    rows. loss_spans lists start and end (code points) of the texts of loss_roles; where the template
    rewrites history it and turn_ends are empty, since no span can be trusted. A conversation is one
    training example and so one row, however long.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return one.mapInArrow(_render(template, frozenset(loss_roles)), _OUT_SQL)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            turns = parsed(text)
            loss = "".join(unescaped(text[a:b]) for a, b in zip(spans[::2], spans[1::2]))
            every = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((conv_id, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        yield batch_of(_DIGEST, *(zip(*rows, strict=True) if rows else [[]] * 6))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the chatml output says: turns, and the text under the loss mask."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
