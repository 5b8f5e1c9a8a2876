"""Conversations as token streams with a loss mask, and back.

A turn is a reserved id for its start, one for its role, the tokens of its text, and a
reserved id for its end; roles without an id of their own are spelled out. Segments
are encoded separately, so no token spans two of them, and no text can produce a
reserved id. The mask is the prefix sum of +1 where a learned text starts and -1 where
it ends. In the stream's text form control strings inside contents are escaped:
backslashes are doubled and a backslash follows the first character of each control
string, which dropping each backslash's effect undoes.

A conversation is never one value: its turns are rows in order, each with its place in
the stream, taken from running sums. A task streams sorted rows, whatever a
conversation's length.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its
own; turns with the same number are ordered by role and text; repeated rows are
repeated turns; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import shared

OPEN, TEXT, CLOSE, OTHER = "<turn>", "<text>", "</turn>", "### Role:"
ROLES = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
CONTROL = (OPEN, TEXT, CLOSE, OTHER, *ROLES.values())
LEARNED = ("assistant",)
SCHEMA = (
    "conv_id long, seq long, turn long, token_start long, char_start long, n_chars long, ids array<int>, loss array<tinyint>"
)

_ANY = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ANY.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """(string, is control, is learned) of a turn, in order; contents are escaped."""
    head = [(ROLES[role], True, False)] if role in ROLES else [(OTHER, True, False), (escape(role), False, False), (TEXT, True, False)]
    return [(OPEN, True, False), *head, (escape(text), False, role in LEARNED), (CLOSE, True, False)]


def assemble(role: str, text: str, encode, reserved: dict[str, int]) -> tuple[list[int], np.ndarray, int]:
    """Ids, loss mask and number of characters of one turn."""
    ids: list[int] = []
    chars, marks = 0, []
    for string, control, learned in segments(role, text):
        if learned:
            marks.append((len(ids), 1))
        ids += [reserved[string]] if control else encode(string)
        if learned:
            marks.append((len(ids), -1))
        chars += len(string)
    steps = np.zeros(len(ids) + 1, np.int8)
    for at, step in marks:
        steps[at] += step
    return ids, np.cumsum(steps[:-1], dtype=np.int8), chars


def format_conversations(turns: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row per turn: conv_id, its number ``seq``, place in the stream in tokens and characters, ids, mask.

    The turns of a conversation are adjacent and in order within a partition.
    """
    known = bpe.default_vocabulary()
    path, pattern = path or known[0], pattern or known[1]
    vocabulary = shared(turns.sparkSession, bpe.read_vocabulary(path))

    def run(batches):
        enc = bpe.encoder(vocabulary(), pattern)
        reserved = {s: enc.max_token_value + 1 + i for i, s in enumerate(CONTROL)}
        conv, seq, tokens, chars = object(), 0, 0, 0
        for batch in batches:
            rows = []
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != conv:
                    conv, seq, tokens, chars = c, 0, 0, 0
                ids, loss, n = assemble(role, text, enc.encode_ordinary, reserved)
                rows.append((c, seq, turn, tokens, chars, n, ids, loss))
                seq, tokens, chars = seq + 1, tokens + len(ids), chars + n
                if len(rows) == 512:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def _batch(rows):
    kinds = [*[pa.int64()] * 6, pa.list_(pa.int32()), pa.list_(pa.int8())]
    names = [x.strip().split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def parse(ids: list[int], loss: list[int], decode, reserved: dict[int, str]) -> tuple[str, str, str]:
    """Role, text and learned text of a turn's tokens."""
    parts: list[tuple[str | None, list[int], list[int]]] = []
    for i, m in zip(ids, loss):
        if i in reserved:
            parts.append((reserved[i], [], []))
        else:
            parts[-1][1].append(i)
            if m:
                parts[-1][2].append(i)
    by_marker = {v: k for k, v in ROLES.items()}
    read = lambda tokens: unescape(decode(tokens).decode())
    role = next((by_marker[name] for name, _, _ in parts if name in by_marker), None)
    if role is None:
        role = read(next(own for name, own, _ in parts if name == OTHER))
    content = next((own, learned) for name, own, learned in parts if name == TEXT or name in by_marker)
    return role, read(content[0]), read(content[1])


def read_turns(formatted: DataFrame, fold, schema: str, path: str | None = None) -> DataFrame:
    """Streams (conv_id, seq, turn, n_chars, role, text, learned text) of parsed turns to ``fold`` and yields its rows.

    ``fold`` is called once per task and gives an object with ``add(row)`` and ``end()``;
    both return finished rows. Order and neighbourhood are those of ``formatted``.
    """
    vocabulary = shared(formatted.sparkSession, bpe.read_vocabulary(path or bpe.default_vocabulary()[0]))

    def run(batches):
        enc = bpe.encoder(vocabulary(), r"[\s\S]")
        reserved = {enc.max_token_value + 1 + i: s for i, s in enumerate(CONTROL)}
        state = fold()

        def out(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, state.kinds)], names=state.names)

        for batch in batches:
            rows = []
            for conv, seq, turn, n, ids, loss in zip(*(batch.column(i).to_pylist() for i in range(6))):
                rows += state.add((conv, seq, turn, n, *parse(ids, loss, enc.decode_bytes, reserved)))
            if rows:
                yield out(rows)
        if rows := state.end():
            yield out(rows)

    return formatted.select("conv_id", "seq", "turn", "n_chars", "ids", "loss").mapInArrow(run, schema)
