"""Chat formatting by columnar byte assembly.

A batch's headers and contents are copied into one preallocated buffer at offsets that numpy computes from the
segment lengths; that buffer is the data buffer of the Arrow column of formatted strings.

The template of one turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside texts and roles a control string (of this template or of other
common ones, see ``CONTROL``) gets a backslash after its first character, and a backslash that stands there already
gets one more; reading takes one away. Roles also have backslashes and line feeds escaped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LEARNED_ROLE = "assistant"

#: Control strings begin with < or [ and go on as one of these.
CONTROL = r"(?:\||/?s>|</?SYS>>|/?INST\])"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={CONTROL})")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def escaped(column: pa.Array, fix) -> pa.Array:
    """``fix`` applied to the values that may need it; nulls become empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    risky = pc.match_substring_regex(column, rf"[<\[]\\*{CONTROL}" + (r"|[\n\\]" if fix is escape_role else ""))
    if not pc.any(risky).as_py():
        return column
    return pc.replace_with_mask(column, risky, pa.array([fix(x) for x in column.filter(risky).to_pylist()], pa.large_string()))


def _bytes_and_lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a large_string array as bytes, and each value's length."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)


def scatter(out: np.ndarray, data: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> None:
    """Copy consecutive pieces of ``data``, of the given lengths, to ``starts`` in ``out``."""
    shift = starts - (np.cumsum(lengths) - lengths)
    out[np.arange(len(data)) + np.repeat(shift, lengths)] = data


def assemble(roles: pa.Array, texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted strings of consecutive groups of turns, and where each turn's text starts and ends in its string, in bytes."""
    role_data, role_len = _bytes_and_lengths(roles)
    text_data, text_len = _bytes_and_lengths(texts)
    role_at = len(OPEN)
    text_at = role_at + role_len + len(MIDDLE)
    total = text_at + text_len + len(CLOSE)
    begin = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.uint8)
    for mark, at in ((OPEN, begin), (MIDDLE, begin + role_at + role_len), (CLOSE, begin + text_at + text_len)):
        out[(at[:, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), len(at))
    scatter(out, role_data, role_len, begin + role_at)
    scatter(out, text_data, text_len, begin + text_at)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    offsets = np.r_[begin[first], len(out)].astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    base = np.repeat(begin[first], np.diff(np.r_[first, len(group)]))
    return strings, begin + text_at - base, begin + text_at + text_len - base


FORMATTED = [T.StructField("formatted", T.StringType(), False), T.StructField("loss_starts", T.ArrayType(T.LongType(), False), False), T.StructField("loss_ends", T.ArrayType(T.LongType(), False), False)]


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED_ROLE) -> DataFrame:
    """One row for each conversation: its key, ``formatted`` and the loss mask as code point spans ``loss_starts``, ``loss_ends``.

    Turns stand by ``turn``, nulls first, then by role and text, so repeated rows stay and have a fixed order. Null text or role
    counts as empty; rows with a null key form one conversation. Rows are dealt out by conversation and sorted; a task holds one Arrow batch
    and one conversation at a time.
    """
    key = df.schema[conv]
    schema = T.StructType([key, *FORMATTED])
    rows = df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), F.col(f"`{role}`").cast("string").alias("r"), F.col(f"`{text}`").cast("string").alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def made(table: pa.Table) -> pa.RecordBatch:
        keys = table.column(0).combine_chunks()
        group = _runs(keys)
        roles, texts = (table.column(i).combine_chunks() for i in (1, 2))
        shown = escaped(texts, escape)
        strings, start, end = assemble(escaped(roles, escape_role), shown, group)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        is_learned = np.asarray(pc.fill_null(pc.equal(roles, learned), False))
        starts, ends = [], []
        for i, (a, b) in enumerate(zip(first, np.r_[first[1:], len(group)])):
            mine = np.flatnonzero(is_learned[a:b]) + a
            data = np.frombuffer(strings[i].as_buffer(), np.uint8)
            points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
            starts.append(points[start[mine]])
            ends.append(points[end[mine]])
        spans = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(first)), strings.cast(pa.string()), *spans], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            group = _runs(table.column(0).combine_chunks())
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield made(table.slice(0, last).combine_chunks())
            kept = table.slice(last)
        if kept is not None and kept.num_rows:
            yield made(kept.combine_chunks())

    return rows.mapInArrow(run, schema)


def _runs(keys: pa.Array) -> np.ndarray:
    """A number for each run of equal keys; nulls are equal to each other."""
    codes = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
    return np.r_[0, np.cumsum(codes[1:] != codes[:-1])]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what can be read from the rows of ``format_chat``: the turns, and the text under the loss mask."""
    fields = (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))
    schema = T.StructType([df.schema[conv], *[T.StructField(n, t, False) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                turns = parse(formatted)
                whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                for a, b in zip(starts, ends):
                    text = unescape(formatted[a:b])
                    chars += len(text)
                    loss.update(text.encode())
                rows.append((len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(formatted)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), k) for v, k in zip(columns, kinds))], schema.names)

    return df.select(conv, "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)
