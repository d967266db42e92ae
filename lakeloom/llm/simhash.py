"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when ``MAX_BITS`` (4) or fewer bits differ. They are cut into three parts of 21, 21 and 22 bits; two linked
fingerprints differ in at most one bit of some part. Each part has a covering code: the perfect Hamming code over its
first 15 bits, of covering radius 1, and all words over the rest. Its words are the anchors. A fingerprint lies
at home at the one anchor within the radius, and a copy goes to every anchor within the radius plus one bit (14 anchors a
part at most). So of two linked fingerprints one's copy meets the other at its home, and each anchor compares home with copies, over all 64 bits.

Only distinct fingerprints take part. An anchor with more than ``CELL`` fingerprints is cut into chunks of home and of copies
that meet pairwise in cells, so no task gathers an unbounded group. A task gives a spanning forest of the links it finds, not
all pairs, and the forests are joined by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import checkpointed, slices
from lakeloom.llm.components import connected_components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: (lowest bit, number of bits) of the parts; four differing bits leave at most one to some part.
PARTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
CELL = 4096
BLOCK = 1 << 20


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: lower-cased (A-Z), words between ASCII white space, shingles of four words with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for start in range(0, n, BLOCK):  # long texts in blocks
        part = words[start : start + BLOCK + SHINGLE - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(SHINGLE)))]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def add_fingerprint(df: DataFrame, text: str = "text", column: str = "simhash") -> DataFrame:
    """Adds ``column``, the fingerprint as a signed 64-bit number; a column of that name is replaced. Null and wordless texts: 0."""
    others = [f for f in df.schema.fields if f.name.lower() != column.lower()]
    names = [f.name for f in others]
    schema = T.StructType([*others, T.StructField(column, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = np.array([fingerprint(x) for x in part.column(names.index(text)).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(found)], schema.names)

    return df.select(*[df[f"`{x}`"] for x in names]).mapInArrow(run, schema)


def syndrome(words: np.ndarray) -> np.ndarray:
    """Which bit (1 to 15) of a word differs from the nearest word of the Hamming code; 0: none."""
    out = np.zeros(len(words), np.int64)
    for i in range(CODE_BITS):
        out ^= np.where(words >> i & 1, i + 1, 0)
    return out


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of fingerprints (uint64): row, key (part and anchor), and whether the anchor is the row's home."""
    rows, keys, home = [], [], []
    index = np.arange(len(fingerprints))

    def add(part: int, row: np.ndarray, anchor: np.ndarray, at_home: bool) -> None:
        rows.append(row)
        keys.append(anchor.astype(np.int64) | part << 32)
        home.append(np.full(len(row), at_home))

    for part, (low, width) in enumerate(PARTS):
        value = (fingerprints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        code, rest = value & ((1 << CODE_BITS) - 1), value >> CODE_BITS
        s = syndrome(code)
        nearest = np.where(s > 0, code ^ (1 << np.maximum(s - 1, 0)), code)
        add(part, index, nearest | rest << CODE_BITS, True)
        for i in range(width - CODE_BITS):  # the bit that differs is among those coded by themselves
            add(part, index, nearest | (rest ^ 1 << i) << CODE_BITS, False)
        for i in range(CODE_BITS):  # or among the 15: the nearest code words of all neighbours
            t = s ^ (i + 1)
            other = code ^ 1 << i
            other = np.where(t > 0, other ^ (1 << np.maximum(t - 1, 0)), other)
            new = (other != nearest) & (i < (t - 1)) | (other != nearest) & (t == 0)  # each of them once
            add(part, index[new], (other | rest << CODE_BITS)[new], False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of stars with the same components as the links a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def links_within(keys: np.ndarray, fingerprints: np.ndarray, home: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of home fingerprints with copies (and other home fingerprints) of the same key; rows are sorted by key."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    group = np.repeat(np.arange(len(start)), size)
    at_home = np.flatnonzero(home)
    many = size[group[at_home]]
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    done = np.cumsum(many)
    at = 0
    while at < len(at_home):  # about a million comparisons at once
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BLOCK)))
        mine, n = at_home[at:stop], many[at:stop]
        left = np.repeat(mine, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[mine]], n)
        near = np.bitwise_count(fingerprints[left] ^ fingerprints[right]) <= max_bits
        near &= left != right
        if near.any():
            a, b = forest(fingerprints[left[near]], fingerprints[right[near]])
            found_a.append(a)
            found_b.append(b)
        at = stop
    return np.concatenate(found_a), np.concatenate(found_b)


def links(distinct: DataFrame, column: str = "simhash", cell: int = CELL) -> DataFrame:
    """(a, b) pairs of linked fingerprints whose components are those of all links; ``distinct`` has each fingerprint once."""
    placed_schema = "anchor long, fp long, home boolean"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                row, key, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    placed = distinct.select(column).mapInArrow(place, placed_schema)
    crowded = checkpointed(placed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("anchor", F.ceil(F.col("n") / cell).cast("int").alias("chunks")))
    if crowded.isEmpty():
        cells = placed.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    else:
        # Chunks of a crowded anchor: a fingerprint at home goes to one row of cells as home and to one column as a copy.
        split = placed.join(crowded, "anchor", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        cells = split.where("home").select("anchor", F.col("own").alias("i"), every.alias("j"), "fp", F.lit(True).alias("home")).unionByName(split.where("chunks > 1 or not home").select("anchor", every.alias("i"), F.col("own").alias("j"), "fp", F.lit(False).alias("home")))
    dealt = cells.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").select("anchor", "i", "j", "fp", "home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_within(*rows)
            if len(a):
                a, b = forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            anchor, i, j, fp, home = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(5))
            key = anchor << 24 ^ i.astype(np.int64) << 12 ^ j.astype(np.int64)  # rows are sorted; neighbours of other cells have other keys
            rows = [np.concatenate(x) for x in zip(kept, (key, fp.view(np.uint64), home))]
            if not len(rows[0]):
                continue
            last = int(np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])[-1])
            if last:
                yield out([x[:last] for x in rows])
            kept = [x[last:] for x in rows]
        if len(kept[0]):
            yield out(kept)

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the least key that links reach.

    Null keys do not count for the least; a component of null keys alone has a null id. Repeated rows stay. No rows: no rows.
    """
    prints = checkpointed(add_fingerprint(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("x")), "x", "fp").select("id", "fp"))
    least = prints.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(links(least.select("fp"), "fp"), "a", "b")
    joined = least.join(roots, least["fp"] == roots["node"], "left").select(least["fp"], "low", F.coalesce("root", least["fp"]).alias("root"))
    lowest = checkpointed(joined.groupBy("root").agg(F.min("low").alias("component_id")))  # so the join below can split a large component
    named = joined.join(lowest, "root").select("fp", "component_id")
    found = prints.join(named, "fp")
    return found.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
