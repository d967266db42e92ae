"""Exact substring dedup with suffix arrays built by induced sorting.

Every byte that lies in a ``LENGTH``-byte (200) string which also starts anywhere else goes. Suffix arrays are built over shards that gather
what can match, not over arbitrary cuts of the corpus:

1. In each text, the least hash of the ``GRAM``-byte windows within a 200-byte string is its anchor, so equal strings have equal anchors at
   equal offsets. An anchor's context are the bytes of the strings with this anchor. Of equal texts one takes part; the rest follows it.
2. Anchors are dealt out by hash. A hash that occurs once ends here. Equal contexts are duplicates throughout; different contexts under
   one hash go, one of each, into the shard of that hash.
3. A shard's contexts are joined to one string and sorted: suffixes are classified, leftmost smaller (LMS) substrings are sorted by induction
   and named, their order is resolved (by prefix doubling of the names in place of deeper recursion) and all suffixes are induced from it. Induction runs bucket by bucket in
   waves, each one a numpy operation, which is linear in the shard. Common prefixes of neighbours are kept by text position,
   and starts whose common prefix reaches 200 with a string at another place are duplicates.
4. An anchor with more than ``GROUP`` different contexts would outgrow a shard. A repeated string holds a number of bytes, from 0 to ``REACH``, before
   its anchor. These numbers are cut into ranges (``PARTS``); strings of a range all hold the bytes from the range's least number before the anchor to what the
   greatest leaves behind it. Contexts are cut to the strings of the range; those with these bytes in common make up a smaller group. Equal ones are again
   duplicates throughout, and one of each goes into a shard; groups that are still too large are cut further, at last into single numbers, where the strings themselves are equal. No pair is lost on the way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import Scratch, checkpointed, slices

LENGTH, GRAM = 200, 48
REACH = LENGTH - GRAM
GROUP = 8192
#: In so many ranges those of a too large group are cut, step by step; after the last step each is one number.
PARTS = (2, 4, 20)
SHARD_BYTES = 1 << 20
#: Up to so many hashes are broadcast.
BROADCAST_ROWS = 1_000_000
BLOCK = 1 << 20
#: Common prefixes are measured in steps of so many bytes, which are compared by 64-bit hashes.
WINDOW = 40

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK + LENGTH + 1), _powers(_INVERSE, BLOCK + LENGTH + 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed rolling hash of every ``GRAM``-byte window."""
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)])]
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over every window of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text of at least ``LENGTH`` bytes, and the first and last starts of the strings that each is the anchor of; in blocks."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    back = np.arange(REACH + 1) - REACH
    for start in range(0, len(data) - LENGTH + 1, BLOCK):
        h = gram_hashes(data[start : start + BLOCK + LENGTH - 1])
        low = _sliding(h, REACH + 1, np.minimum)
        edge = np.zeros(REACH, np.uint64)
        padded = np.r_[edge, low, edge]
        chosen = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == h)
        # The strings that hold an anchor and nothing less start in one run.
        own = sliding_window_view(padded, REACH + 1)[chosen] == h[chosen, None]
        own &= (chosen[:, None] + back >= 0) & (chosen[:, None] + back < len(low))
        first, last = own.argmax(axis=1) - REACH, -own[:, ::-1].argmax(axis=1)
        for column, values in zip(found, (chosen, h[chosen], chosen + first, chosen + last)):
            column.append(values if values.dtype == np.uint64 else values + start)
    at, h, first, last = map(np.concatenate, found)
    # An anchor near the end of a block is one of the next block too.
    order = np.argsort(at, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    return at[order][new], h[order][new], np.minimum.reduceat(first[order], new), np.maximum.reduceat(last[order], new)


# --- suffix arrays ---


def _classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S (less than the next one); the last symbol is a sentinel, of type S."""
    n = len(s)
    differs = np.r_[s[:-1] != s[1:], True]
    where = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n - 1))
    where = np.minimum.accumulate(where[::-1])[::-1]
    less = np.r_[s[:-1] < s[1:], True]
    return less[where]


def _deal(at: np.ndarray, s: np.ndarray, buckets: list[list[np.ndarray]], own: int) -> np.ndarray:
    """Append suffixes to the buckets of their first symbols, in order; those of bucket ``own`` are also returned."""
    if not len(at):
        return at
    symbols = s[at]
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    mine = at[:0]
    for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(at)].tolist()):
        symbol = int(symbols[a])
        buckets[symbol].append(at[a:b])
        if symbol == own:
            mine = at[a:b]
    return mine


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in the order that the LMS suffixes, in the given order within buckets, induce."""
    larger: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    given: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    _deal(lms, s, given, -1)
    for c in range(alphabet):  # L-type suffixes, from the left
        wave = np.concatenate(larger[c]) if larger[c] else lms[:0]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = _deal(before[~is_s[before]], s, larger, c)
        for part in given[c]:
            before = part[part > 0] - 1
            _deal(before[~is_s[before]], s, larger, c)
    for c in range(alphabet - 1, -1, -1):  # S-type suffixes, from the right
        wave = np.concatenate(smaller[c]) if smaller[c] else lms[:0]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = _deal(before[is_s[before]], s, smaller, c)
        if larger[c]:
            part = np.concatenate(larger[c])[::-1]
            before = part[part > 0] - 1
            _deal(before[is_s[before]], s, smaller, c)
    smaller[int(s[-1])].append(np.array([len(s) - 1], lms.dtype))  # the sentinel, which nothing induces
    out = []
    for c in range(alphabet):
        out += larger[c]
        if smaller[c]:
            out.append(np.concatenate(smaller[c])[::-1])
    return np.concatenate(out)


def _by_doubling(order: np.ndarray, is_new: np.ndarray, depth: int | None) -> np.ndarray:
    """The suffix order of a string of names, given the order by first names and where a name differs from the one before.

    Only groups that are still tied are sorted again, by what follows at the doubled distance. Suffixes that agree in ``depth`` names
    may stay tied: an LMS substring has two symbols at least, so they agree in more than ``depth`` symbols.
    """
    n, width = len(order), 1
    order = order.copy()
    start = np.maximum.accumulate(np.where(is_new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = np.flatnonzero(~(is_new & np.r_[is_new[1:], True]))
    while len(tied) and (depth is None or width <= depth):
        items = order[tied]
        after = items + width
        key = rank[items] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        items, key = items[by_key], key[by_key]
        order[tied] = items
        new = np.r_[True, key[1:] != key[:-1]]
        rank[items] = tied[np.maximum.accumulate(np.where(new, np.arange(len(items)), 0))]
        tied = tied[~(new & np.r_[new[1:], True])]
        width *= 2
    return order


def suffix_array(s: np.ndarray, alphabet: int, depth: int | None = None) -> np.ndarray:
    """The sorted suffixes of a string of small numbers whose last symbol is less than all others; with ``depth`` by so many symbols at least."""
    is_s = _classify(s)
    lms = np.flatnonzero(is_s & ~np.r_[True, is_s[:-1]]).astype(np.int32)  # a shard is far below 2 GB
    if not len(lms):
        return np.lexsort((-np.arange(len(s)), s)) if len(s) < 2 else _induce(s, is_s, lms, alphabet)
    rough = _induce(s, is_s, lms, alphabet)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # Names: equal LMS substrings have equal lengths and equal symbols, compared step by step where the lengths agree.
    number = np.empty(len(s), np.int32)
    number[lms] = np.arange(len(lms))
    ends = np.r_[lms[1:], len(s) - 1]
    a, b = ordered[:-1], ordered[1:]
    length = ends[number[ordered]] - ordered
    same = length[:-1] == length[1:]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        equal = s[a[live] + step] == s[b[live] + step]
        same[live[~equal]] = False
        live = live[equal]
        live = live[length[live] > step]
        step += 1
    exact = lms[_by_doubling(number[ordered], np.r_[True, ~same], depth)] if same.any() else ordered
    return _induce(s, is_s, exact, alphabet)


def block_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``WINDOW`` bytes: eight of them are read as a number, and the numbers are mixed."""
    eight = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        eight |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(len(data) - WINDOW + 1, np.uint64)
    for i in range(0, WINDOW, 8):
        out ^= eight[i : i + len(out)]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def repeated_starts(contexts: list[bytes], place: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each context the offsets of its ``LENGTH``-byte strings that also start at another place.

    ``place`` numbers the texts that contexts are from and ``first`` has their first bytes there: overlapping contexts of a text hold
    the same string at the same place twice, which does not count.
    """
    if not contexts:
        return []
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"\0".join(contexts) + bytes(LENGTH), np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    n = int(begin[-1] + lengths[-1]) + 1
    s = data[:n].astype(np.int16) + 2
    s[begin + lengths] = 1  # between contexts
    s[-1] = 0
    used = np.flatnonzero(np.bincount(s, minlength=258))
    lookup = np.zeros(258, np.int16)
    lookup[used] = np.arange(len(used))
    order = suffix_array(lookup[s], len(used), LENGTH)
    context = np.repeat(np.arange(len(contexts), dtype=np.int32), lengths + 1)
    offset = np.arange(n, dtype=np.int32) - begin.astype(np.int32)[context]
    starts = offset <= lengths[context] - LENGTH
    order = order[starts[order]]
    if len(order) < 2:
        return [np.zeros(0, np.int64) for _ in contexts]
    window = block_hashes(data)
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    permuted = np.zeros(n, np.int16)  # at each start: the common prefix with its predecessor, in whole steps up to LENGTH
    for step in range(0, LENGTH, WINDOW):
        live = live[window[a[live] + step] == window[b[live] + step]]
        permuted[b[live]] = step + WINDOW
    group = np.flatnonzero(np.r_[True, permuted[b] < LENGTH])
    where = (place[context[order]].astype(np.int64) << 40) + first[context[order]] + offset[order]
    several = np.minimum.reduceat(where, group) != np.maximum.reduceat(where, group)
    hit = np.zeros(n, bool)
    hit[order[np.repeat(several, np.diff(np.r_[group, len(order)]))]] = True
    at = np.flatnonzero(hit)
    return [x - begin[i] for i, x in enumerate(np.split(at, np.searchsorted(at, begin[1:])))]


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings at the sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + LENGTH).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# --- distributed steps ---


def _runs(first: np.ndarray, end: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ones of runs of equal contexts that touch, and where the last ones end: periodic text gives a row for each period, not for each place."""
    order = np.lexsort((first, f))
    a, b, g = first[order], end[order], f[order]
    new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (a[1:] > b[:-1])])
    return order[new], b[np.r_[new[1:], len(a)] - 1]


_PLACES = "h long, f long, rk long, digest long, p int, a int, b int, z int"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (h at p), their contexts (hash f, bytes a to b) and where the last of a run of equal contexts ends (z)."""
    for batch in batches:
        for part in slices(batch, "x", 4 << 20):
            columns: list[list] = [[] for _ in range(8)]
            for x, rk, digest in zip(*(part.column(i).to_pylist() for i in range(3))):
                data = x.encode()
                at, h, first, last = anchors(np.frombuffer(data, np.uint8))
                end = last + LENGTH
                f = np.array([xxhash.xxh64_intdigest(data[a:b], p - a) for p, a, b in zip(at.tolist(), first.tolist(), end.tolist())], np.uint64)
                one, z = _runs(first, end, f)
                rows = (h[one].view(np.int64), f[one].view(np.int64), np.full(len(one), rk, np.int64), np.full(len(one), digest, np.int64), at[one], first[one], end[one], z)
                for column, values in zip(columns, (*rows[:4], *(r.astype(np.int32) for r in rows[4:]))):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["h", "f", "rk", "digest", "p", "a", "b", "z"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sides(data: bytes, p: int) -> tuple[bytes, bytes]:
    """The anchor at ``p`` with half of its reach before it, and with half behind it. A string of full length has one of them whole."""
    half = REACH // 2
    return data[max(0, p - half) : p + GRAM], data[p : p + GRAM + half]


_CONTEXT = "h long, context binary, rk long, digest long, s int, before long, behind long"
_CROWD = "context binary, rk long, digest long, s int, p int, lo int, hi int"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _wanted(batches: Iterator[pa.RecordBatch], crowded: bool) -> Iterator[tuple[bytes, int, int, dict]]:
    for batch in batches:
        for part in slices(batch, "x", 1 << 20):
            for x, rk, digest, found in zip(*(part.column(i).to_pylist() for i in range(4))):
                data = x.encode()
                for r in found:
                    if r["alone"] and r["crowded"] == crowded:
                        yield data, rk, digest, r


def _in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 10_000)):
        yield _batch(held, names, kinds)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        (r["h"], data[r["a"] : r["b"]], rk, digest, r["a"], *(_signed(xxhash.xxh64_intdigest(x, r["h"] % (1 << 64))) for x in _sides(data, r["p"])))
        for data, rk, digest, r in _wanted(batches, False)
    )
    yield from _in_batches(rows, ["h", "context", "rk", "digest", "s", "before", "behind"], [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])


def _crowd_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((data[r["a"] : r["b"]], rk, digest, r["a"], r["p"], 0, REACH) for data, rk, digest, r in _wanted(batches, True))
    yield from _in_batches(rows, ["context", "rk", "digest", "s", "p", "lo", "hi"], [pa.binary(), pa.int64(), pa.int64(), *[pa.int32()] * 4])


def ranges(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    """At most ``parts`` ranges that make up the numbers from ``lo`` to ``hi``."""
    step = -(-(hi - lo + 1) // parts)
    return [(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)]


def _narrowed(parts: int):
    """For each range of a context's, its row with two hashes of the bytes that all strings of the range hold, if the context has them. The context is cut to the strings of the range, so that no string is sorted in two groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for context, rk, digest, s, p, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                for lo, hi in ranges(low, high, parts):
                    a, b = p - s - lo, p - s + LENGTH - hi
                    if a >= 0 and b <= len(context):
                        d = xxhash.xxh128_digest(context[a:b], lo)
                        first, end = max(0, p - s - hi), p - s - lo + LENGTH
                        cut = context[first:end]
                        f = _signed(xxhash.xxh64_intdigest(cut, p - s - first))
                        yield int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), f, cut, rk, digest, s + first, p, lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(rows(batches), ["h", "other", "f", "context", "rk", "digest", "s", "p", "lo", "hi"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.int32()] * 4])

    return run


_SPANS = ["rk", "digest", "a", "b"]


def _with_partners(rows: list[tuple]) -> list[tuple]:
    """Rows of which a string can stand elsewhere: such a string shares one whole side with another context of the anchor."""
    seen = Counter(x for r in rows for x in ((0, r[5]), (1, r[6])))
    return [r for r in rows if seen[0, r[5]] > 1 or seen[1, r[6]] > 1]


def _shards(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of whole groups of at most ``SHARD_BYTES`` together, or of one group that is larger; rows come sorted by hash."""
    held: list[tuple] = []
    size = 0
    for _, group in groupby(rows, key=lambda row: row[0]):
        own = list(group)
        more = sum(len(row[1]) for row in own)
        if held and size + more > SHARD_BYTES:
            yield held
            held, size = [], 0
        held += own
        size += more
    if held:
        yield held


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over shards; rows come sorted by hash."""
    for rows in _shards(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
        rows = _with_partners(rows)
        texts = {k: i for i, k in enumerate(dict.fromkeys((r[2], r[3]) for r in rows))}
        place = np.array([texts[r[2], r[3]] for r in rows], np.int64)
        found = repeated_starts([r[1] for r in rows], place, np.array([r[4] for r in rows], np.int64))
        spans = [(r[2], r[3], a + r[4], b + r[4]) for r, starts in zip(rows, found) for a, b in spans_of(starts)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in spans], pa.int64()) for i in range(4)], _SPANS)


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "x"):
            kept, spans = [], []
            for x, copies, found, more in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                data = x.encode()
                if copies is not None and copies > 1:
                    gone = [(0, len(data))]
                else:
                    gone = [(r["a"], r["z"]) for r in found or () if r["equal"]]
                    gone = merged(gone + [(r["a"], r["b"]) for r in more or ()])
                edges = [0, *(e for span in gone for e in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in part.column(1).to_pylist()], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["id", "n_bytes", "kept", "gone"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """For each row: ``key``, ``n_bytes``, ``kept`` (the bytes that stay, joined) and ``gone``, the maximal removed (start, stop) runs.

    Null counts as empty; of texts under 200 bytes all stays. Rows of equal texts of 200 bytes or more lose everything, which repeated
    rows are too. Strings are judged on the input, overlaps count and no match crosses texts. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("x"))
    rows = rows.select("id", "x", F.xxhash64(F.lit("second"), "x", "id").alias("rk"), F.xxhash64("x").alias("digest"))
    # How many rows have each text of full length, and which of them takes part; a text is known by two 64-bit hashes.
    texts = rows.where(F.octet_length("x") >= LENGTH).select("rk", "digest", F.xxhash64(F.lit("third"), "x").alias("other"))
    chosen = texts.groupBy("digest", "other").agg(F.min("rk").alias("acting"), F.count("*").alias("copies"))
    own = texts.distinct().join(chosen, ["digest", "other"]).select("rk", "digest", "copies", (F.col("rk") == F.col("acting")).alias("acts"))
    dealt = rows.repartition("rk", "digest")  # the only time that texts move
    acting = dealt.join(own.where("acts"), ["rk", "digest"])
    found = acting.select("x", "rk", "digest").mapInArrow(_anchor_rows, _PLACES)
    rows_of = F.when(F.col("z") > F.col("b"), 2).otherwise(1)
    of_anchor, of_context = Window.partitionBy("h"), Window.partitionBy("h", "f")
    counted = found.select("*", F.sum(rows_of).over(of_anchor).alias("n_h"), F.sum(rows_of).over(of_context).alias("n_f"), F.row_number().over(of_context.orderBy("rk", "digest", "p")).alias("nth")).where("n_h > 1")
    marked = counted.select("h", "rk", "digest", "p", "a", "b", "z", (F.col("n_f") > 1).alias("equal"), ((F.col("nth") == 1) & (F.col("n_h") > F.col("n_f"))).alias("alone"), F.sum((F.col("nth") == 1).cast("int")).over(of_anchor).alias("contexts"))
    marked = marked.where("equal OR alone")
    by_text = marked.groupBy("rk", "digest").agg(F.collect_list(F.struct("p", "a", "b", "z", "h", "equal", "alone", (F.col("contexts") > group).alias("crowded"))).alias("found"))

    scratch = Scratch(spark)
    by_text = scratch.keep("found", by_text)

    def places(crowded: bool) -> DataFrame:
        some = by_text.where(F.exists("found", lambda r: r["alone"] & (r["crowded"] == F.lit(crowded))))
        return dealt.join(some, ["rk", "digest"]).select("x", "rk", "digest", "found")

    groups, equal = _from_crowds(places(True).mapInArrow(_crowd_rows, _CROWD), group, scratch)
    contexts = places(False).mapInArrow(_context_rows, _CONTEXT)
    for part in groups:
        contexts = contexts.unionByName(part)
    sorted_spans = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_shard_rows, "rk long, digest long, a long, b long")
    for part in equal:
        sorted_spans = sorted_spans.unionByName(part)
    more = sorted_spans.groupBy("rk", "digest").agg(F.collect_set(F.struct("a", "b")).alias("more"))
    joined = dealt.join(own.select("rk", "digest", "copies"), ["rk", "digest"], "left").join(by_text, ["rk", "digest"], "left").join(more, ["rk", "digest"], "left")
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), *T._parse_datatype_string("n_bytes long, kept binary, gone array<struct<start: long, stop: long>>").fields])
    return joined.select("id", "x", "copies", "found", "more").mapInArrow(_kept_rows, schema).withColumnRenamed("id", key)


def _from_crowds(crowd: DataFrame, group: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """The contexts of crowded anchors in groups of at most ``group``, and the (rk, digest, a, b) of cut contexts that occur more than once."""
    crowd = scratch.keep("crowd", crowd)
    groups: list[DataFrame] = []
    equal: list[DataFrame] = []
    for k, parts in enumerate(PARTS):
        if crowd.isEmpty():
            break
        narrowed = scratch.keep(f"narrowed-{k}", crowd.mapInArrow(_narrowed(parts), "h long, other long, f long, " + _CROWD))
        # Equal contexts are counted before they meet; one of each goes on. In the last ranges all of a group are equal.
        place = F.struct("rk", "digest", "s")
        alike = narrowed.groupBy("h", "other", "f").agg(F.count("*").alias("n"), F.min(place).alias("acting"))
        sizes = alike.groupBy("h", "other").agg(F.count("*").alias("contexts"))
        marks = checkpointed(alike.join(sizes, ["h", "other"]).where("n > 1 OR contexts > 1"))
        bounded = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
        marked = narrowed.join(bounded, ["h", "other", "f"]).select("h", "contexts", *crowd.columns, (F.col("n") > 1).alias("equal"), (place == F.col("acting")).alias("acts"))
        marked = scratch.keep(f"marked-{k}", marked)
        scratch.drop(f"narrowed-{k}")
        equal.append(marked.where("equal").select("rk", "digest", F.col("s").cast("long").alias("a"), (F.col("s") + F.length("context")).cast("long").alias("b")))
        acting = marked.where("acts AND contexts > 1")
        groups.append(acting.where(F.col("contexts") <= group).select("h", "context", "rk", "digest", "s", F.col("h").alias("before"), F.col("h").alias("behind")))
        crowd = acting.where(F.col("contexts") > group).select(*crowd.columns)
    return groups, equal


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of what ``remove_repeats`` gives."""
    return remove_repeats(df, key, text).select(F.col(key), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("gone").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
