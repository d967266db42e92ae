"""Benchmark decontamination by spaced-seed hashing.

A fixed mask over ``SPAN`` consecutive words leaves some positions out of the hash, so that it still matches where those words were replaced.
All masked windows of the test items and of the documents are hashed alike (sums of word hashes times odd weights, modulo 2^64) and joined.
Each joined pair of positions fixes a diagonal of document against item, which is verified around the hits: the whole diagonal
overlap is looked at, and a stretch of at least ``LEAST`` words (or the whole item, if it is shorter) with ``SHARE`` of them equal is contamination. Items shorter than ``LEAST`` words may have one word replaced and those under
``SPAN`` words use shorter masks; items under ``SHORT`` words are matched word by word without replacements.

The test set is indexed on the driver in blocks of at most ``BLOCK_WORDS`` words, whatever its size, and each block's sorted arrays are broadcast
once and meet all documents: a join of the two sides' hashes whose smaller side has a proven size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import slices

SPAN, LEAST, SHORT, SHARE = 9, 12, 6, 0.75
#: Masks over up to SPAN words: 1 counts, 0 is left out. Five words count in each, and whichever quarter of the words of a stretch is replaced, some
#: window of some mask has none of them, so no stretch of LEAST words or more with SHARE of them equal goes unseen. (Enumerated for 12 to 23 words;
#: a longer stretch is made up of such ones, and one of them has that share.)
MASKS = ("1101011", "110010011", "111000101", "10100111", "100001111")
#: Masks for items of SHORT to SPAN - 1 words, of which at most one may be replaced: halves of a window of SHORT words.
SHORT_MASKS = ("111", "110001", "100011")
BLOCK_WORDS = 4_000_000
MEMO_WORDS = 400_000
WORD = re.compile(r"\w+")

_WEIGHTS = np.array([xxhash.xxh64_intdigest(f"position {i}") | 1 for i in range(SPAN)], np.uint64)


class Words:
    """64-bit hashes of a text's lower-cased words, with a memo of bounded size."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of a text's words under a mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, hash_of(mask), np.uint64)
    for i, on in enumerate(mask):
        if on == "1":
            out += words[i : i + n] * _WEIGHTS[i]
    return out ^ out >> np.uint64(29)


def hash_of(mask: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(mask))


class TestIndex:
    """Masked windows of test items, sorted by hash, behind a bit table of 2^22 hashes' low bits."""

    def __init__(self, items: list[tuple[int, str | None]]):
        read = Words()
        self.ids = [i for i, _ in items]
        self.words = [read(x) for _, x in items]
        self.least = min((len(w) for w in self.words if len(w)), default=0)
        self.masks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.whole: dict[int, dict[bytes, list[int]]] = {}
        entries: dict[str, list[tuple[np.ndarray, int]]] = {}
        for k, words in enumerate(self.words):
            if not len(words):
                continue
            if len(words) < SHORT:
                self.whole.setdefault(len(words), {}).setdefault(words.tobytes(), []).append(k)
                continue
            for mask in MASKS if len(words) >= SPAN else SHORT_MASKS:
                entries.setdefault(mask, []).append((masked(words, mask), k))
        self.bits = np.zeros(1 << 22, bool)
        for mask, found in entries.items():
            hashes = np.concatenate([h for h, _ in found])
            item = np.concatenate([np.full(len(h), k) for h, k in found])
            pos = np.concatenate([np.arange(len(h)) for h, _ in found])
            order = np.argsort(hashes, kind="stable")
            self.masks[mask] = hashes[order], item[order], pos[order]
            self.bits[hashes & np.uint64(len(self.bits) - 1)] = True

    def diagonals(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position minus item position) of all hits in a document."""
        found: set[tuple[int, int]] = set()
        for mask, (hashes, item, pos) in self.masks.items():
            own = masked(words, mask)
            at = np.flatnonzero(self.bits[own & np.uint64(len(self.bits) - 1)])
            if not len(at):
                continue
            low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            many = high - low
            i = np.repeat(at, many)
            j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            found.update(zip(item[j].tolist(), (i - pos[j]).tolist()))
        return found

    def verify(self, words: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """The longest stretch of a diagonal that counts: (first document word, words, words that are equal)."""
        own = self.words[item]
        first, last = max(0, -diagonal), min(len(own), len(words) - diagonal)
        same = own[first:last] == words[first + diagonal : last + diagonal]
        least = min(LEAST, len(own))
        share = SHARE if len(own) >= LEAST else (len(own) - 1) / len(own)
        # With these gains a stretch of the wanted share adds up to 0 or more: the longest one by prefix sums.
        gain = np.r_[0.0, np.cumsum(np.where(same, 1 - share, -share))] + 1e-9 * np.arange(len(same) + 1)
        most_after = np.maximum.accumulate(gain[::-1])[::-1]
        least_before = np.minimum.accumulate(gain)
        best = (0, 0)
        j = 0
        for i in range(len(same)):
            if i and gain[i] > least_before[i - 1]:
                continue
            j = max(j, i)
            while j < len(same) and most_after[j + 1] >= gain[i]:
                j += 1
            best = max(best, (j - i, -i))
        n, i = best[0], -best[1]
        return (first + diagonal + i, n, int(same[i : i + n].sum())) if n >= least and n else None

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first word, words, equal words), the longest stretch of each item that the document contains."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, diagonal in self.diagonals(words):
            found = self.verify(words, item, diagonal)
            if found and (item not in best or (-found[1], found[0]) < (-best[item][1], best[item][0])):
                best[item] = found
        for n, known in self.whole.items():
            for i in range(len(words) - n + 1):
                for item in known.get(words[i : i + n].tobytes(), ()):
                    best.setdefault(item, (i, n, n))
        return [(item, *x) for item, x in sorted(best.items())]


def _blocks(tests: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in lists of bounded size. Their number of words is counted first; each block is then read by a hash of the text."""
    rows = tests.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("x"))
    n = rows.agg(F.sum(F.length("x"))).first()[0] or 0
    blocks = max(1, -(-n // (4 * block_words)))
    for b in range(blocks):
        yield [(r.i, r.x) for r in rows.where(F.pmod(F.xxhash64("i", "x"), F.lit(blocks)) == b).collect()]


def contaminated(df: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``df`` and test item it contains: ``key``, ``item_id``, ``first_word``, ``n_words`` and ``n_equal``.

    Words are runs of letters, digits and underscores, lower-cased. Null and wordless texts and items match nothing; a repeated row
    or item gives its own rows. An empty test set gives no rows.
    """
    schema = T.StructType([df.schema[key], T.StructField("item_id", tests.schema[item].dataType), *[T.StructField(n, T.LongType(), False) for n in ("first_word", "n_words", "n_equal")]])
    out = None
    for items in _blocks(tests, item, item_text, block_words):
        shared = df.sparkSession.sparkContext.broadcast(TestIndex(items))
        part = df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_matcher(shared, text, schema), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _matcher(shared, text: str, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, read = shared.value, Words()
        ids = pa.array(index.ids)
        for batch in batches:
            for part in slices(batch, text):
                rows = [(r, *m) for r, x in enumerate(part.column(1).to_pylist()) for m in index.matches(read(x))]
                if rows:
                    row, item, *numbers = (pa.array(list(x), pa.int64()) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), ids.take(item), *numbers], schema.names)

    return run


def decontaminate(df: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that contain no test item. One pass without a shuffle for each block of the test set."""
    schema = df.schema
    for items in _blocks(tests, "item_id", item_text, BLOCK_WORDS):
        shared = df.sparkSession.sparkContext.broadcast(TestIndex(items))
        df = df.mapInArrow(_cleaner(shared, df.columns.index(text), text), schema)
    return df


def _cleaner(shared, at: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, read = shared.value, Words()
        for batch in batches:
            for part in slices(batch, text):
                clean = [not index.matches(read(x)) for x in part.column(at).to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

    return run
