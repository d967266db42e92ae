"""BPE encoding and decoding with a pair occurrence index.

Each task works through its partition in blocks of bounded bytes. All distinct words of a block that
were not met before are laid into one symbol array with links to the next and previous symbol. An index
maps each mergeable pair (known by its rank) to all positions where it stands. The active ranks are
applied in ascending order, and each merge updates only the lists of the pairs at its two edges. A pair
that contains the product of a merge always has a later rank than that merge (the vocabulary file is
checked for it), so one ascending pass gives what merging each word on its own gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakeloom.llm.common import slices

BLOCK_BYTES = 2 << 20
MEMO_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairIndexBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        ids = {value: i for i, value in self.token_bytes.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)])
        self.pairs: list[tuple[int, int]] = []
        self.product: list[int] = []
        made_at: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if max(made_at.get(left, -1), made_at.get(right, -1)) >= rank:
                raise ValueError("a merge comes before the merges that make its parts")
            new = vocab[spec["model"]["merges"][rank].replace(" ", "") if isinstance(merge, str) else "".join(merge)]
            self.pairs.append((left, right))
            self.product.append(new)
            made_at.setdefault(new, rank)
        keys = np.array([(left << 32) | right for left, right in self.pairs] or [-1])
        self.sorted_keys, first = np.unique(keys, return_index=True)
        self.sorted_ranks = first
        # One slot a pair; pairs that share a slot with another one are found by binary search.
        self.mask = (1 << 20) - 1
        slot = ((keys >> 32) * 0x9E3779B1 + (keys & 0xFFFFFFFF) * 0x85EBCA6B >> 7) & self.mask
        self.slot_key, self.slot_rank = np.full(self.mask + 1, -1), np.full(self.mask + 1, -1)
        self.slot_key[slot], self.slot_rank[slot] = keys, np.arange(len(keys))
        self.crowded = np.bincount(slot, minlength=self.mask + 1) > 1
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        from public_tokenizers import PATTERN

        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each distinct word, all words merged together rank by rank."""
        words = list(dict.fromkeys(words))
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        if not lengths.sum():
            return {w: [] for w in words}
        # A symbol of -1 stands before, between and after the words; no pair contains it.
        flat = self.byte_ids[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
        stops = np.concatenate([[0], np.cumsum(lengths + 1)])
        flat[stops] = -1
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        ranks = self.ranks(flat[:-1], flat[1:])
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first = np.unique(ranks[at], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [x] for r, x in zip(found, np.split(at, first[1:]))}
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = self.pairs[rank]
            i = i[flat[i] == left]
            j = after[i]
            good = flat[j] == right
            i, j = i[good], j[good]
            if left == right and len(i) > 1:
                taken, last = [], -1
                for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                    if x != last:  # else it overlaps the occurrence merged just before
                        taken.append(k)
                        last = y
                i, j = i[taken], j[taken]
            if not len(i):
                continue
            flat[i] = self.product[rank]
            flat[j] = -2
            k = after[j]
            after[i], before[k] = k, i
            edges = np.concatenate([i, before[i]])
            ranks = self.ranks(flat[edges], flat[after[edges]])
            edges, ranks = edges[ranks >= 0], ranks[ranks >= 0]
            if len(ranks) > 1:
                order = np.argsort(ranks, kind="stable")
                edges, ranks = edges[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(edges, cuts)) if len(cuts) else [(int(ranks[0]), edges)]
            else:
                groups = [(int(r), edges) for r in ranks]
            for r, x in groups:
                if r in index:
                    index[r].append(x)
                else:
                    index[r] = [x]
                    heapq.heappush(active, r)
        kept = flat != -2
        ids = flat[kept]
        cut = np.flatnonzero(ids == -1).tolist()
        ids = ids.tolist()
        return {w: ids[a + 1 : b] for w, a, b in zip(words, cut, cut[1:])}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it is none."""
        slot = (left * 0x9E3779B1 + right * 0x85EBCA6B >> 7) & self.mask
        key = (left << 32) | right
        out = np.where(self.slot_key[slot] == key, self.slot_rank[slot], -1)
        lost = np.flatnonzero((out < 0) & self.crowded[slot] & (left >= 0) & (right >= 0))
        if len(lost):
            near = np.minimum(np.searchsorted(self.sorted_keys, key[lost]), len(self.sorted_keys) - 1)
            out[lost] = np.where(self.sorted_keys[near] == key[lost], self.sorted_ranks[near], -1)
        return out

    def pieces(self, text: str) -> list[tuple[int | None, str]]:
        """The text cut at special tokens: (id, its string) or (None, ordinary text)."""
        if self.splitter is None:
            return [(None, text)]
        return [(self.special.get(x) if i % 2 else None, x) for i, x in enumerate(self.splitter.split(text)) if x]

    def decode(self, ids: Iterable[int]) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, PairIndexBpe] = {}


def tokenizer(path: str) -> PairIndexBpe:
    """One tokenizer for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


class BlockEncoder:
    """Encodes blocks of texts. Words get a code when first met; what was made of them is kept in lists by code, of bounded size."""

    def __init__(self, bpe: PairIndexBpe, memo_words: int = MEMO_WORDS):
        self.bpe, self.memo_words = bpe, memo_words
        self.decimal = [str(i) for i in range(max(bpe.token_bytes) + 1)]
        self.clear()

    def clear(self) -> None:
        self.codes: defaultdict[str | int, int] = defaultdict(count().__next__)  # of words, and of special tokens by id
        self.ids: list[str] = []  # of each code: its ids in decimal, joined by commas
        self.bytes: list[bytes] = []  # and the bytes that these ids decode to

    def words(self, texts: list[str]) -> Iterator[list[str | int]]:
        """Words of each text; a special token stands as its id."""
        special = tuple(self.bpe.special)
        findall = self.bpe.pattern.findall
        for text in texts:
            if any(s in text for s in special):
                row: list[str | int] = []
                for i, piece in self.bpe.pieces(text):
                    row.extend(findall(piece) if i is None else [i])
                yield row
            else:
                yield findall(text)

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """The codes of each text's words; afterwards all codes have their ids and bytes."""
        if len(self.ids) > self.memo_words:
            self.clear()
        code = self.codes.__getitem__
        rows = [np.fromiter(map(code, row), np.int32, len(row)) for row in self.words(texts)]
        new = list(islice(self.codes, len(self.ids), None))
        table, decimal = self.bpe.token_bytes, self.decimal
        made = self.bpe.encode_words([w for w in new if isinstance(w, str)])
        for word in new:
            ids = [word] if isinstance(word, int) else made[word]
            self.ids.append(",".join(map(decimal.__getitem__, ids)))
            self.bytes.append(b"".join(map(table.__getitem__, ids)))
        return rows

    def joined(self, row: np.ndarray) -> str:
        return ",".join(map(self.ids.__getitem__, row.tolist()))

    def decoded(self, row: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, row.tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``ids`` (array<int>), the token ids of the whole ``text``.

    Null text counts as empty and gives an empty array. Other columns are kept; a column named ``ids`` is replaced.
    """
    others = [f for f in df.schema.fields if f.name.lower() != ids.lower()]
    schema = T.StructType([*others, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder(tokenizer(path))
        for batch in batches:
            for part in slices(batch, text, block_bytes):
                rows = encoder.block([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()])
                values = pa.array([np.array(encoder.joined(row).split(",") if len(row) else [], np.int32) for row in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), values], [*names, ids])

    return df.select(*[df[f"`{x}`"] for x in names]).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``, the string of each array ``ids``; special tokens are written out, null ids give null."""
    others = [f for f in df.schema.fields if f.name.lower() != text.lower()]
    schema = T.StructType([*others, T.StructField(text, T.StringType(), True)])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            column = batch.column(names.index(ids))
            values = pa.array([None if x is None else bpe.decode(x) for x in column.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), values], [*names, text])

    return df.select(*[df[f"`{x}`"] for x in names]).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: ``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the ids and of what they decode to.

    The ids and the decoded bytes are put together word by word from the block's memo, so neither array nor text is sent
    anywhere. Null and empty texts: no tokens and the digest of nothing. A repeated row gives a repeated result.
    """
    schema = T.StructType([df.schema[key], *[T.StructField(n, t, False) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder(tokenizer(path))
        for batch in batches:
            for part in slices(batch, text, block_bytes):
                rows = encoder.block([x or "" for x in part.column(1).to_pylist()])
                counts, first, second = [], [], []
                for row in rows:
                    ids = encoder.joined(row)
                    counts.append(ids.count(",") + 1 if ids else 0)
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(encoder.decoded(row).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], schema.names)

    return df.select(df[f"`{key}`"], df[f"`{text}`"]).mapInArrow(run, schema)
