"""Induced sorting against plain sorting, and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from lakeloom.llm import suffixes


@pytest.mark.parametrize("letters, n", [(1, 40), (2, 300), (3, 2000), (60, 5000)])
def test_suffix_array(letters, n):
    random.seed(n)
    s = [random.randrange(letters) + 1 for _ in range(n)]
    s = s + s[: n // 2] + [1] * 30 + [0]
    found = suffixes.suffix_array(np.array(s, np.int16), letters + 1)
    assert found.tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts):
    n = suffixes.LENGTH
    where = defaultdict(set)
    for k, data in enumerate(texts):
        for i in range(len(data) - n + 1):
            where[data[i : i + n]].add((k, i))
    out = []
    for k, data in enumerate(texts):
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - n + 1):
            if len(where[data[i : i + n]]) > 1:
                gone[i] += 1
                if i + n < len(gone):
                    gone[i + n] -= 1
        mask = np.cumsum(gone)[: len(data)] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out.append((len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffixes.GROUP, 4, 1])
def test_repeats(spark, group, monkeypatch):
    random.seed(9)
    say = lambda n: "".join(random.choices("abcde  éß\0\n", k=n))
    shared, other = say(450), say(199)
    texts = [None, "", "x", "x" * 199, "y" * 700, say(3000), "ab" * 300 + say(50), other, other, say(200), other + say(300), say(100) + other + say(10)]
    texts += [say(random.randrange(300)) + shared[random.randrange(20) :] + say(random.randrange(300)) for _ in range(12)]
    texts += [shared[:205] + say(400) + shared[:205], say(60) + shared[100:301], shared[100:300] + say(5), texts[5], texts[5][:1500] + "!" + texts[5][1500:], say(400) * 3, "y" * 230 + say(30), texts[9]]
    rows = [(i, x, 0) for i, x in enumerate(texts)] + [(None, say(500), 0), (5, texts[5], 0)]
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1000)
    default = suffixes.remove_repeats
    monkeypatch.setattr(suffixes, "remove_repeats", lambda *a: default(*a, group))
    found = suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    expected = brute([(x or "").encode() for _, x, _ in rows])
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == sorted((str(i), *e) for (i, _, _), e in zip(rows, expected))
    assert sum(e[1] > 0 for e in expected) > 15


def test_random_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    data = np.random.default_rng(1).integers(0, 3, 5000).astype(np.uint8)
    found = suffixes.anchors(data)
    monkeypatch.undo()
    whole = suffixes.anchors(data)
    assert [x.tolist() for x in found] == [x.tolist() for x in whole]
    # Every string has one anchor, the least of its hashes.
    h = suffixes.gram_hashes(data)
    starts = [(i, p) for p, _, a, b in zip(*whole) for i in range(a, b + 1)]
    assert sorted(i for i, _ in starts) == list(range(len(data) - suffixes.LENGTH + 1))
    assert all(h[p] == h[i : i + suffixes.REACH + 1].min() for i, p in starts)


def test_empty(spark):
    assert suffixes.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_last_ranges_are_single_numbers():
    found = [(0, suffixes.REACH)]
    for parts in suffixes.PARTS:
        found = [r for lo, hi in found for r in suffixes.ranges(lo, hi, parts)]
    assert found == [(i, i) for i in range(suffixes.REACH + 1)]


def test_shards_stay_small(monkeypatch):
    """Two groups share a shard only if both fit; no group is cut."""
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1000)
    rows = [(h, bytes(n)) for h, n in ((1, 400), (2, 500), (3, 900), (4, 700), (4, 800), (5, 10))]
    found = list(suffixes._shards(iter(rows)))
    assert [[r[0] for r in x] for x in found] == [[1, 2], [3], [4, 4], [5]]


def test_contexts_of_a_range_hold_its_strings_alone():
    import pyarrow as pa

    random.seed(3)
    data = bytes(random.choices(b"abc", k=suffixes.LENGTH + suffixes.REACH))
    p = suffixes.REACH
    row = suffixes._batch([(data, 7, 8, 0, p, 0, suffixes.REACH)], ["context", "rk", "digest", "s", "p", "lo", "hi"], [pa.binary(), pa.int64(), pa.int64(), *[pa.int32()] * 4])
    for parts in (2, 8, 160):
        made = [r for b in suffixes._narrowed(parts)(iter([row])) for r in b.to_pylist()]
        starts = [i for r in made for i in range(r["s"], r["s"] + len(r["context"]) - suffixes.LENGTH + 1)]
        assert sorted(starts) == list(range(suffixes.REACH + 1))
        assert all(data[r["s"] : r["s"] + len(r["context"])] == r["context"] for r in made)


def test_equal_cut_contexts_go_no_further(spark, monkeypatch, tmp_path):
    """Contexts that differ only outside of a range are equal within it: none of them goes into a shard twice."""
    from lakeloom.llm.common import Scratch

    random.seed(12)
    say = lambda n: "".join(random.choices("abcdefghij ", k=n))
    passage = say(600)
    texts = [say(80) + passage + say(80) for _ in range(40)]
    made = []
    default = suffixes._from_crowds

    def crowds(crowd, group, scratch: Scratch):
        groups, equal = default(crowd, group, scratch)
        made.append((crowd.count(), sum(x.count() for x in groups), sum(x.count() for x in equal)))
        return groups, equal

    monkeypatch.setattr(suffixes, "_from_crowds", crowds)
    found = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=8).collect()
    assert all(len(passage) <= sum(g.stop - g.start for g in r.gone) <= len(passage) + 20 for r in found)
    (before, shards, equal) = made[0]
    assert before > 40 and equal > 0 and shards < before
