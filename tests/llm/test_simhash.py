"""SimHash fingerprints, the covering and the components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from lakeloom.llm import simhash
from lakeloom.llm.components import connected_components


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 8), (None, 3), (7, 7), (2, 1), (20, 30), (30, 40), (40, 10)] + [(100, i) for i in range(101, 300)] + [(i, i + 1) for i in range(1000, 1060)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    expected = brute_components(real, {x for e in real for x in e})
    assert {n: found.get(n, n) for n in expected} == expected
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_covering_finds_all_links():
    random = np.random.default_rng(3)
    fps = [int(x) for x in random.integers(0, 2**63, 200, dtype=np.uint64)]
    for x in fps[:150]:
        for _ in range(3):
            for bit in random.choice(64, int(random.integers(1, 7)), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    row, key, home = simhash.anchors(fps)
    order = np.argsort(key, kind="stable")
    a, b = simhash.links_within(key[order], fps[row[order]], home[order])
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    assert len(near) > 200
    assert brute_components(zip(a.tolist(), b.tolist()), fps.tolist()) == brute_components(fps[near].tolist(), fps.tolist())


@pytest.mark.parametrize("cell", [simhash.CELL, 3])
def test_near_duplicates(spark, cell, monkeypatch):
    random = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one TWO three", "É é É é É", "a b c d"]
    for _ in range(12):
        words = list(random.choice(vocabulary, 300))
        texts.append(" ".join(words))
        for _ in range(4):
            words[int(random.integers(300))] = "new"
            texts.append("  ".join(words).upper())
    rows = [(i * 3 % 101, x, "z") for i, x in enumerate(texts)] + [(None, texts[7], "z"), (3, texts[1], "z")]
    default = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, c: default(d, c, cell))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [slow_fingerprint(x) for _, x, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = brute_components(pairs, range(len(rows)))
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    expected = sorted((str(d), f"{prints[i]:016x}", least[root[i]]) for i, (d, _, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected
    assert len(pairs) > 20


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_rounds_take_few_tasks(spark):
    """Each round of components ran a task for every shuffle partition in each of its stages, however few its edges; here 5,708 tasks in all."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context = spark.sparkContext
    context.setJobGroup("rounds", "rounds")
    try:
        found = {r.node: r.root for r in connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int"), "a", "b").collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(61), 0)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 1500
