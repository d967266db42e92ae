"""Spaced seeds against a brute-force search of all diagonals."""

import itertools
import math
import random

import pytest

from lakeloom.llm import decontaminate as d


def brute(doc, item):
    """Whether some stretch of a diagonal has enough words and enough of them equal."""
    a, b = d.WORD.findall(doc.lower()), d.WORD.findall(item.lower())
    if not b:
        return False
    share = d.SHARE if len(b) >= d.LEAST else (len(b) - 1) / len(b) if len(b) >= d.SHORT else 1
    for diagonal in range(-len(b) + 1, len(a)):
        same = [b[i] == a[i + diagonal] for i in range(max(0, -diagonal), min(len(b), len(a) - diagonal))]
        for i in range(len(same)):
            for j in range(i + min(d.LEAST, len(b)), len(same) + 1):
                if sum(same[i:j]) >= share * (j - i):
                    return True
    return False


def test_matches(spark):
    random.seed(2)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "er", "io", "um", "éx")]
    say = lambda n: " ".join(random.choices(words, k=n))
    items = [(1, say(30)), (2, say(20)), (3, "Only five words are here"), (4, say(8)), (5, None), (6, ""), (7, say(60)), (7, say(25))]
    docs = [(0, None), (1, ""), (2, say(400)), (3, "xx only FIVE words, are here."), (4, "only five words were here")]
    for n, (_, x) in enumerate(items):
        for kind in range(6):
            w = (x or "").split()
            for _ in range((kind if len(w) >= 20 else kind // 3) if w else 0):
                w[random.randrange(len(w))] = "new"
            if kind == 5:
                w = w[: len(w) // 2]
            docs.append((10 + 10 * n + kind, " ".join([say(50), *w, say(30)])))
    frame = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.contaminated(frame, tests).collect()}
    expected = {(i, j) for i, x in docs for j, y in items if brute(x or "", y or "")}
    assert found == expected and len(found) > 20
    assert {(10 + 10 * n, i) for n, (i, x) in enumerate(items) if x} <= found
    blocks = {(r.doc_id, r.item_id) for r in d.contaminated(frame, tests, block_words=20).collect()}
    assert blocks == found
    assert {r.doc_id for r in d.decontaminate(frame, tests).collect()} == {i for i, _ in docs} - {i for i, _ in found}


@pytest.mark.parametrize("n", range(d.SPAN, 24))
def test_masks_see_every_stretch(n):
    """Every way to replace words of a stretch of n that leaves enough of them; items under LEAST words may have one replaced."""
    bits = [sum(1 << i for i, on in enumerate(m) if on == "1") << s for m in d.MASKS for s in range(n - len(m) + 1)]
    replaced = n - math.ceil(d.SHARE * n - 1e-9) if n >= d.LEAST else 1
    assert all(any(not gone & b for b in bits) for gone in (sum(1 << i for i in c) for c in itertools.combinations(range(n), replaced)))


def test_long_text_and_repeated_rows(spark):
    random.seed(3)
    say = lambda n: " ".join(f"w{random.randrange(5000)}" for _ in range(n))
    item = say(40)
    rows = [(1, say(150_000) + " " + item + " " + say(50_000), "x"), (1, "a " + item, "y"), (1, "a " + item, "y"), (2, say(100), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    tests = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.n_equal) for r in d.contaminated(docs, tests).collect())
    assert found == [(1, 7, 1, 40, 40)] * 4 + [(1, 7, 150_000, 40, 40)] * 2
    assert [tuple(r) for r in d.decontaminate(docs, tests).collect()] == rows[3:]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, none).count() == 0
    assert d.contaminated(docs.limit(0), none).count() == 0 and d.decontaminate(docs, none).count() == 1
