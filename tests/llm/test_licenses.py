"""License scans: the base rule against brute force, the method on edited notices."""

import random
import re

from lakeloom.llm import licenses

NOTICE = licenses.TEMPLATES[14][1]
TEXTS = [
    None, "", "  ...", "word", "CC-BY cc_by CC by", "All Rights\nReserved. all rights reserved all rights reserved", "gnu General Public License general public", "all rights RESERVED " * 500, "allÉ rights reserved",
    "İ K general public LİCENSE", NOTICE.upper().replace(" ", ", "), NOTICE.replace("person ", "natural person ").replace(" a copy", ""), " ".join(NOTICE.split()[::-1]), "x " * 50_000 + "released under the MIT license.",
    "Licensed under CC BY-NC 4.0.",
]


def slow_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, lowered)
    places = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_scan(spark):
    rows = [(i, x, 1) for i, x in enumerate(TEXTS)] + [(None, TEXTS[5], 2), (6, TEXTS[6], 3), (6, TEXTS[6], 3)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, words int")).collect()
    assert sorted((str(r.doc_id), *map(str, r[1:6])) for r in found) == sorted((str(i), *map(str, slow_base(x))) for i, x, _ in rows)
    by = {r.doc_id: r for r in found}
    assert by[10].labels == "mit" == by[11].labels and by[11].score < by[10].score == 1.0
    assert by[12].labels == "" and by[12].score == 0.0
    assert by[13].labels == "mit" and by[14].labels == "cc-by,cc-by-nc" and by[4].labels == "cc-by"


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_scan(text):
    """Labels and score by going through all pairs of places."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, lowered)
    labels, score = set(), 0.0
    for is_base, label, phrase in [(True, x, p) for p, x in licenses.BASE] + [(False, *x) for x in licenses.TEMPLATES]:
        own = phrase.split()
        hits = sorted((i - j, i, j) for i in range(len(words) - 1) for j in range(len(own) - 1) if words[i : i + 2] == own[j : j + 2])
        groups = []
        for diagonal, i, j in hits:
            if not groups or diagonal != groups[-1][-1][0] and (is_base or diagonal - groups[-1][-1][0] > licenses.GAP):
                groups.append([])
            groups[-1].append((diagonal, i, j))
        for g in groups:
            share = len({j for *_, j in g}) / (len(own) - 1)
            length = max(i for _, i, _ in g) + 2 - min(i for _, i, _ in g)
            if share == 1 if is_base else share >= licenses.COVER and length <= licenses.STRETCH * len(own):
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), round(score, 9)


def test_labels_and_score(spark):
    """Random edits of all templates (words put in, left out, replaced, swapped), two in a text at times, among words of their own."""
    random.seed(8)
    filler = "the of license and version free terms cc by all rights gnu".split()
    texts = []
    for n in range(300):
        parts = []
        for _ in range(n % 3):
            words = random.choice(licenses.TEMPLATES)[1].split()
            for _ in range(random.randrange(6)):
                at = random.randrange(len(words))
                kind = random.randrange(4)
                words[at : at + 1] = [[random.choice(filler), words[at]], [], [random.choice(filler)], words[max(0, at - 1) : at + 1]][kind] or ["x"] * (len(words) < 3)
            parts.append(" ".join(words))
        texts.append(" ".join([*random.choices(filler, k=random.randrange(9)), *parts, *random.choices(filler, k=random.randrange(9))]))
    texts += [licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[3][1], " ".join([licenses.TEMPLATES[11][1]] * 40), " ".join(["licensed under the"] * 3000)]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, round(r.score, 9)) for r in found} == {i: slow_scan(x) for i, x in enumerate(texts)}
    assert len({r.score for r in found}) > 20


def test_clashing_columns(spark):
    rows = [(1, "All rights reserved", 5, "x", "y", 0), (1, "All rights reserved", 6, "x", "y", 0), (2, None, 5, None, None, None)]
    found = sorted(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, id int, digest string, labels string, score int")).collect())
    assert [(r.doc_id, r.n_words, r.labels, r.score) for r in found] == [(1, 3, "reserved", 1.0), (1, 3, "reserved", 1.0), (2, 0, "", 0.0)]
