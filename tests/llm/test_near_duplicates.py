import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import near_duplicates as nd

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def bag(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    n = min(5, len(words))
    return Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def likeness(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute_classes(rows):
    """class of (id, text): smallest id reachable over equal texts and likeness of 0.8 or more."""
    label = {k: k for k in range(len(rows))}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or likeness(rows[i][1], rows[j][1]) >= 0.8:
                label[top(i)] = top(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[top(k)] = min(best.get(top(k), i), i)
    return {i: best[top(k)] for k, (i, _) in enumerate(rows)}


def edited(words, rate, rng):
    return [f"new{rng.random()}" if rng.random() < rate else w for w in words]


def corpus(seed=5, groups=6, copies=7):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([30, 150, 600]))]
        for _ in range(copies):
            rows.append(" ".join(edited(base, rng.choice([0, 0, 0.01, 0.03, 0.06]), rng)))
        # Chains whose ends are less alike than their links.
        chain = base
        for _ in range(3):
            chain = edited(chain, 0.02, rng)
            rows.append(" ".join(chain))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_registers_estimate_weighted_likeness():
    rng = np.random.default_rng(1)
    shingles = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 40, 300), rng.integers(1, 40, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    kept = nd.signatures([(shingles, a), (shingles, b), (shingles, a)], 4096)
    assert (kept[0] == kept[2]).all()
    assert abs((kept[0] == kept[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)


def test_a_signature_does_not_depend_on_its_batch():
    bags = [nd.bag(np.frombuffer(t.encode(), np.uint8)) for t in (" ".join(f"w{k}" for k in range(n)) for n in (1, 3, 9, 400))]
    together = nd.signatures(bags)
    assert all((nd.signatures([b])[0] == together[k]).all() for k, b in enumerate(bags))


def cells_of(spark, star, classes, **limits):
    ids = sorted({i for pair in star for i in pair})
    return nd._cells(
        spark.createDataFrame([(a, b, 10) for a, b in star], "a long, b long, size long"),
        spark.createDataFrame([(i, 10) for i in ids], "id long, size long"), spark.createDataFrame(classes, "id long, class long"))


def test_texts_that_the_leader_does_not_join(spark):
    # 2-3 are alike, 1 leads their bucket but is near neither: only the second round can join them.
    a = [f"w{k}" for k in range(200)]
    near = a[:170] + [f"x{k}" for k in range(30)]
    texts = [(1, " ".join(a)), (2, " ".join(near)), (3, " ".join(near[:199] + ["y"]))]
    docs = spark.createDataFrame(texts, "id long, text string")
    shared = nd._shared(spark.createDataFrame([(i, 10, 0, 9) for i, _ in texts], "id long, size long, band int, key long"))
    star = nd._star(shared)
    assert sorted((r["a"], r["b"]) for r in star.collect()) == [(1, 2), (1, 3)]
    assert nd._verified(star.select("a", "b"), docs).count() == 0
    cells = cells_of(spark, [(1, 2), (1, 3)], [(1, 1), (2, 2), (3, 3)])
    assert [tuple(r) for r in nd._links_in_cells(cells, docs).distinct().collect()] == [(2, 3)]


def test_cells_hold_every_pair_outside_the_largest_class(spark, monkeypatch):
    monkeypatch.setattr(nd, "CELL_TEXTS", 8)
    classes = [(k, 0 if k < 60 else k - k % 3) for k in range(110)]
    label = dict(classes)
    star = [(0, k) for k in range(1, 110)] + [(200, 201), (200, 202)] + [(300, 301)]
    classes += [(200, 200), (201, 200), (202, 202), (300, 300), (301, 300)]
    rows = cells_of(spark, star, classes).collect()
    held = {}
    for r in rows:
        held.setdefault((r["a"], r["cell"]), set()).add(r["id"])
    assert max(map(len, held.values())) < 50 and 300 not in {a for a, _ in held}
    pairs = {(x, y) for ids in held.values() for x in ids for y in ids if x < y}
    assert all((x, y) in pairs for x in range(110) for y in range(x + 1, 110) if label[x] or label[y])
    assert {(200, 201), (200, 202), (201, 202)} <= pairs


def test_shared_shingles_equal_counters():
    texts = ["", "a b c d e f g", "a b c d e " * 30, "a b c d e f " * 7, "x", "a b c d e f g h i j"]
    got, sizes = nd.shared_shingles([nd.bag(np.frombuffer(t.encode(), np.uint8)) for t in texts], columns=3)
    for i, t in enumerate(texts):
        assert sizes[i] == sum(bag(t).values())
        for j, u in enumerate(texts):
            assert i == j or got[i, j] == sum((bag(t) & bag(u)).values())


def test_a_large_group_whose_members_are_near_the_centre_only(spark, monkeypatch):
    monkeypatch.setattr(nd, "CELL_TEXTS", 6)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(edited(base, rng.choice([0.01, 0.02, 0.04, 0.05]), rng))) for k in range(1, 90)] + [(0, " ".join(base))]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(61), 100, 101, 500]], "id long")
    got = {r["id"]: r["class"] for r in nd.components(nodes, edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 500: 500}


def test_awkward_rows(awkward):
    rows = nd.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["text_id"], r["class_id"]))
    assert got[2] == [(1, 1), (1, 1)] and got[3] == [(3, 1)]
    assert got[4] == [(4, 4)] and got[5] == [(5, 5)] and got[6] == [(6, 6)] and got[7] == [(7, 7)] and got[8] == [(8, 8)] and got[11] == [(11, 11)]
    assert len(got[None]) == 2


def test_empty_table(nothing):
    assert nd.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("text,n", [("", 0), ("one", 1), ("one two three four", 1), ("a b c d e", 1), ("A b c d e f", 2), ("x x x x x x x", 1)])
def test_bags(text, n):
    assert len(nd.bag(np.frombuffer(text.encode(), np.uint8))[0]) == n == len(bag(text))
