import hashlib
import os
import random
import re

import duckdb
import pytest

from tickloom.llm import decontamination as dc
from tickloom.llm.queries import ORACLE, QUERIES

SF = os.environ.get("TICKLOOM_SF_TEXT", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= of
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def key(row):
    return tuple(map(str, row))


ITEMS = [
    (10, " ".join(f"a{k}" for k in range(25))), (2, "Short Item here"), (3, "short item here"), (4, "one"), (5, ""), (6, None), (None, "word1 word2"),
    (7, " ".join(f"a{k}" for k in range(5, 15))), (8, "é ß ü"), (9, " ".join(f"b{k}" for k in range(10)) + " " + " ".join(f"b{k}" for k in range(10))),
]


def test_scan_equals_brute_force(spark):
    rng = random.Random(1)
    docs = [(0, "A0, a1; a2"), (1, None), (2, ""), (3, "x " * 30 + ITEMS[0][1] + " y" * 30), (4, "short-ITEM!here one"), (5, "É ß ü é ß ü")]
    for k in range(6, 60):
        parts = [" ".join(rng.choice(["p", "q", "one", "a3"]) for _ in range(rng.randrange(20)))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(ITEMS)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            parts += [" ".join(w[at:at + rng.randrange(25)]), "z" * rng.randrange(2)]
        docs.append((k, " ".join(parts)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, dc.scan(d, i).collect()), key=key) == sorted(brute(docs, ITEMS), key=key)
    kept = {r["doc_id"] for r in dc.decontaminate(d, i).collect()}
    assert kept == {r[0] for r in brute(docs, ITEMS) if not r[-1]}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    test_scan_equals_brute_force(spark)


def test_spans_are_cut(spark):
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    clean = "Keep, this!  As it is."
    docs = spark.createDataFrame([(1, f"Before It, {ITEMS[0][1]} After. End"), (2, clean), (3, None)], "doc_id long, text string").selectExpr("*", "doc_id as size")
    got = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, items, "spans").collect()}
    assert got == {1: "Before It After End", 2: clean, 3: None}
    with pytest.raises(ValueError):
        dc.decontaminate(docs, items, "other")


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (2, "größe über")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = brute(docs, [(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (2, "größe über")])
    assert sorted(map(tuple, dc.scan(awkward, items).collect()), key=key) == sorted(want, key=key)
    kept = dc.decontaminate(awkward, items)
    assert kept.schema == awkward.schema and kept.count() == sum(not r[-1] for r in want)
    assert dc.scan(nothing, items).collect() == []
    assert not any(r["contaminated"] for r in dc.scan(awkward, items.limit(0)).collect())
    assert dc.decontaminate(awkward, items.limit(0)).count() == awkward.count()


def test_no_python_in_the_plan(spark, awkward):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = dc.scan(awkward, items)._jdf.queryExecution().toString() + dc.hits(awkward.select("doc_id", "text"), dc.item_windows(items), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    rows = QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(map(tuple, rows.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
