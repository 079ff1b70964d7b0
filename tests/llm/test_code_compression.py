import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import code_compression as cc
from tickloom.llm.queries import ORACLE, code_sql

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(x, size, rounds):
    """All entries compared with all parts, in Python's whole numbers; x is (rows, parts, width), seeds first."""
    parts = x.shape[1]
    books = [[list(map(int, v)) for v in x[:size, p]] for p in range(parts)]

    def assign():
        out = []
        for row in x:
            picks = []
            for p in range(parts):
                d = [sum((int(a) - b) ** 2 for a, b in zip(row[p], e)) for e in books[p]]
                picks.append((min(d), d.index(min(d))))
            out.append(picks)
        return out

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [x[k, p] for k in range(len(x)) if chosen[k][p][1] == i]
                if mine:
                    books[p][i] = [sum(int(v[d]) for v in mine) // len(mine) for d in range(x.shape[2])]
    return assign(), books


@pytest.mark.parametrize("width,size,spread", [(4, 64, 30), (4, 64, 1), (1, 7, 3), (2, 1, 5), (3, 2, 200)])
def test_balls_give_what_all_comparisons_give(width, size, spread):
    rng = np.random.default_rng(width * size)
    x = rng.integers(-spread, spread + 1, (1500, width))
    book = x[rng.integers(0, len(x), size)]  # with equal entries
    distances = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    for start in (None, rng.integers(0, size, len(x)), distances.argmin(axis=1)):
        code, error = cc.nearest(x, book, start)
        assert (code == distances.argmin(axis=1)).all() and (error == distances.min(axis=1)).all()


def test_whole_table_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(0, 0.2, (150, 32)).astype(np.float32)
    vectors[40:60] = vectors[3]
    df = spark.createDataFrame([(int(k), v.tolist(), int(k % 3) if k % 4 else None) for k, v in enumerate(vectors)], SCHEMA).repartition(5)
    coded, books = cc.compress(df, entries=20)
    whole = np.floor(vectors.astype(float) * 256).astype(int).reshape(150, 16, 2)
    want, entries = brute(whole, 20, 2)
    got = {r["vec_id"]: (list(r["code"]), r["error"]) for r in coded.collect()}
    assert got == {k: ([i for _, i in picks], sum(d for d, _ in picks)) for k, picks in enumerate(want)}
    assert books.entries.tolist() == entries
    table = {r["vec_id"]: r for r in cc.compressed_table(df, entries=20).collect()}
    label = lambda k: k % 3 if k % 4 else None
    for k, r in table.items():
        assert r["code"] == bytes(got[k][0]).hex() and r["error"] == got[k][1]
        assert r["label_error"] == sum(e for j, (_, e) in got.items() if label(j) == label(k))
        assert r["codebooks_sha256"] == hashlib.sha256(",".join(str(c) for b in entries for e in b for c in e).encode()).hexdigest()


def test_sql_form(spark, tmp_path):
    rng = np.random.default_rng(9)
    vectors = np.round(rng.normal(0, 0.01, (90, 16)), 3)
    rows = [(int(k), v.tolist(), int(k % 2) if k % 5 else None) for k, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [float("nan")] + [0.0] * 15, 1), (203, [float("-inf")] + [0.0] * 15, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    columns = "vec_id, code, error, label_error, codebooks_sha256"
    want = db.execute(f"SELECT {columns} FROM ({code_sql()}) ORDER BY vec_id").fetchall()
    got = [tuple(r) for r in cc.compressed_table(df).select(*columns.split(", ")).orderBy("vec_id").collect()]
    assert got == want and len(got) == 90 and "op11_ball_code_compression" in ORACLE


def test_awkward_rows(spark):
    v = [0.5, -0.5] * 8
    df = spark.createDataFrame(
        [(1, v, 1, 7), (1, v, 1, 7), (2, v, None, 8), (None, v, None, 9), (3, None, 1, 0), (4, [None] * 16, 1, 0), (5, [float("nan")] * 16, 1, 0)],
        SCHEMA + ", code int").withColumns({c: F.col("code") for c in ("q", "error", "n", "place", "__label")})
    rows = cc.compressed_table(df).collect()
    assert sorted(str(r["vec_id"]) for r in rows) == ["1", "1", "2", "None"]
    assert {(r["code"], r["error"], r["label_error"]) for r in rows} == {("00" * 16, 0, 0)}
    assert cc.compressed_table(df.limit(0)).collect() == [] and cc.compressed_table(df.filter("vec_id > 2")).collect() == []
    assert cc.compressed_table(df.filter("vec_id is null")).count() == 1
    with pytest.raises(ValueError):
        cc.compress(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], SCHEMA))
    with pytest.raises(ValueError):
        cc.compress(spark.createDataFrame([(1, [1.0] * 17, 1)], SCHEMA))
