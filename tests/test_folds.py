import numpy as np
import pytest
from conftest import by_row, same
from pyspark.sql import functions as F

from tickloom.functions.series import Layout
from tickloom.operators import folds
from tickloom.settings import Settings

S = Settings(n_splits=4, train_rows=100, val_rows=30, min_train=60, min_val=20, purge_rows=10, embargo_rows=5)


@pytest.fixture(scope="module")
def rows(bars):
    df = bars.withColumns({"target": F.when(F.col("rn") % 7 < 6, (F.col("rn") % 3 == 0).cast("double")), "x": F.col("close")})
    return folds.labelled_rows(df.filter("ticker = 'AAA' or rn <= 260"), ["x"], Layout(50)).persist()


def index_sets(n, scheme):
    """The splits in row numbers, written as the two loops over folds."""
    out, fold = {}, 0
    for i in range(S.n_splits):
        if scheme == "sliding":
            lo, hi = i * S.val_rows, i * S.val_rows + S.train_rows
            end = min(n, hi + S.val_rows)
            if end > hi and hi <= n and end - hi >= S.min_val:
                fold += 1
                out[fold] = (set(range(lo, hi)), set(range(hi, end)))
        else:
            start = i * S.val_rows + S.min_train
            end = min(n, start + S.val_rows)
            if start >= n or end <= start:
                break
            if start - S.purge_rows >= S.min_train:
                fold += 1
                out[fold] = (set(range(start - S.purge_rows)), set(range(start, end)))
    return out


@pytest.mark.parametrize("scheme", ["sliding", "purged"])
def test_members_and_ranges_equal_the_index_sets(rows, scheme):
    members = folds.fold_members(rows, S, scheme).toPandas()
    counts = rows.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    table = folds.fold_table(counts, S, scheme).toPandas()
    for ticker, n in counts.toPandas().itertuples(index=False):
        expected = index_sets(n, scheme)
        ranges = table[table.ticker == ticker].set_index("fold")
        assert sorted(ranges.index) == sorted(expected)
        for fold, (train, test) in expected.items():
            assert set(range(ranges.train_lo[fold], ranges.train_hi[fold])) == train
            part = members[(members.ticker == ticker) & (members.fold == fold)]
            got_train, got_val = (set(part[part.role == r].rn - 1) for r in ("train", "val"))
            embargo = S.embargo_rows if scheme == "purged" else 0
            assert got_train == set(sorted(train)[:len(train) - embargo])
            assert got_val == test
            assert max(got_train) < min(got_val)


def test_first_purged_fold_is_the_first_with_enough_rows(rows):
    table = folds.fold_table(rows.groupBy("ticker").agg(F.count("*").alias("n_rows")), S, "purged")
    assert table.agg(F.min("fold"), F.min("train_hi")).first()[:] == (1, S.val_rows + S.min_train - S.purge_rows)


def test_labelled_rows_are_numbered_without_gaps(rows):
    got = rows.groupBy("ticker").agg(F.max("rn").alias("m"), F.count("*").alias("n"), F.max("n_rows").alias("t")).collect()
    assert all(r["m"] == r["n"] == r["t"] for r in got)


def test_scaling_is_fitted_on_training_rows_only(rows):
    members = folds.fold_members(rows, S)
    robust = folds.robust_scale(members, ["x"], "_r").toPandas()
    standard = folds.standard_scale(members, ["x"], "_s").toPandas()
    for key, part in robust.groupby(["ticker", "fold"]):
        train = part[part.role == "train"].x
        q1, q2, q3 = np.percentile(train, [25, 50, 75])
        same(part.x_r, (part.x - q2) / (q3 - q1))
        other = standard[(standard.ticker == key[0]) & (standard.fold == key[1])]
        same(other.x_s, (other.x - train.mean()) / train.std(ddof=0))


def test_constant_feature_scales_to_zero(rows):
    flat = folds.fold_members(rows.withColumn("c", F.lit(3.0)), S)
    for fn in (folds.robust_scale, folds.standard_scale):
        assert fn(flat, ["c"]).filter("c <> 0").count() == 0


def test_validation_returns_span_labelled_rows_and_end_at_zero(rows):
    members = folds.fold_members(rows.withColumn("volatility_20", F.col("close")), S)
    val = by_row(folds.validation_rows(members).filter("fold = 1"), "close", "ret")
    for _, g in val.groupby("ticker"):
        c = g.close.to_numpy()
        same(g.ret, [*(c[1:] / c[:-1] - 1), 0.0])


def test_reasons_and_weights(spark):
    rows = [("A", 1, "train", 1.0 * (i % 4 == 0)) for i in range(80)] + [("A", 1, "val", 1.0 * (i % 2)) for i in range(30)]
    rows += [("B", 1, "train", 1.0) for _ in range(10)] + [("C", 1, "train", 0.0) for _ in range(80)] + [("C", 1, "val", 0.0)] * 30
    rows += [("D", 1, "train", 0.0)] * 80 + [("D", 1, "val", 0.0)] * 3
    df = spark.createDataFrame(rows, "ticker string, fold int, role string, target double")
    reasons = {r["ticker"]: r["reason"] for r in folds.skip_reasons(df, S).collect()}
    assert reasons == {"A": None, "B": "insufficient_train_size", "C": "single_validation_class", "D": "insufficient_validation_size"}
    weights = {r["ticker"]: r["pos_weight"] for r in folds.class_weights(df).collect()}
    assert weights == {"A": 4.5, "B": 1.0, "C": 1.0, "D": 1.0}


def test_expanding_statistics_are_those_of_the_copied_rows(spark):
    rng = np.random.default_rng(7)
    data = [(t, k + 1, float(rng.integers(0, 2)), None if k % 50 == 3 else float(1e4 + rng.normal()), n) for t, n in (("A", 900), ("B", 433), ("C", 100)) for k in range(n)]
    rows = spark.createDataFrame(data, "ticker string, rn long, target double, x double, n_rows long")
    for s in (Settings(), Settings(min_train=100, val_rows=30, purge_rows=7, embargo_rows=0, min_val=20), Settings(min_train=80, val_rows=50, purge_rows=70, embargo_rows=30)):
        members = folds.fold_members(rows, s, "purged")
        train = members.filter("role = 'train'").groupBy("ticker", "fold").agg(
            F.count("*").alias("n_train"), F.count_if(F.col("target") == 0).alias("n_sell"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
        want = {(r["ticker"], r["fold"]): r for r in train.collect()}
        got = {(r["ticker"], r["fold"]): r for r in folds.expanding_statistics(rows, ["x"], s).filter("n_train > 0").collect()}
        assert got.keys() == want.keys() and len(want) > 3
        for k, r in want.items():
            assert (got[k]["n_train"], got[k]["n_sell"]) == (r["n_train"], r["n_sell"])
            assert abs(got[k]["mean_x"] - r["m"]) < 1e-9 and abs(got[k]["std_x"] - r["sd"]) < 1e-9
        assert sorted(folds.expanding_skip_reasons(rows, s).collect(), key=str) == sorted(folds.skip_reasons(members, s).collect(), key=str)
        assert sorted(folds.expanding_class_weights(rows, s).collect(), key=str) == sorted(folds.class_weights(members).collect(), key=str)
