import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import models
from tickloom.sources import bars as bar_source
from tickloom.sources.stages import Stages, fingerprint, fold_keys, payload_key


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for t in ("A", "B"):
        for i in range(180):
            x = rng.normal(size=3)
            y = float(x[0] + 0.5 * x[1] + rng.normal() * 0.5 > 0.6)
            data.append((t, 1, i + 1, "train" if i < 120 else "val", *map(float, x), y, 0.01 if y else -0.008, 1.0))
    df = spark.createDataFrame(data, "ticker string, fold int, rn long, role string, a double, b double, c double, target double, ret double, weight double")
    return df.persist()


def test_budgets_and_risky_pairs():
    sizes = [len(models.tuning_candidates(b)) for b in ("low", "medium", "high")]
    assert sizes == [8, 18, 29]
    assert not [c for c in models.tuning_candidates("high") if c.depth >= 7 and c.learning_rate >= 0.03]
    assert len(models.tuning_candidates("high", 0)) == 1


def test_seeds_vary_only_in_stochastic_mode():
    assert models.effective_seed(42, 3, 5) == 42 and models.effective_seed(42, 3, 5, True) == 347


def test_candidates_stop_early_and_discarded_ones_do_not_count():
    assert models.pick_candidate([(0, 0.5), (1, 0.5015), (2, 0.4), (3, 0.9)]) == 0
    assert models.pick_candidate([(0, 0.5), (1, None), (2, 0.4), (3, 0.9), (4, 0.1)]) == 3
    assert models.pick_candidate([(0, None)]) is None


def test_synthetic_rows_balance_the_classes_inside_the_minority(spark):
    rng = np.random.default_rng(1)
    data = [("A", 1, float(v[0]), float(v[1]), float(i < 30)) for i, v in enumerate(rng.normal(size=(150, 2)))]
    df = spark.createDataFrame(data, "ticker string, fold int, a double, b double, target double")
    out = models.synthetic_minority(df, ["a", "b"]).toPandas()
    made, small = out[out.synthetic], out[(out.target == 1) & ~out.synthetic]
    assert len(out[~out.synthetic]) == 150 and (made.target == 1).all()
    assert 0.8 * 120 <= len(out[out.target == 1]) <= 1.0 * 120
    assert made.a.between(small.a.min(), small.a.max()).all()
    again = models.synthetic_minority(df, ["a", "b"]).toPandas()
    assert sorted(made.a) == sorted(again[again.synthetic].a)


def test_elimination_keeps_the_strong_feature(rows):
    assert "a" in models.eliminate_features(rows.filter("role = 'train'"), ["a", "b", "c"], keep=1, trees=10, depth=3)


# --- sources and stages ------------------------------------------------------------------------------

def test_fingerprint_ignores_order_and_sees_every_row(spark, bars):
    cols = ["open", "close"]
    base = fingerprint(bars, cols).first()
    assert fingerprint(bars.orderBy(F.rand(1)), cols).first() == base
    assert fingerprint(bars.withColumn("close", F.when(F.col("rn") == 5, 1.0).otherwise(F.col("close"))), cols).first() != base
    assert fingerprint(bars, ["nothing"]).first()["n"] == 1400


def test_stage_is_built_once_per_key(spark, bars, tmp_path):
    stages, calls = Stages(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return bars

    for _ in range(2):
        assert stages.table("market", {"a": 1}, build).count() == 1400
    stages.table("market", {"a": 2}, build)
    assert len(calls) == 2 and payload_key({"a": 1, "b": 2}) == payload_key({"b": 2, "a": 1})


def test_catalogue_lists_and_removes_what_is_old(spark, bars, tmp_path):
    stages = Stages(spark, str(tmp_path))
    for a in (1, 2):
        stages.table("market", {"a": a}, lambda: bars)
    (tmp_path / "market" / "making-lost").mkdir()
    (tmp_path / "other" / "x").mkdir(parents=True)
    found = {r["key"]: r["finished"] for r in stages.catalogue().collect()}
    assert found == {payload_key({"a": 1}): True, payload_key({"a": 2}): True, "making-lost": False}
    assert stages.expired(1).count() == 0 and stages.expired(-1).count() == 3
    assert stages.remove(stages.expired(-1, keep=[payload_key({"a": 2})])) == 2
    assert [r["key"] for r in stages.catalogue().collect()] == [payload_key({"a": 2})] and (tmp_path / "other" / "x").exists()
    assert stages.table("market", {"a": 1}, lambda: bars).count() == 1400
    with pytest.raises(ValueError):
        stages.table("elsewhere", {}, lambda: bars)
    assert Stages(spark, str(tmp_path / "none")).catalogue().count() == 0


def test_two_writers_of_one_key_read_the_first_table(spark, bars, tmp_path):
    first, second = Stages(spark, str(tmp_path)), Stages(spark, str(tmp_path))

    def slow():  # another writer finishes while this one builds
        first.table("market", {"a": 1}, lambda: bars.limit(10))
        return bars

    assert second.table("market", {"a": 1}, slow).count() == 10 == first.table("market", {"a": 1}, slow).count()


def test_fold_keys_change_with_parameters(spark):
    df = spark.createDataFrame([("A", 1, "train", "2024-01-01"), ("A", 1, "val", "2024-02-01")], "ticker string, fold int, role string, d string").withColumn("date", F.to_date("d"))
    one, two = (fold_keys(df, "off", {"w": w}).first()["fold_key"] for w in (1, 2))
    assert one != two and len(one) == 40


def test_bars_from_csv_are_typed_and_filtered(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Ticker,Date,Open,High,Low,Close,Volume\nMSFT,2024-01-02,1,2,0.5,1.5,oops\nMSFT,2025-01-02,1,2,0.5,1.5,10\nAAPL,2024-01-02,1,2,0.5,1.5,10\n")
    df = bar_source.read_bars(spark, str(tmp_path / "b.csv"), "csv", end="2024-12-31", tickers=["msft "])
    row = df.collect()
    assert len(row) == 1 and row[0]["volume"] is None and row[0]["close"] == 1.5


def test_index_join_keeps_every_bar(spark, bars):
    index = spark.createDataFrame([("2015-01-02", 1.0)], "d string, v double").select(F.to_date("d").alias("date"), F.col("v").alias("vix_close"))
    assert bar_source.with_index(bars.drop("vix_close"), index).count() == 1400
