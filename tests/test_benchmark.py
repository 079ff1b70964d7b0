"""Models of the grid: least squares per fold, encoder and seed, and scores by the candidate's calibration."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.series import Layout
from tickloom.operators import sequences
from tickloom.plans import benchmark as bm


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for fold in (1, 2):
        for k in range(400):
            x = rng.normal(size=3)
            y = float(x[0] - 0.5 * x[1] + 0.3 * fold * x[2] + rng.normal() > 0)
            data.append((("AF", "RO")[k % 2], fold, k // 2 + 1, *map(float, x), y))
    return spark.createDataFrame(data, "ticker string, fold int, rn long, price_to_sma20_scaled double, distance_to_ma200_scaled double, causal_return double, target double")


def test_models_are_least_squares_on_the_drawn_rows(rows):
    pdf = rows.toPandas()
    found = {(r["fold"], r["encoder_mode"], r["seed"]): r for r in bm.coefficients(rows).collect()}
    assert len(found) == 2 * 2 * len(bm.SEEDS)
    for (fold, mode, seed), r in found.items():
        part = pdf[pdf["fold"] == fold]
        code = part["ticker"].map(lambda t: ord(t[0]) * 31 + ord(t[1]) * 17)
        part = part[(part["rn"] * 7919 + seed * 104729 + code) % 1000 < bm.DRAWN]
        used = list(bm.ENCODERS[mode])
        want, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(part)), part[used]]), part["target"], rcond=None)
        np.testing.assert_allclose([r["b0"], r["b1"], r["b2"], r["b3"]][:len(used) + 1], want, atol=2e-6)
    assert len({(r["b0"], r["b1"]) for r in found.values()}) == len(found), "every seed and encoder has a model of its own"


def test_dependent_columns_get_no_slope(rows):
    same = rows.withColumn("distance_to_ma200_scaled", F.col("price_to_sma20_scaled"))
    assert all(r["b1"] == r["b2"] == 0 for r in bm.coefficients(same).collect())
    assert bm.coefficients(rows.limit(0)).collect() == []


def test_scores_follow_the_linear_model(rows):
    found = bm.coefficients(rows)
    scored = bm.model_scores(rows, found)
    assert scored.count() == 800 * 2 * len(bm.SEEDS)
    r = scored.join(found, ["fold", "seed", "encoder_mode"]).filter("encoder_mode = 'tcn'").first()
    linear = r["b0"] + r["b1"] * r["price_to_sma20_scaled"] + r["b2"] * r["distance_to_ma200_scaled"] + r["b3"] * r["causal_return"]
    assert r["p_model"] == pytest.approx(1 / (1 + np.exp(-4 * (linear - 0.5))), abs=1e-6)


def test_candidates_read_their_calibration(spark):
    scores = spark.createDataFrame([(1, "off", 42, 0.1, 0.2, 0.3), (1, "off", 42, 0.1, None, 0.3)], "fold int, encoder_mode string, seed int, p_model double, p_isotonic double, p_sigmoid double")
    got = {}
    for r in bm.setting_grid(scores).collect():
        got.setdefault(r["candidate_id"], set()).add(r["p_raw"])
    method = {c[0]: c[5] for c in bm.CANDIDATES}
    assert got == {c: {0.2, 0.1} if m == "isotonic" else {0.3} for c, m in method.items()}


@pytest.mark.parametrize("chunk", [32, 4096])
def test_causal_means(spark, chunk):
    values = np.random.default_rng(1).normal(size=100)
    df = spark.createDataFrame([("A", k + 1, float(v)) for k, v in enumerate(values)], "ticker string, rn long, seq_returns double")
    got = sequences.causal_means(df, layout=Layout(chunk)).orderBy("rn").toPandas()["causal_return"]
    want = [np.mean([values[max(0, k - n + 1):k + 1].mean() for n in (2, 4, 8, 16)]) for k in range(100)]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_strength_of_features_that_vary_and_that_do_not(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=60).round(3), rng.integers(0, 2, 60).astype(float)
    data = [("varied", float(a), float(b)) for a, b in zip(x, y)] + [("varied", None, 1.0), ("varied", 5.0, None)]
    data += [("flat feature", 0.1, b) for b in (0.0, 1.0, 1.0)] + [("flat target", a, 1.0) for a in (0.1, 0.2, 0.4)] + [("one row", 0.1, 1.0), ("no pair", None, 1.0)]
    df = spark.createDataFrame(data, "run string, x double, target double").repartition(3)
    got = {r["run"]: r["s"] for r in df.groupBy("run").agg(bm.strength("x").alias("s")).collect()}
    assert got["varied"] == pytest.approx(abs(np.corrcoef(x, y)[0, 1]), abs=1e-6)
    assert all(np.isnan(got[k]) for k in ("flat feature", "flat target", "one row")) and got["no pair"] is None
