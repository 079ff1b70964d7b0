import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import calibration as c

SCHEMA = "ticker string, fold int, rn long, target double, p_raw double"


@pytest.fixture(scope="module")
def keep(spark, tmp_path_factory):
    root, made = tmp_path_factory.mktemp("kept"), []

    def write(df, name):
        made.append(name)
        df.write.parquet(f"{root}/{name}-{len(made)}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}-{len(made)}")

    return write


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    data = []
    for fold in (1, 2, 3):
        p = rng.random(300).round(2 if fold == 3 else 6)  # the third fold has many equal scores
        y = (rng.random(300) < p ** fold).astype(float)
        data += [("A", fold, i + 1, float(b), float(a)) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(data, SCHEMA).repartition(7)


def max_min(p, y):
    """Isotonic values by the formula: the largest over starts of the smallest mean over ends."""
    xs = np.unique(p)
    s, n = np.array([y[p == x].sum() for x in xs]), np.array([(p == x).sum() for x in xs])
    cs, cn = np.append(0, np.cumsum(s)), np.append(0, np.cumsum(n))
    mean = lambda a, b: (cs[b + 1] - cs[a]) / (cn[b + 1] - cn[a])
    k = len(xs)
    return xs, np.array([max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)])


def test_isotonic_equals_the_max_min_formula(scored):
    counts = c.by_score(scored, ["fold"])
    asked = counts.select("fold", F.col("p").alias("p_raw"))
    for ranges in (1, 7, 64):
        got = c.apply_isotonic(asked, c.isotonic(counts, ["fold"], ranges), ["fold"]).toPandas()
        for fold, part in scored.toPandas().groupby("fold"):
            xs, want = max_min(part["p_raw"].to_numpy(), part["target"].to_numpy())
            mine = got[got["fold"] == fold].sort_values("p_raw")
            np.testing.assert_allclose(mine["p_raw"], xs)
            np.testing.assert_allclose(mine["p_isotonic"], np.clip(want, 1e-6, 1 - 1e-6), atol=1e-12)


def test_isotonic_lines_between_steps_and_flat_outside(spark):
    steps = spark.createDataFrame([(1, 0.2, 0.3, 0.1), (1, 0.5, 0.5, 0.9)], "fold int, low double, high double, value double")
    asked = spark.createDataFrame([(1, x) for x in (0.1, 0.2, 0.25, 0.4, 0.5, 0.7)] + [(2, 0.4), (1, None)], "fold int, p_raw double")
    got = {(r["fold"], r["p_raw"]): r["p_isotonic"] for r in c.apply_isotonic(asked, steps, ["fold"]).collect()}
    assert [got[(1, x)] for x in (0.1, 0.2, 0.25, 0.4, 0.5, 0.7)] == pytest.approx([0.1, 0.1, 0.1, 0.5, 0.9, 0.9])
    assert got[(2, 0.4)] is None and got[(1, None)] is None


def test_sigmoid_is_where_the_penalised_loss_is_flat(scored):
    counts = c.by_score(scored, ["fold"])
    for r in c.sigmoid(counts, ["fold"]).collect():
        part = scored.filter(F.col("fold") == r["fold"]).toPandas()
        p, y = part["p_raw"].to_numpy(), part["target"].to_numpy()
        q = 1 / (1 + np.exp(-(r["slope"] * p + r["offset"])))
        assert abs(((q - y) * p).sum() + r["slope"]) < 1e-6 and abs((q - y).sum()) < 1e-6 and r["slope"] > 0
    assert c.sigmoid(counts.limit(0), ["fold"]).collect() == []


def test_calibration_part_is_the_last_fifth_with_both_classes(spark):
    data = [("A", 1, i + 1, float(i % 2), 0.2 + 0.6 * (i % 2)) for i in range(120)] + [("B", 1, i + 1, 0.0, 0.5) for i in range(120)]
    data += [("C", 1, i + 1, float(i % 2), 0.5) for i in range(90)]
    df = spark.createDataFrame(data, SCHEMA)
    part = c.calibration_rows(df, 0.30)
    got = part.groupBy("ticker").agg(F.count("*").alias("n"), F.min("rn").alias("lo")).collect()
    assert [(r["ticker"], r["n"], r["lo"]) for r in got] == [("A", 36, 85)]


def test_method_follows_the_number_of_training_rows(spark):
    df = spark.createDataFrame([(f, "train") for f, n in ((1, 300), (2, 299), (3, 180), (4, 179)) for _ in range(n)] + [(4, "val")] * 300, "fold int, role string")
    got = {r["fold"]: (r["method"], r["share"]) for r in c.planned(df).collect()}
    assert got == {1: ("isotonic", 0.20), 2: ("sigmoid", 0.15), 3: ("sigmoid", 0.15), 4: (None, 0.15)}


def test_flow_reasons_and_fallback(spark, keep, scored):
    held = scored.withColumnRenamed("p_raw", "p_model")
    # Fold 2 is judged on rows that contradict what it was calibrated on; fold 3 has too few held rows.
    val = held.withColumn("target", F.when(F.col("fold") == 2, 1 - F.col("target")).otherwise(F.col("target")))
    val = val.unionByName(held.filter("fold = 1").withColumn("fold", F.lit(4))).unionByName(held.filter("fold = 1").withColumn("fold", F.lit(5)))
    held = held.filter("fold < 3 or rn <= 40")
    plan = spark.createDataFrame([(1, "sigmoid", 0.2), (2, "isotonic", 0.2), (3, "isotonic", 0.2), (4, None, 0.2), (5, "isotonic", 0.2)], "fold int, method string, share double")
    out = c.calibrated(val, held, plan, keep, alert=0.05)
    got = {r["fold"]: r for r in c.quality(out).collect()}
    assert got[1]["calibration_method"] == "sigmoid" and got[1]["calibration_reason"] == "ok"
    assert got[2]["calibration_reason"] in ("fallback_from_isotonic_ece", "ok|sigmoid_not_better")
    assert (got[2]["calibration_method"] == "sigmoid") == (got[2]["calibration_reason"] == "fallback_from_isotonic_ece")
    assert [(got[f]["calibration_method"], got[f]["calibration_reason"], got[f]["calibration_error"]) for f in (3, 4, 5)] == [
        ("none", "insufficient_data_or_single_class", None), ("none", "disabled_by_mode_or_config", None), ("none", "invalid_calibration_split", None)]
    assert out.count() == val.count() and out.filter("fold in (3, 4, 5) and p_raw <> p_model").count() == 0
    assert out.filter("fold < 3 and (p_raw < 1e-6 or p_raw > 1 - 1e-6)").count() == 0
