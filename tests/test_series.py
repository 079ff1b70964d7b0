import pytest
from conftest import by_row, same
from pyspark.sql import functions as F

from tickloom.functions.series import Layout, decayed_states, fill, number_rows, running_sum, tail


def test_row_numbers_do_not_depend_on_the_buckets(spark, bars):
    df0 = bars.withColumnRenamed("rn", "rn0")
    for bucket in (F.year("date"), F.lit(0), F.expr("rn0 div 7")):
        df = number_rows(df0, bucket, total="n")
        assert df.filter("rn <> rn0 or n <> 700").count() == 0


def test_every_row_has_one_core_copy_and_enough_neighbours(bars):
    df = Layout(50).spread(bars, before=30, after=10)
    assert df.filter("core").count() == bars.count()
    counts = df.groupBy("ticker", "chunk").count().toPandas()
    assert counts["count"].max() <= 50 + 30 + 10


def test_layout_refuses_a_look_back_longer_than_a_chunk(bars):
    with pytest.raises(ValueError):
        Layout(50).spread(bars, before=51)


@pytest.mark.parametrize("rows", [64, 450, 1024])
def test_decayed_states_equal_a_row_loop_in_any_chunks(bars, bars_pdf, rows):
    layout = Layout(rows)
    spread = layout.spread(bars.withColumn("some", F.when(F.col("rn") % 7 > 0, F.col("close"))), before=30)
    out = by_row(Layout.core(decayed_states(spread, {"a": ("close", 0.9), "b": ("some", 0.5), "c": ("close", 0.99)}, layout)), "a", "b", "c")
    for t, part in bars_pdf.groupby("ticker"):
        a = b = c = 0.0
        expected = []
        for rn, x in zip(part["rn"], part["close"]):
            a, b, c = 0.9 * a + x, 0.5 * b + (x if rn % 7 else 0.0), 0.99 * c + x
            expected.append((a, b, c))
        for k, name in enumerate("abc"):
            same(out[out.ticker == t][name], [e[k] for e in expected])


def test_chunks_too_large_for_the_weights_are_refused(bars):
    with pytest.raises(ValueError):
        decayed_states(Layout(4096).spread(bars), {"a": ("close", 0.5)}, Layout(4096))


def test_fill_carries_values_over_whole_empty_chunks(spark):
    n = 60
    rows = [("A", i, 1.0 * i if i in (5, 48) else None) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "ticker string, rn long, v double")
    for order, expect in (
        (("prev",), lambda i: None if i < 5 else (5.0 if i < 48 else 48.0)),
        (("prev", "next"), lambda i: 5.0 if i < 48 else 48.0),
        (("next", "prev"), lambda i: 5.0 if i <= 5 else 48.0),
    ):
        got = {r["rn"]: r["v"] for r in fill(df, ["v"], Layout(10), order).collect()}
        assert got == {i: expect(i) for i in range(1, n + 1)}


def test_running_sum_over_chunks(bars, bars_pdf):
    out = by_row(running_sum(bars, "volume", Layout(64), "total"), "total")
    same(out["total"], bars_pdf.groupby("ticker")["volume"].cumsum())


def test_tail_keeps_the_last_rows(bars):
    got = tail(bars, 30).groupBy("ticker").agg(F.min("rn").alias("a"), F.count("*").alias("n")).collect()
    assert {(r["a"], r["n"]) for r in got} == {(671, 30)}
