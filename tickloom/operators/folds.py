"""Walk-forward folds over labelled rows, and scaling fitted on the training rows of a fold."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import KEY, ROW, Layout, div, number_rows
from tickloom.settings import Settings

FOLD = (KEY, "fold")


def labelled_rows(df: DataFrame, features: Sequence[str], layout: Layout = Layout(), target: str = "target") -> DataFrame:
    """Rows with every feature and a label, numbered anew per ticker (``rn``); the row
    number over all bars is kept as ``bar_rn``."""
    clean = df.withColumns({c: F.col(c).try_cast("double") for c in features}).dropna(subset=[*features, target])
    clean = clean.withColumnRenamed(ROW, "bar_rn")
    return number_rows(
        clean, F.expr(f"(bar_rn - 1) div {layout.chunk_rows}"), order="bar_rn",
        total="n_rows", previous={"prev_close": "close"},
    )


def last_fold(n_rows: Column, s: Settings, scheme: str) -> Column:
    """0-based number of the last fold that the rows of a ticker reach (negative: none), or of the last one allowed."""
    before, least = (s.train_rows, s.min_val) if scheme == "sliding" else (s.min_train, 1)
    last = F.floor((n_rows - before - least) / s.val_rows).cast("int")
    return last if s.n_splits is None else F.least(last, F.lit(s.n_splits - 1))


def fold_table(counts: DataFrame, s: Settings = Settings(), scheme: str = "sliding") -> DataFrame:
    """Row ranges of every fold: (ticker, fold, train_lo, train_hi, test_lo, test_hi), 0-based, half open.

    ``counts`` holds ``n_rows`` per ticker.
    """
    last = last_fold(F.col("n_rows"), s, scheme)
    df = counts.withColumn("i", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    i, n = F.col("i"), F.col("n_rows")
    if scheme == "sliding":
        lo, first = i * s.val_rows, 0
        hi, test_lo = lo + s.train_rows, lo + s.train_rows
        enough = s.min_val
    else:
        lo, first = F.lit(0), math.ceil(s.purge_rows / s.val_rows)
        test_lo = i * s.val_rows + s.min_train
        hi = test_lo - s.purge_rows
        enough = 1
    df = df.select(
        KEY, (i + 1 - first).cast("int").alias("fold"), lo.cast("long").alias("train_lo"), hi.cast("long").alias("train_hi"),
        test_lo.cast("long").alias("test_lo"), F.least(n, test_lo + s.val_rows).cast("long").alias("test_hi"),
    )
    return df.filter((F.col("fold") >= 1) & (F.col("test_hi") - F.col("test_lo") >= enough))


def fold_members(rows: DataFrame, s: Settings = Settings(), scheme: str = "sliding") -> DataFrame:
    """Every labelled row once per fold it belongs to, with ``role`` train or val.

    The folds of a row follow from its row number and the row count of its ticker
    (``n_rows``), so this is a projection and not a range join.
    """
    idx, last = F.col(ROW) - 1, last_fold(F.col("n_rows"), s, scheme)
    if scheme == "sliding":
        first, start = 0, s.train_rows
        from_ = F.greatest(F.lit(0), F.ceil((idx - s.train_rows + 1) / s.val_rows))
        to = F.least(last, F.floor(idx / s.val_rows))
        enough = s.min_val
    else:
        first, start = math.ceil(s.purge_rows / s.val_rows), s.min_train
        held_back = s.purge_rows + s.embargo_rows
        from_ = F.greatest(F.lit(first), F.floor((idx - s.min_train + held_back) / s.val_rows) + 1)
        to = last
        enough = 1
    train = F.when(from_ <= to, F.sequence(from_.cast("int"), to.cast("int")))
    val = F.floor((idx - start) / s.val_rows).cast("int")
    held = F.array_append(
        F.coalesce(F.transform(train, lambda i: F.struct(i.alias("i"), F.lit("train").alias("role"))),
                   F.expr("array()").cast("array<struct<i:int,role:string>>")),
        F.struct(val.alias("i"), F.lit("val").alias("role")),
    )
    out = rows.withColumn("_m", F.explode(held)).select("*", "_m.*").drop("_m")
    test_lo = F.col("i") * s.val_rows + start
    test_rows = F.least(F.col("n_rows"), test_lo + s.val_rows) - test_lo
    return (
        out.filter(F.col("i").between(F.lit(first), last) & (test_rows >= enough))
        .withColumn("fold", (F.col("i") + 1 - first).cast("int"))
        .drop("i")
    )


def with_reason(counts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Why a fold with these counts cannot be used (null when it can)."""
    return counts.select(*FOLD, "n_train", "n_val", "n_classes").withColumn(
        "reason",
        F.when(F.col("n_train") < s.min_train, "insufficient_train_size")
        .when(F.col("n_val") < s.min_val, "insufficient_validation_size")
        .when(F.col("n_classes") < 2, "single_validation_class"),
    )


def skip_reasons(members: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per fold: row counts, and why it cannot be used (null when it can)."""
    train, val = F.col("role") == "train", F.col("role") == "val"
    return with_reason(members.groupBy(*FOLD).agg(
        F.count_if(train).alias("n_train"),
        F.count_if(val).alias("n_val"),
        F.count_distinct(F.when(val, F.col("target"))).alias("n_classes"),
    ), s)


def expanding_statistics(rows: DataFrame, cols: Sequence[str] = (), s: Settings = Settings()) -> DataFrame:
    """Per (ticker, fold) of the purged scheme: n_train, n_sell, n_buy, and mean and population deviation of ``cols``
    (``mean_*``, ``std_*``) over the training rows.

    A training row is in one block, that of the first fold which has it, and a fold's training rows are the blocks
    up to its own.  So every row is aggregated once, and folds are running sums over one row per block.
    """
    first, held_back = math.ceil(s.purge_rows / s.val_rows), s.purge_rows + s.embargo_rows
    idx = F.col(ROW) - 1
    block = F.greatest(F.lit(first), F.floor((idx - s.min_train + held_back) / s.val_rows) + 1)
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    table = fold_table(counts, s, "purged").select(KEY, "fold", (F.col("fold") - 1 + first).cast("long").alias("_block"))
    # Squares are taken about the ticker's own first value, so that they keep their digits.
    origin = rows.filter(F.col(ROW) == 1).select(KEY, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_o_{c}") for c in cols])
    based = rows.join(origin, KEY, "left") if cols else rows
    shifted = {c: F.col(c) - F.coalesce(F.col(f"_o_{c}"), F.lit(0.0)) for c in cols}
    parts = based.groupBy(KEY, block.cast("long").alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("target") == 0).alias("_sell"), F.count_if(F.col("target") == 1).alias("_buy"),
        *[F.count(c).alias(f"_k_{c}") for c in cols], *[F.sum(x).alias(f"_s_{c}") for c, x in shifted.items()], *[F.sum(x * x).alias(f"_q_{c}") for c, x in shifted.items()])
    upto = Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    merged = table.join(parts, [KEY, "_block"], "left").select(
        KEY, "fold", total("_n").alias("n_train"), total("_sell").alias("n_sell"), total("_buy").alias("n_buy"),
        *[total(f"_{p}_{c}").alias(f"_{p}_{c}") for c in cols for p in "ksq"])
    if not cols:
        return merged
    out = merged.join(origin, KEY, "left")
    mean = {c: div(F.col(f"_s_{c}"), F.col(f"_k_{c}")) for c in cols}
    return out.select(
        KEY, "fold", "n_train", "n_sell", "n_buy", *[(mean[c] + F.col(f"_o_{c}")).alias(f"mean_{c}") for c in cols],
        *[F.sqrt(F.greatest(div(F.col(f"_q_{c}"), F.col(f"_k_{c}")) - mean[c] * mean[c], F.lit(0.0))).alias(f"std_{c}") for c in cols])


def expanding_skip_reasons(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``skip_reasons`` of the purged scheme from running sums, without a copy of a row per later fold."""
    first = math.ceil(s.purge_rows / s.val_rows)
    fold = F.floor((F.col(ROW) - 1 - s.min_train) / s.val_rows).cast("int") + 1 - first
    val = rows.filter(F.col(ROW) > s.min_train).groupBy(KEY, fold.alias("fold")).agg(
        F.count(F.lit(1)).alias("n_val"), F.count_distinct("target").alias("n_classes"))
    return with_reason(expanding_statistics(rows, (), s).select(KEY, "fold", "n_train").join(val, [KEY, "fold"]), s)


def expanding_class_weights(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``class_weights`` of the purged scheme from running sums."""
    return with_weight(expanding_statistics(rows, (), s).select(*FOLD, "n_sell", "n_buy"))


def rows_after_folds(rows: DataFrame, s: Settings = Settings(), scheme: str = "sliding") -> DataFrame:
    """Per ticker: labelled rows, folds, and the rows after the last fold (fewer than ``min_val`` unless limited)."""
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    ends = fold_table(counts, s, scheme).groupBy(KEY).agg(F.max("test_hi").alias("_hi"), F.count(F.lit(1)).alias("n_folds"))
    return counts.join(ends, KEY, "left").select(
        KEY, "n_rows", F.coalesce("n_folds", F.lit(0)).alias("n_folds"), (F.col("n_rows") - F.coalesce("_hi", F.lit(0))).alias("rows_after"))


def usable(members: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The members of folds that may be scored."""
    return members.join(skip_reasons(members, s).filter("reason is null").select(*FOLD), list(FOLD), "left_semi")


def class_weights(members: DataFrame) -> DataFrame:
    """Weight of the positive class per fold: 1.5 times negatives per positive, 1 with one class."""
    train = F.col("role") == "train"
    per_fold = members.groupBy(*FOLD).agg(
        F.count_if(train & (F.col("target") == 0)).alias("n_sell"),
        F.count_if(train & (F.col("target") == 1)).alias("n_buy"),
    )
    return with_weight(per_fold)


def with_weight(counts: DataFrame) -> DataFrame:
    both = (F.col("n_sell") > 0) & (F.col("n_buy") > 0)
    return counts.withColumn("pos_weight", F.when(both, 1.5 * div(F.col("n_sell"), F.col("n_buy"))).otherwise(1.0))


def on_train(value: Column) -> Column:
    return F.when(F.col("role") == "train", value)


def robust_scale(members: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - median) / interquartile range, both of the training rows of the fold.

    A fold is at most ``train_rows + val_rows`` rows, so exact percentiles over it are cheap;
    they are window values, which spares a second read of the rows for a join.
    """
    fold = Window.partitionBy(*FOLD)
    stats = {
        f"_q_{c}": F.percentile(on_train(F.col(c)), [0.25, 0.5, 0.75]).over(fold) for c in cols
    }
    out = members.withColumns(stats)
    scaled = {}
    for c in cols:
        q = F.col(f"_q_{c}")
        width = q[2] - q[0]
        scaled[c + suffix] = (F.col(c) - q[1]) / F.when(width == 0, 1.0).otherwise(width)
    return out.withColumns(scaled).drop(*stats)


def standard_scale(members: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation, both of the training rows of the fold."""
    fold = Window.partitionBy(*FOLD)
    scaled = {}
    for c in cols:
        sd = F.stddev_pop(on_train(F.col(c))).over(fold)
        scaled[c + suffix] = (F.col(c) - F.avg(on_train(F.col(c))).over(fold)) / F.when(sd == 0, 1.0).otherwise(sd)
    return members.withColumns(scaled)


def validation_rows(members: DataFrame) -> DataFrame:
    """Validation rows with the forward return ``ret`` (0 on the last row) and the volatility
    of the training rows (``train_vol_mean``, ``train_vol_std``)."""
    fold = Window.partitionBy(*FOLD)
    vol = on_train(F.col("volatility_20"))
    role = Window.partitionBy(*FOLD, "role").orderBy(ROW)
    return members.withColumns({
        "train_vol_mean": F.avg(vol).over(fold),
        "train_vol_std": F.stddev_pop(vol).over(fold),
        "n_train": F.count_if(F.col("role") == "train").over(fold),
        "ret": F.coalesce(div(F.lead("close").over(role), F.col("close")) - 1, F.lit(0.0)),
    }).filter(F.col("role") == "val").drop("role")
