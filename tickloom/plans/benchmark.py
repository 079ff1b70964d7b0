"""A grid of settings over the whole panel in one job, and the run log made from it.

Every run is scored by a fitted model.  A fold has one linear discriminant per encoder and seed: least squares
of the target on the model's columns over the training rows that the seed draws, from the covariances of one
aggregation for all folds.  Its scores are calibrated per model on the last part of the training rows, by the
method that the candidate names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import KEY, ROW, div, number_rows
from tickloom.operators import backtest, calibration, folds, runlog, selection, sequences, signals
from tickloom.plans.market import SCORED, Market
from tickloom.settings import BENCHMARK_SEEDS, Settings

# Id, target coverage, trade ratio floor, lowest and highest threshold,
# calibration method, percentile of the default candidates.
CANDIDATES = (
    ("c1_balanced_sigmoid", 0.16, 0.09, 0.60, 0.64, "sigmoid", 70),
    ("c2_run23_like", 0.18, 0.10, 0.58, 0.64, "isotonic", 70),
    ("c3_run23_like_sigmoid", 0.18, 0.10, 0.58, 0.64, "sigmoid", 70),
    ("c4_conservative_mid", 0.14, 0.08, 0.62, 0.66, "sigmoid", 72),
    ("c5_safer_isotonic", 0.15, 0.08, 0.61, 0.65, "isotonic", 72),
    ("c6_more_selective", 0.13, 0.08, 0.63, 0.67, "sigmoid", 74),
)
CANDIDATE_FIELDS = (
    "id", "target_coverage", "trade_ratio_floor", "conservative_th_min", "conservative_th_max", "calibration_method",
    "conservative_percentile_threshold",
)
# Columns of the linear models per encoder: without one, and with causal means of the latest returns.
ENCODERS = {"off": ("price_to_sma20_scaled", "distance_to_ma200_scaled"), "tcn": ("price_to_sma20_scaled", "distance_to_ma200_scaled", "causal_return")}
SEEDS = BENCHMARK_SEEDS
# Share of the training rows, in thousandths, that a seed draws; digits of coefficients and scores, so that engines agree.
DRAWN, DIGITS = 850, 6
MODEL = ("fold", "encoder_mode", "seed")
# Features that a run may use, and the correlation with the outcome below which one counts as weak.
USED, WEAK = ("volatility_20", "price_to_sma20", "distance_to_ma200", "price_to_sma20_scaled", "distance_to_ma200_scaled"), 0.05
RUN = ("candidate_id", "encoder_mode", "seed", "ticker")
PERCENTS = (70.0, 72.0, 74.0)


def candidates(spark) -> DataFrame:
    """The default candidates as rows the optimizer knows to be few."""
    rows = [F.struct(*[F.lit(v).alias(f) for f, v in zip(CANDIDATE_FIELDS, c)]) for c in CANDIDATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rounded(value: Column, digits: int = DIGITS) -> Column:
    return F.round(value + float(f"3.7e-{digits + 2}"), digits) + 0.0


def drawn(seed: Column) -> Column:
    """Whether a seed draws a training row: whole-number arithmetic on ticker, row and seed."""
    code = F.ascii("ticker") * 31 + F.ascii(F.substring("ticker", 2, 1)) * 17
    return F.pmod(F.col("rn") * 7919 + seed * 104729 + code, F.lit(1000)) < DRAWN


def strength(feature: str, target: str = "target") -> Column:
    """Size of the correlation over the rows that have both values: NaN, as in SQL, when one of them does not vary,
    null without rows (``corr`` raises in ANSI mode)."""
    both = F.col(feature).isNotNull() & F.col(target).isNotNull()
    x, y = (F.when(both, F.col(c)) for c in (feature, target))
    r = div(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when(F.count(x) > 0, F.round(F.abs(F.coalesce(r, F.lit(float("nan")))), 6))


def coefficients(train: DataFrame) -> DataFrame:
    """(fold, seed, encoder_mode, b0, b1, b2, b3) of the least-squares models of all folds, encoders and seeds."""
    columns = ENCODERS["tcn"]
    rows = train.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in SEEDS]))).filter(drawn(F.col("seed")))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    m = rows.groupBy("fold", "seed").agg(
        F.avg("target").alias("my"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}{j}") for i, j in pairs], *[F.covar_pop(c, "target").alias(f"d{i}") for i, c in enumerate(columns)])
    c = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    d = lambda i: F.col(f"d{i}")

    def det(a: list[list[Column]]) -> Column:
        if len(a) == 2:
            return a[0][0] * a[1][1] - a[0][1] * a[1][0]
        minor = lambda k: det([[x for j, x in enumerate(row) if j != k] for row in a[1:]])
        return a[0][0] * minor(0) - a[0][1] * minor(1) + a[0][2] * minor(2)

    def solved(n: int) -> list[Column]:
        """Slopes by Cramer's rule; 0 where columns depend on each other."""
        whole = det([[c(i, j) for j in range(n)] for i in range(n)])
        return [rounded(F.coalesce(div(det([[d(i) if j == k else c(i, j) for j in range(n)] for i in range(n)]), F.when(F.abs(whole) > 1e-18, whole)), F.lit(0.0))) for k in range(n)]

    parts = []
    for mode, used in ENCODERS.items():
        slopes = solved(len(used)) + [F.lit(0.0)] * (3 - len(used))
        parts.append(F.struct(F.lit(mode).alias("encoder_mode"), *[b.alias(f"b{k + 1}") for k, b in enumerate(slopes)]))
    out = m.withColumn("_m", F.explode(F.array(*parts))).select("fold", "seed", "my", "m0", "m1", "m2", "_m.*")
    b0 = F.col("my") - F.col("b1") * F.col("m0") - F.col("b2") * F.col("m1") - F.col("b3") * F.col("m2")
    return out.select("fold", "seed", "encoder_mode", rounded(b0).alias("b0"), "b1", "b2", "b3")


def model_scores(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows once per model with ``p_model``: the logistic curve that is tangent to the linear model at one half."""
    x1, x2, x3 = (F.col(c) for c in ENCODERS["tcn"])
    linear = F.col("b0") + F.col("b1") * x1 + F.col("b2") * x2 + F.col("b3") * x3
    return rows.join(found, "fold").withColumn("p_model", rounded(1 / (1 + F.exp(-4 * (linear - 0.5))))).drop("b0", "b1", "b2", "b3")


def setting_grid(scores: DataFrame) -> DataFrame:
    """Every scored validation row once per candidate: a projection with an array of constants, no join."""
    settings = [
        F.struct(
            F.lit(c[0]).alias("candidate_id"), F.lit(2 * i).alias("setting_no"), F.lit(c[1]).alias("target_coverage"),
            F.lit(c[2]).alias("trade_ratio_floor"), F.lit(c[3]).alias("th_min"), F.lit(c[4]).alias("th_max"),
            F.lit(c[5]).alias("calibration_method"), F.lit(float(c[6])).alias("percentile"),
        )
        for i, c in enumerate(CANDIDATES)
    ]
    rows = scores.withColumn("_s", F.explode(F.array(*settings))).select("*", "_s.*").drop("_s")
    p = F.when(F.col("calibration_method") == "isotonic", F.col("p_isotonic")).otherwise(F.col("p_sigmoid"))
    return rows.withColumn("p_raw", F.coalesce(p, F.col("p_model"))).withColumn("setting_no", F.col("setting_no") + (F.col("encoder_mode") == "tcn").cast("int")).drop(
        "p_isotonic", "p_sigmoid", "p_model", "calibration_method")


def grid_results(scores: DataFrame, s: Settings = Settings()) -> DataFrame:
    keys = [*RUN, "fold"]
    # Calibrated scores repeat, so ties must not hang on the last bits of a deviation.
    adjusted = signals.volatility_weighted(setting_grid(scores), keys).withColumn("p", F.round("p", 10))
    thresholds = signals.fold_thresholds(adjusted, keys, s)
    sized = signals.open_positions(adjusted, thresholds, keys, s, PERCENTS)
    return backtest.fold_results(sized, keys, s)


class Benchmark:
    def __init__(self, market: Market):
        self.market = market

    def training_members(self) -> DataFrame:
        """Scaled rows of the usable folds with the causal mean of returns."""
        m = self.market

        def build() -> DataFrame:
            causal = sequences.causal_means(m.sequence_inputs(), layout=m.layout).select(KEY, F.col(ROW).alias("bar_rn"), "causal_return")
            return folds.robust_scale(folds.usable(m.members()), SCORED, "_scaled").join(causal, [KEY, "bar_rn"])

        return m.stages.table("grid_members", m.payload(), build)

    def models(self) -> DataFrame:
        m = self.market
        return m.stages.table("grid_models", m.payload(), lambda: coefficients(self.training_members().filter("role = 'train'")))

    def scores(self) -> DataFrame:
        """Validation rows of every model with p_model, p_isotonic and p_sigmoid."""
        m, keys = self.market, list(MODEL)

        def held() -> DataFrame:
            rows = calibration.calibration_rows(self.training_members().filter("role = 'train'"))
            return calibration.by_score(model_scores(rows, self.models()), keys, "p_model")

        def build() -> DataFrame:
            counts = m.stages.table("grid_held", m.payload(), held)
            curves = calibration.sigmoid(counts, keys).withColumns({"slope": rounded(F.col("slope")), "offset": rounded(F.col("offset"))})
            val = folds.validation_rows(self.training_members())
            scored = calibration.apply_sigmoid(model_scores(val, self.models()), curves, keys, "p_model")
            scored = calibration.apply_isotonic(scored, calibration.isotonic(counts, keys), keys, "p_model")
            return scored.withColumns({"p_isotonic": rounded(F.col("p_isotonic")), "p_sigmoid": rounded(F.col("p_sigmoid"))})

        return m.stages.table("grid_scores", m.payload(), build)

    def fold_results(self) -> DataFrame:
        m = self.market
        return m.stages.table("grid_results", m.payload(grid=1), lambda: grid_results(self.scores()))

    def runs(self) -> DataFrame:
        """One row per (candidate, encoder, seed, ticker) with the score of the run."""
        # A run without a valid fold has nothing to score or to log.
        flat = backtest.cross_fold_metrics(self.fold_results(), RUN).filter("n_folds_valid > 0").withColumns({
            "cv_folds_valid": F.col("n_folds_valid"), "cv_folds_configured": F.col("n_folds_configured"),
        })
        return selection.score_runs(flat.withColumn("run_number", F.col("seed").cast("long")))

    def records(self) -> DataFrame:
        """Nested log records of all runs."""
        m = self.market
        return m.stages.table("run_records", m.payload(grid=1), self._records)

    def _records(self) -> DataFrame:
        runs = self.runs().drop("run_number")
        number = {c[0]: i for i, c in enumerate(CANDIDATES)}
        setting = F.coalesce(*[F.when(F.col("candidate_id") == c, n) for c, n in number.items()])
        seed = F.array_position(F.array(*[F.lit(x) for x in SEEDS]), F.col("seed")) - 1
        setting = (2 * setting + (F.col("encoder_mode") == "tcn").cast("int")) * len(SEEDS) + seed
        # Numbered by setting and ticker.  A bucket holds one setting and a range of ticker numbers, so
        # no task sees all runs: tickers are numbered by themselves, over buckets of their first letters' codes.
        names = runs.select("ticker").distinct()
        names = number_rows(names, F.ascii("ticker") * 65536 + F.ascii(F.substring("ticker", 2, 1)), keys=(), order="ticker", name="ticker_no")
        runs = runs.withColumn("setting_no", setting.cast("long")).join(names, "ticker")
        bucket = F.col("setting_no") * 1_000_000 + F.expr("ticker_no div 1000")
        runs = number_rows(runs, bucket, keys=(), order="ticker_no", name="run_number")
        grid = setting_grid(self.scores())
        counts = signals.signal_counts(grid, RUN)
        # Weak features are measured on the rows that the run would rather buy.
        liked = grid.filter(F.col("p_raw") >= 0.5)
        measured = liked.groupBy(*RUN).agg(*[strength(f).alias(f"_c_{f}") for f in USED], F.max("date").alias("run_date"))
        weak = [F.coalesce(F.col(f"_c_{f}") < WEAK, F.lit(True)) for f in USED]
        runs = runs.join(counts, list(RUN)).join(measured, list(RUN), "left").withColumns({
            "features_used": F.array_compact(F.array(*[F.when(~w, F.lit(f)) for f, w in zip(USED, weak)])),
            "removed_by_importance": F.array_compact(F.array(*[F.when(w, F.lit(f)) for f, w in zip(USED, weak)])),
            "seq_encoder": F.col("encoder_mode"),
            "notes": F.concat_ws(" ", "candidate_id", "encoder_mode"),
        })
        return runlog.run_records(runs)
