"""Ordered computations over one series per ticker, split into bounded chunks.

A ticker can be long, so no window here is partitioned by the ticker alone.
Rows carry a row number ``rn`` (1-based, per ticker) and are laid out in chunks
of ``chunk_rows`` rows.  Computations with a bounded look-back or look-ahead run
on (ticker, chunk) after the rows next to a chunk edge were copied into the
neighbouring chunk; computations with an unbounded look-back (row numbers,
running totals, last known value) add a carry taken from a small table with one
row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME, ROW, CHUNK = "ticker", "date", "rn", "chunk"


@dataclass(frozen=True)
class Layout:
    """How the rows of a ticker are split over tasks."""

    chunk_rows: int = 4096

    def spread(self, df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """Add ``chunk`` and copy edge rows into the neighbours; ``core`` marks originals."""
        if max(before, after) > self.chunk_rows:
            raise ValueError(f"look-back {before} / look-ahead {after} exceeds chunk of {self.chunk_rows} rows")
        home = F.expr(f"cast(({ROW} - 1) div {self.chunk_rows} as int)")
        pos = (F.col(ROW) - 1) % self.chunk_rows
        homes = [home]
        if before:
            homes.append(F.when(pos >= self.chunk_rows - before, home + 1))
        if after:
            homes.append(F.when((pos < after) & (home > 0), home - 1))
        if CHUNK in df.columns:
            df = df.drop(CHUNK)
        out = df.select("*", F.explode(F.array_compact(F.array(*homes))).alias(CHUNK)).withColumn(
            "core", F.col(CHUNK) == home
        )
        if before or after:
            # Window features cost far more time per byte than the size-based merging of
            # shuffle partitions assumes, so the number of partitions is stated here.
            out = out.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, CHUNK)
        return out

    @staticmethod
    def window() -> WindowSpec:
        return Window.partitionBy(KEY, CHUNK).orderBy(ROW)

    @staticmethod
    def core(df: DataFrame) -> DataFrame:
        return df.filter("core").drop("core", CHUNK)


# --- expressions over Layout.window() ---------------------------------------------------

def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def roll(fn: Callable[[Column], Column], value: Column, n: int, w: WindowSpec) -> Column:
    """``fn`` over the last ``n`` rows, null until all ``n`` values are present."""
    frame = trailing(w, n)
    return F.when(F.count(value).over(frame) == n, fn(value).over(frame))


def looked_up(name: str, block: int, times: int, w: WindowSpec) -> Column:
    """Array of a column's value now and ``block``, ``2 * block``, ... rows back.

    A sliding frame visits all its rows again for each row.  Long frames are put
    together from a short one looked up every ``block`` rows; keep this array in
    a column of its own and hand its name to the ``long_*`` functions.
    """
    return F.array(F.col(name), *[F.lag(name, k * block).over(w) for k in range(1, times)])


def _add(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def long_mean(parts: str, times: int) -> Column:
    """Mean over all parts, from the mean of each; null while a part is missing."""
    return _add([F.col(parts)[k] for k in range(times)]) / times


def long_extreme(fn: Callable[..., Column], parts: str, times: int) -> Column:
    """Greatest/least over all parts, from that of each; null while a part is missing."""
    items = [F.col(parts)[k] for k in range(times)]
    return F.when(_add(items).isNotNull(), fn(*items))


def long_stddev(means: str, variances: str, mean: Column, block: int, times: int) -> Column:
    """Sample deviation over all parts, from mean and population variance of each part."""
    spread = _add([F.col(variances)[k] + F.pow(F.col(means)[k] - mean, 2) for k in range(times)]) * block
    return F.sqrt(spread / (block * times - 1))


def div(a: Column, b: Column) -> Column:
    """Division giving null for a zero divisor (plain ``/`` raises in ANSI mode)."""
    return F.try_divide(a, b)


def clip(value: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(value.isNotNull(), F.least(F.greatest(value, lo), hi))


def pct_change(value: Column, w: WindowSpec, n: int = 1) -> Column:
    return div(value, F.lag(value, n).over(w)) - 1


def memory_rows(decay: float) -> int:
    """Rows after which a weight ``decay**rows`` is below the rounding of a double."""
    return math.ceil(60 * math.log(2) / -math.log(decay))


def decayed_states(df: DataFrame, states: Mapping[str, tuple[str, float]], layout: Layout) -> DataFrame:
    """Adds the state of ``s = decay * s + value`` for each ``name: (value column, decay)``, started from 0
    on the ticker's first row; nulls add nothing.  Takes rows of ``Layout.spread``.

    Inside a chunk it is a running sum of ``value / decay**position`` scaled back by
    ``decay**position``: one cumulative window, no row loop.  The state of the chunks before comes
    from a small table with one end state per chunk, folded over as many chunks as a double can
    tell from 0.  So the state is exact over any distance and does not depend on the chunk size;
    on rows that were copied from a neighbour it is not meant to be read.
    """
    size = layout.chunk_rows
    for _, decay in states.values():
        if size / 2 * -math.log10(decay) > 280:
            raise ValueError(f"weights of decay {decay} leave the double range in chunks of {size} rows")
    pos = F.col(ROW) - 1 - F.col(CHUNK) * size
    own = {name: F.when(F.col("core"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0) for name, (c, _) in states.items()}
    ends = df.groupBy(KEY, CHUNK).agg(*[
        F.sum(own[name] * F.pow(F.lit(decay), F.greatest(size - 1 - pos, F.lit(0)))).alias(f"_end_{name}")
        for name, (_, decay) in states.items()
    ])
    earlier = Window.partitionBy(KEY).orderBy(CHUNK)

    def carry(name: str, decay: float) -> Column:
        chunks = math.ceil(745 / (size * -math.log(decay))) + 1
        past = F.collect_list(f"_end_{name}").over(earlier.rowsBetween(-chunks, -1))
        return F.aggregate(past, F.lit(0.0), lambda state, end: state * decay ** size + end).alias(f"_carry_{name}")

    carries = ends.select(KEY, CHUNK, *[carry(name, decay) for name, (_, decay) in states.items()])
    # Positions are taken from the middle of the chunk, which halves the range of the weights.
    place = pos - size // 2
    past = Layout.window().rowsBetween(Window.unboundedPreceding, 0)
    return df.join(carries, [KEY, CHUNK]).withColumns({
        name: F.sum(own[name] * F.pow(F.lit(decay), -place)).over(past) * F.pow(F.lit(decay), place)
        + F.col(f"_carry_{name}") * F.pow(F.lit(decay), pos + 1)
        for name, (_, decay) in states.items()
    }).drop(*[f"_carry_{name}" for name in states])


def ema_decay(n: int) -> float:
    return 1 - 2.0 / (n + 1)


def ema_step(value: Column, n: int, w: WindowSpec, first_row: int = 1) -> Column:
    """Input of an exponential mean of span ``n`` seeded with the plain mean of the first ``n`` rows:
    nothing, then that mean, then the shares.

    It holds a window itself, so put it in a column of its own first.
    """
    seed_row = first_row + n - 1
    return (
        F.when(F.col(ROW) == seed_row, F.avg(value).over(trailing(w, n)))
        .when(F.col(ROW) > seed_row, value * (2.0 / (n + 1)))
        .otherwise(F.lit(0.0))
    )


def from_row(row: int, value: Column) -> Column:
    return F.when(F.col(ROW) >= row, value)


# --- unbounded look-back: a carry per chunk -----------------------------------------------

def carry_in(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: str,
    counts: str | None = None,
    total: str | None = None,
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    nexts: Sequence[str] = (),
) -> DataFrame:
    """What each chunk needs from the chunks before (or after) it.

    One row per (keys, chunk): ``counts`` the rows before it, ``total`` all rows of the key, ``sums`` the total
    before it, ``lasts`` the last known value before it and ``nexts`` the first
    known value after it.  The window runs over the per-chunk summary only.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(c).alias(f"_s_{c}") for c in sums]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in lasts]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_f_{c}") for c in nexts]
    w = Window.partitionBy(*keys).orderBy(chunk)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    out = []
    if counts:
        out.append(F.coalesce(F.sum("_n").over(back), F.lit(0)).alias(counts))
    if total:
        out.append(F.sum("_n").over(Window.partitionBy(*keys)).alias(total))
    out += [F.coalesce(F.sum(f"_s_{c}").over(back), F.lit(0.0)).alias(f"{c}_before") for c in sums]
    out += [F.last(f"_l_{c}", True).over(back).alias(f"{c}_before") for c in lasts]
    out += [F.first(f"_f_{c}", True).over(ahead).alias(f"{c}_after") for c in nexts]
    return df.groupBy(*keys, chunk).agg(*aggs).select(*keys, chunk, *out)


def number_rows(
    df: DataFrame, bucket: Column, keys: Sequence[str] = (KEY,), order: str = TIME, name: str = ROW,
    total: str | None = None, filled: Mapping[str, str] | None = None, previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Row number per key in two steps: inside a bucket, plus the rows of earlier buckets.

    ``bucket`` must grow with ``order`` (a year, a range of another row number).  On the same
    pass ``total`` names a column for the rows of the key, ``filled`` maps new columns to those
    whose last known value they carry forward, and ``previous`` maps new columns to those whose
    value of the row before they hold.
    """
    filled, previous = filled or {}, previous or {}
    keyed = df.withColumn("_bucket", bucket)
    sources = list(dict.fromkeys([*filled.values(), *previous.values()]))
    carry = carry_in(keyed, keys, "_bucket", order, counts="_before", total=total, lasts=sources)
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    local = {name: F.row_number().over(w)}
    local |= {new: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for new, c in filled.items()}
    local |= {new: F.lag(c).over(w) for new, c in previous.items()}
    out = keyed.withColumns(local).join(carry, [*keys, "_bucket"]).withColumns({
        name: (F.col(name) + F.col("_before")).cast("long"),
        **{new: F.coalesce(F.col(new), F.col(f"{c}_before")) for new, c in {**filled, **previous}.items()},
    })
    return out.drop("_bucket", "_before", *[f"{c}_before" for c in sources])


def fill(df: DataFrame, cols: Sequence[str], layout: Layout, order: Sequence[str] = ("prev",)) -> DataFrame:
    """Replace nulls by the previous and/or next known value, tried in ``order``.

    Exact over any gap: a chunk without a known value takes it from the nearest
    chunk that has one.
    """
    spread = layout.spread(df).drop("core")
    prev, nxt = "prev" in order, "next" in order
    carry = carry_in(spread, [KEY], CHUNK, ROW, lasts=cols if prev else (), nexts=cols if nxt else ())
    w = Layout.window()
    past, coming = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    local = [F.last(c, True).over(past).alias(f"{c}_prev") for c in cols if prev]
    local += [F.first(c, True).over(coming).alias(f"{c}_next") for c in cols if nxt]
    far = {"prev": "before", "next": "after"}
    filled = {
        c: F.coalesce(*[F.col(f"{c}_{side}") for way in order for side in (way, far[way])]) for c in cols
    }
    return spread.select("*", *local).join(carry, [KEY, CHUNK]).withColumns(filled).select(*df.columns)


def running_sum(df: DataFrame, col: str, layout: Layout, name: str) -> DataFrame:
    """Running total per ticker of any length: total inside the chunk plus the chunks before."""
    spread = layout.spread(df).drop("core")
    carry = carry_in(spread, [KEY], CHUNK, ROW, sums=[col])
    past = Layout.window().rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("_local", F.sum(col).over(past))
        .join(carry, [KEY, CHUNK])
        .withColumn(name, F.col("_local") + F.col(f"{col}_before"))
        .drop("_local", f"{col}_before", CHUNK)
    )


def tail(df: DataFrame, n: int, keys: Sequence[str] = (KEY,), order: str = ROW) -> DataFrame:
    """Last ``n`` rows per key, cut from the count per key instead of a sort."""
    last = df.groupBy(*keys).agg(F.max(order).alias("_last"))
    return df.join(last, list(keys)).filter(F.col(order) > F.col("_last") - n).drop("_last")
