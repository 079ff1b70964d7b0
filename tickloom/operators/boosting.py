"""Gradient-boosted trees on histograms, for all models of a run at once.

A model is what one combination of key columns names: a fold, a fold and a regime, a fold and a candidate
setting.  Features are cut at quantiles of the model's training rows once.  A tree grows level by level from
sums of gradients and Hessians per (model, node, feature, bin); gradients are whole numbers of 2**-20, so sums
do not depend on the order of rows and every layout of the data grows the same trees.  Penalties are L1
(``alpha``), L2 (``lam``) and the least gain of a split (``gamma``).  A model stops when the average precision
on its validation rows has not risen for ``patience`` trees, and keeps the trees up to its best.

Models of at most ``GROUP_ROWS`` rows are grown side by side, each in the group of its rows.  A model of more
rows is grown by the cluster: one aggregation per level over all rows of all such models.  Both use the same
gains and give the same trees; they come as a table with one row per (model, tree).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import KEY, ROW, div
from tickloom.operators.evaluation import average_precision

#: Rows up to which a model is grown in one task.
GROUP_ROWS = 200_000
#: Gradients are whole numbers of 1 / ONE.
ONE = float(1 << 20)
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class BoostSetting:
    depth: int = 6
    learning_rate: float = 0.02
    trees: int = 600
    rows: float = 0.85
    columns: float = 0.85
    leaf_weight: float = 2
    gamma: float = 0.2
    alpha: float = 0.2
    lam: float = 1.0
    max_step: float = 1.0
    patience: int = 50
    bins: int = 64


# --- what both ways of growing share -----------------------------------------------------------------

def _spread(x: np.ndarray | int) -> np.ndarray:
    x = np.atleast_1d(np.asarray(x, np.uint64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_rows(ids: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on: by row, tree and seed alone."""
    if share >= 1:
        return np.ones(len(ids), bool)
    drawn = _spread(ids.view(np.uint64) ^ _spread(np.uint64(seed * 1_000_003 + tree + 1)))
    return (drawn >> np.uint64(11)).astype(float) / float(1 << 53) < share


def sampled_columns(n: int, tree: int, seed: int, share: float) -> np.ndarray:
    """Which features a tree may use: at least one."""
    order = np.argsort(_spread(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _spread(np.uint64(seed * 7_919 + tree + 1))), kind="stable")
    chosen = np.zeros(n, bool)
    chosen[order[: max(1, int(share * n))]] = True
    return chosen


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return np.rint(w * (p - y) * ONE), np.rint(w * p * (1 - p) * ONE)


def leaf_value(g, h, s: BoostSetting):
    """Newton step of a leaf with L1 and L2 penalties, at most ``max_step``."""
    pulled = np.sign(g) * np.maximum(np.abs(g) - s.alpha, 0.0)
    step = -pulled / (h + s.lam)
    return np.clip(step, -s.max_step, s.max_step) if s.max_step > 0 else step


def leaf_score(g, h, s: BoostSetting):
    """What a leaf takes off the loss, twice."""
    w = leaf_value(g, h, s)
    return -(2 * g * w + (h + s.lam) * w * w) - 2 * s.alpha * np.abs(w)


def best_splits(g: np.ndarray, h: np.ndarray, s: BoostSetting, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best split of each node; feature -1 where none is worth it.

    ``g`` and ``h`` are sums in whole numbers, (nodes, features, bins).  A split sends bins up to ``bin`` to
    the left.  Of equal gains the first feature wins, then the lowest bin.
    """
    left_g, left_h = np.cumsum(g, axis=2) / ONE, np.cumsum(h, axis=2) / ONE
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = leaf_score(left_g, left_h, s) + leaf_score(right_g, right_h, s) - leaf_score(all_g, all_h, s)
    fits = (left_h >= s.leaf_weight) & (right_h >= s.leaf_weight) & allowed[None, :, None]
    gain = np.where(fits, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    best = flat[np.arange(len(flat)), at]
    good = (best > LEAST_GAIN) & (best >= s.gamma)
    return best, np.where(good, at // g.shape[2], -1), at % g.shape[2]


class Tree:
    """A tree in level order: node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, depth: int):
        n = (1 << (depth + 1)) - 1
        self.feature, self.bin = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.value, self.gain = np.zeros(n), np.zeros(n)

    def split(self, level: int, g: np.ndarray, h: np.ndarray, s: BoostSetting, allowed: np.ndarray) -> bool:
        """Splits the nodes of a level by their sums; whether any was split.  Values of the children follow."""
        first = (1 << level) - 1
        gain, feature, cut = best_splits(g, h, s, allowed)
        if level == 0:
            self.value[0] = leaf_value(g[0, 0].sum() / ONE, h[0, 0].sum() / ONE, s)
        k = np.flatnonzero(feature >= 0)
        if not len(k):
            return False
        node, f, b = first + k, feature[k], cut[k]
        self.feature[node], self.bin[node], self.gain[node] = f, b, gain[k]
        g, h = g[k, f], h[k, f]
        left = np.arange(g.shape[1]) <= b[:, None]
        left_g, left_h = (g * left).sum(axis=1) / ONE, (h * left).sum(axis=1) / ONE
        self.value[2 * node + 1] = leaf_value(left_g, left_h, s)
        self.value[2 * node + 2] = leaf_value(g.sum(axis=1) / ONE - left_g, h.sum(axis=1) / ONE - left_h, s)
        return True

    def step(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The next node of rows; rows in a leaf stay."""
        f = self.feature[node]
        inner = f >= 0
        right = codes[np.arange(len(codes)), np.maximum(f, 0)] > self.bin[node]
        return np.where(inner, 2 * node + 1 + right, node)

    def leaves(self, codes: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        for _ in range(depth):
            node = self.step(codes, node)
        return node


def histogram(codes: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums per (node, feature, bin); ``codes`` is (rows, features)."""
    n, features = codes.shape
    place = (node[:, None] * features + np.arange(features)) * bins + codes
    shape = (nodes, features, bins)
    flat = place.ravel()
    return tuple(np.bincount(flat, np.repeat(v, features), nodes * features * bins).reshape(shape) for v in (g, h))


def precision_of(score: np.ndarray, y: np.ndarray) -> float:
    """Average precision, ties together; nan without a positive."""
    if not len(y) or y.sum() == 0:
        return float("nan")
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    last = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    found = hits[last]
    step = np.diff(np.append(0.0, found))
    return float((step * found / (last + 1)).sum() / y.sum())


class Stop:
    """Follows a model's validation precision; without one no tree is better than another and all are kept."""

    def __init__(self, patience: int):
        self.patience, self.best, self.at, self.history = patience, -np.inf, -1, []

    def add(self, value: float) -> bool:
        """Whether the model goes on."""
        self.history.append(value)
        if np.isnan(value):
            return True
        if value > self.best:
            self.best, self.at = value, len(self.history) - 1
        return len(self.history) - 1 - self.at < self.patience

    @property
    def kept(self) -> int:
        return self.at + 1 if self.at >= 0 else len(self.history)


def base_margin(y: np.ndarray, w: np.ndarray) -> float:
    return _log_odds(float((w * y).sum()), float(w.sum()))


def _log_odds(positive: float, total: float) -> float:
    p = min(max(positive / total if total else 0.5, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


# --- the table of coded rows -------------------------------------------------------------------------

CODED = ("_id", "_y", "_w", "_train", "_codes")


def quantile_edges(rows: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int) -> dict[tuple, list[np.ndarray]]:
    """Cut points per model and feature from its training rows: one row of at most ``bins`` numbers a feature.

    The sketch is exact up to some ten thousand rows and within 1 / 10,000 of the ranks beyond.
    """
    shares = [k / bins for k in range(1, bins)]
    train = rows.filter(F.col("role") == "train")
    found = train.groupBy(*keys).agg(*[F.percentile_approx(c, shares, 10_000).alias(f"e{i}") for i, c in enumerate(features)])
    # One row per model on the driver: bins * features numbers, whatever the rows.
    return {tuple(r[k] for k in keys): [np.unique(np.array(r[f"e{i}"] or [], float)) for i in range(len(features))] for r in found.collect()}


def code_rows(rows: DataFrame, keys: Sequence[str], features: Sequence[str], edges: dict[tuple, list[np.ndarray]], ident: Sequence[str]) -> DataFrame:
    """(keys, _id, _y, _w, _train, _codes): a byte per feature, the number of cut points below the value."""
    source = rows.select(
        *keys, F.xxhash64(*ident).alias("_id"), F.col("target").cast("double").alias("_y"), F.col("weight").cast("double").alias("_w"),
        (F.col("role") == "train").alias("_train"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keys) + 4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            models = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys)))))
            codes = np.zeros(x.shape, np.uint8)
            for model in set(models):
                mine = np.fromiter((m == model for m in models), bool, len(models))
                for f, cuts in enumerate(edges[model]):
                    codes[mine, f] = np.searchsorted(cuts, x[mine, f], "left")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys) + 4], pa.array([c.tobytes() for c in codes], pa.binary())], [*keys, *CODED])

    return source.mapInArrow(run, f"{kinds}, _id long, _y double, _w double, _train boolean, _codes binary")


def _codes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)


# --- growing -----------------------------------------------------------------------------------------

TREES = "tree int, aucpr double, kept boolean, base double, feature array<int>, threshold array<double>, value array<double>, gain array<double>"


def _tree_rows(model: tuple, grown: list[Tree], stop: Stop, base: float, s: BoostSetting, edges: list[np.ndarray]) -> list[tuple]:
    out = []
    for t, tree in enumerate(grown):
        cut = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature.tolist(), tree.bin.tolist())]
        value = stop.history[t]
        out.append((*model, t, None if np.isnan(value) else float(value), t < stop.kept, base, tree.feature.tolist(), cut,
                    (s.learning_rate * tree.value).tolist(), tree.gain.tolist()))
    return out


def grow(codes: np.ndarray, ids: np.ndarray, y: np.ndarray, w: np.ndarray, train: np.ndarray, s: BoostSetting, seed: int) -> tuple[list[Tree], Stop, float]:
    """All trees of one model in memory."""
    base = base_margin(y[train], w[train])
    margin, stop, grown = np.full(len(y), base), Stop(s.patience), []
    learn, learn_ids = np.flatnonzero(train), ids[train]
    held = np.flatnonzero(~train)
    for t in range(s.trees):
        tree, allowed = Tree(s.depth), sampled_columns(codes.shape[1], t, seed, s.columns)
        picked = learn[sampled_rows(learn_ids, t, seed, s.rows)]
        g, h = gradients(margin[picked], y[picked], w[picked])
        own, node = codes[picked], np.zeros(len(picked), np.int64)
        for level in range(s.depth):
            first = (1 << level) - 1
            live = node >= first
            sums = histogram(own[live], node[live] - first, g[live], h[live], 1 << level, s.bins)
            if not tree.split(level, *sums, s, allowed):
                break
            node = tree.step(own, node)
        margin = margin + s.learning_rate * tree.value[tree.leaves(codes, s.depth)]
        grown.append(tree)
        if not stop.add(precision_of(margin[held], y[held])):
            break
    return grown, stop, base


def _grow_groups(coded: DataFrame, keys: Sequence[str], edge_keys: int, width: int, edges: dict, settings: dict, seed: int, models: int) -> DataFrame:
    kinds = ", ".join(f"{k} {coded.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, "tree", "aucpr", "kept", "base", "feature", "threshold", "value", "gain"]

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        model = tuple(k.item() if hasattr(k, "item") else k for k in key)
        s = settings[model[-1]] if len(model) > edge_keys else settings[None]
        codes = np.frombuffer(b"".join(frame["_codes"]), np.uint8).reshape(-1, width).astype(np.int64)
        ids, y, w = frame["_id"].to_numpy(np.int64), frame["_y"].to_numpy(float), frame["_w"].to_numpy(float)
        grown, stop, base = grow(codes, ids, y, w, frame["_train"].to_numpy(bool), s, seed)
        return pd.DataFrame(_tree_rows(model, grown, stop, base, s, edges[model[:edge_keys]]), columns=columns)

    return spread_groups(coded, keys, models).groupBy(*keys).applyInPandas(fit, f"{kinds}, {TREES}")


def spread_groups(rows: DataFrame, keys: Sequence[str], groups: int) -> DataFrame:
    """Rows dealt by the keys into several times as many partitions as there are groups.

    Growing a model costs far more than its bytes suggest, so the number of partitions is stated; otherwise small
    ones are put together and their models wait for each other.
    """
    return rows.repartition(max(1, min(4 * groups, 10_000)), *keys)


def level_sums(state: DataFrame, keys: Sequence[str], trees: dict[tuple, Tree], settings: Callable, level: int, tree_no: int, seed: int, width: int) -> DataFrame:
    """(keys, node, feature, bin, g, h): the sums of one level of all models that still grow."""
    kinds = ", ".join(f"{k} {state.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame[frame["_train"].to_numpy(bool)]
            for model, part in frame.groupby(list(keys), sort=False):
                model = tuple(k.item() if hasattr(k, "item") else k for k in model)
                if model not in trees:
                    continue
                s, tree = settings(model), trees[model]
                part = part[sampled_rows(part["_id"].to_numpy(np.int64), tree_no, seed, s.rows)]
                if not len(part):
                    continue
                codes, first = _codes(pa.array(part["_codes"]), width), (1 << level) - 1
                node = tree.leaves(codes, level)
                live = node >= first
                g, h = gradients(part["_margin"].to_numpy(float), part["_y"].to_numpy(float), part["_w"].to_numpy(float))
                sums = histogram(codes[live], node[live] - first, g[live], h[live], 1 << level, s.bins)
                k, f, b = np.nonzero((sums[0] != 0) | (sums[1] != 0))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v] * len(k)).cast(batch.schema.field(c).type) for c, v in zip(keys, model)), pa.array(k.astype(np.int32)),
                     pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[0][k, f, b].astype(np.int64)), pa.array(sums[1][k, f, b].astype(np.int64))],
                    [*keys, "node", "feature", "bin", "g", "h"])

    partial = state.mapInArrow(run, f"{kinds}, node int, feature int, bin int, g long, h long")
    return partial.groupBy(*keys, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _grow_by_levels(coded: DataFrame, keys: Sequence[str], edge_keys: int, width: int, edges: dict, settings: dict, seed: int,
                    keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same trees for models of any size: rows stay where they are, sums of a level are aggregated.

    The driver holds the trees and, level by level, the sums of the nodes; margins are a written table per tree.
    """
    spark = coded.sparkSession
    setting = lambda m: settings[m[-1]] if len(m) > edge_keys else settings[None]
    totals = coded.filter("_train").groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_y")).alias("p"), F.sum("_w").alias("n"))
    base = {tuple(r[k] for k in keys): _log_odds(r["p"], r["n"]) for r in totals.collect()}
    grown, stops = {m: [] for m in base}, {m: Stop(setting(m).patience) for m in base}
    going, kinds = set(base), ", ".join(f"{k} {coded.schema[k].dataType.simpleString()}" for k in keys)
    state_kind = f"{kinds}, _id long, _y double, _w double, _train boolean, _codes binary, _margin double"

    def moved(rows: DataFrame, change: Callable[[tuple, np.ndarray], np.ndarray], fresh: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                frame = batch.to_pandas()
                margin = np.zeros(len(frame)) if fresh else frame["_margin"].to_numpy(float).copy()
                for model, part in frame.groupby(list(keys), sort=False).indices.items():
                    model = model if isinstance(model, tuple) else (model,)
                    model = tuple(k.item() if hasattr(k, "item") else k for k in model)
                    margin[part] += change(model, _codes(pa.array(frame["_codes"].iloc[part]), width))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys) + 5], pa.array(margin)], [*keys, *CODED, "_margin"])

        return keep(rows.mapInArrow(run, state_kind), "margins")

    state = moved(coded, lambda m, codes: np.full(len(codes), base[m]), True)
    tree_no = 0
    while going:
        going = {m for m in going if tree_no < setting(m).trees}
        if not going:
            break
        trees = {m: Tree(setting(m).depth) for m in going}
        open_models = set(going)
        for level in range(max(setting(m).depth for m in going)):
            live = {m: trees[m] for m in open_models if level < setting(m).depth}
            if not live:
                break
            sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            # At most nodes * features * bins rows a model.
            for r in level_sums(state, keys, live, setting, level, tree_no, seed, width).collect():
                m = tuple(r[k] for k in keys)
                if m not in sums:
                    sums[m] = tuple(np.zeros((1 << level, width, setting(m).bins)) for _ in range(2))
                sums[m][0][r["node"], r["feature"], r["bin"]] = r["g"]
                sums[m][1][r["node"], r["feature"], r["bin"]] = r["h"]
            open_models = {m for m in live if m in sums and trees[m].split(
                level, *sums[m], setting(m), sampled_columns(width, tree_no, seed, setting(m).columns))}
        state = moved(state, lambda m, codes: (
            setting(m).learning_rate * trees[m].value[trees[m].leaves(codes, setting(m).depth)] if m in trees else np.zeros(len(codes))), False)
        held = average_precision(state.filter("not _train"), list(keys), "_margin", "_y")
        value = {tuple(r[k] for k in keys): r["aucpr"] for r in held.collect()}  # one row per model
        for m in list(going):
            grown[m].append(trees[m])
            v = value.get(m)
            if not stops[m].add(float("nan") if v is None else v):
                going.discard(m)
        tree_no += 1
    rows = [row for m in base for row in _tree_rows(m, grown[m], stops[m], base[m], setting(m), edges[m[:edge_keys]])]
    return spark.createDataFrame(rows, f"{kinds}, {TREES}")


def fit(
    rows: DataFrame, features: Sequence[str], keep: Callable[[DataFrame, str], DataFrame], keys: Sequence[str] = ("fold",),
    settings: Sequence[BoostSetting] = (BoostSetting(),), numbers: Sequence[int] | None = None, seed: int = 42,
    ident: Sequence[str] = (KEY, ROW), group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The trees of every model: (keys[, candidate], tree, aucpr, kept, base, feature, threshold, value, gain).

    ``rows`` holds the keys, ``ident`` (which tells the rows of a model apart), the features, ``target`` (0 or
    1), ``weight`` and ``role`` (train, else validation).  With ``numbers`` there is one model per number and
    key, ``settings[k]`` being that of ``numbers[k]``, and ``candidate`` is the number; else the first setting
    is that of all.  ``keep`` writes a frame and reads it back.  Rows of a tree are drawn by hash, so the same
    rows and seed give the same trees.  A model whose training rows have one class gives one leaf a tree.
    """
    bins = {s.bins for s in settings}
    if len(bins) != 1 or not 2 <= max(bins) <= 256:
        raise ValueError("all settings need the same number of bins, 2 to 256")
    edges = quantile_edges(rows, keys, features, max(bins))
    trained = rows
    coded = code_rows(trained, keys, features, edges, ident)
    counts = {tuple(r[k] for k in keys): r["count"] for r in rows.groupBy(*keys).count().collect()}  # one row per model
    if not edges:
        kinds = ", ".join(f"{k} {coded.schema[k].dataType.simpleString()}" for k in keys) + (", candidate int" if numbers is not None else "")
        return coded.sparkSession.createDataFrame([], f"{kinds}, {TREES}")
    own_keys, of = list(keys), {None: settings[0]}
    if numbers is not None:
        coded = coded.withColumn("candidate", F.explode(F.array(*[F.lit(int(n)) for n in numbers])))
        coded = coded.select(*keys, "candidate", *CODED)
        own_keys, of = [*keys, "candidate"], {int(n): s for n, s in zip(numbers, settings, strict=True)}
    width = len(features)
    known = [k for k in counts if k in edges]
    large = [k for k in known if counts[k] > group_rows]

    def chosen(models: list[tuple]) -> Column:
        tests = [F.struct(*[F.lit(v) for v in m]) for m in models]
        return F.struct(*[F.col(k) for k in keys]).isin(tests) if tests else F.lit(False)

    parts = []
    if len(large) < len(known):
        small = coded.filter(~chosen(large)) if large else coded
        parts.append(_grow_groups(small, own_keys, len(keys), width, edges, of, seed, (len(known) - len(large)) * len(of)))
    if large:
        parts.append(_grow_by_levels(keep(coded.filter(chosen(large)), "coded"), own_keys, len(keys), width, edges, of, seed, keep))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# --- using the trees ---------------------------------------------------------------------------------

def score(
    rows: DataFrame, trees: DataFrame, features: Sequence[str], keys: Sequence[str] = ("fold",), out: str = "p_model", slices: int = 1,
) -> DataFrame:
    """Rows with the probability of their model (null without one); the trees that a model kept count.

    ``slices`` deals the rows of a model to so many tasks, each with its trees.
    """
    kept = trees.filter("kept").select(*keys, F.struct("tree", "base", "feature", "threshold", "value").alias("t"))
    models = kept.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("_trees"))
    models = models.withColumn("_slice", F.explode(F.array(*[F.lit(k) for k in range(slices)])))
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(c) for c in features]), F.lit(slices)).cast("int"))
    group = [*keys, "_slice"]
    names = list(features)

    def apply(frame: pa.Table, found: pa.Table) -> pa.Table:
        x = np.stack([frame.column(c).to_numpy().astype(float) for c in names], axis=1) if frame.num_rows else np.zeros((0, len(names)))
        p = [None] * frame.num_rows
        if found.num_rows:
            margin = None
            for t in found.column("_trees")[0].as_py():
                if margin is None:
                    margin = np.full(len(x), t["base"])
                feature, cut, value = np.array(t["feature"]), np.array(t["threshold"]), np.array(t["value"])
                node, row = np.zeros(len(x), np.int64), np.arange(len(x))
                for _ in range(int(np.log2(len(feature) + 1)) - 1):
                    f = feature[node]
                    node = np.where(f >= 0, 2 * node + 1 + (x[row, np.maximum(f, 0)] > cut[node]), node)
                margin = margin + value[node]
            p = 1 / (1 + np.exp(-margin))
        return frame.drop_columns(["_slice"]).append_column(out, pa.array(p, pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return cut.groupBy(*group).cogroup(models.groupBy(*group)).applyInArrow(apply, f"{kinds}, {out} double")


def split_gains(sums: DataFrame, keys: Sequence[str], s: BoostSetting) -> DataFrame:
    """(keys, node, feature, bin, gain) of every split that leaves enough weight on both sides, from ``level_sums``."""
    cell = [*keys, "node", "feature"]
    upto = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*cell)

    def side(g: Column, h: Column) -> Column:
        pulled = F.signum(g) * F.greatest(F.abs(g) - s.alpha, F.lit(0.0))
        w = -pulled / (h + s.lam)
        w = F.least(F.greatest(w, F.lit(-s.max_step)), F.lit(s.max_step)) if s.max_step > 0 else w
        return -(2 * g * w + (h + s.lam) * w * w) - 2 * s.alpha * F.abs(w)

    rows = sums.withColumns({
        "_gl": F.sum("g").over(upto) / ONE, "_hl": F.sum("h").over(upto) / ONE, "_g": F.sum("g").over(whole) / ONE, "_h": F.sum("h").over(whole) / ONE})
    gl, hl, g, h = (F.col(c) for c in ("_gl", "_hl", "_g", "_h"))
    return rows.filter((hl >= s.leaf_weight) & (h - hl >= s.leaf_weight)).select(
        *cell, "bin", (side(gl, hl) + side(g - gl, h - hl) - side(g, h)).alias("gain"))


def root_gains(rows: DataFrame, features: Sequence[str], s: BoostSetting, keys: Sequence[str] = ("fold",), seed: int = 42, ident: Sequence[str] = (KEY, ROW)) -> DataFrame:
    """(keys, node, feature, bin, gain) of every split of every model's first tree at the root."""
    edges = quantile_edges(rows, keys, features, s.bins)
    train = F.col("role") == "train"
    base = rows.filter(train).groupBy(*keys).agg(F.sum(F.col("weight") * F.col("target")).alias("_p"), F.sum("weight").alias("_n"))
    margins = {tuple(r[k] for k in keys): _log_odds(r["_p"], r["_n"]) for r in base.collect()}  # one row per model
    spark = rows.sparkSession
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", _margin double"
    table = spark.createDataFrame([(*k, v) for k, v in margins.items()], kinds)
    state = code_rows(rows.filter(train), keys, features, edges, ident).join(table, list(keys))
    sums = level_sums(state, keys, {m: Tree(s.depth) for m in margins}, lambda m: s, 0, 0, seed, len(features))
    return split_gains(sums, keys, s)


def importance(trees: DataFrame, features: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(keys, feature, importance): the mean gain of a feature's splits as a share of all features' means."""
    nodes = trees.filter("kept").select(*keys, F.explode(F.arrays_zip("feature", "gain")).alias("n")).filter("n.feature >= 0")
    means = nodes.groupBy(*keys, F.col("n.feature").alias("_f")).agg(F.avg("n.gain").alias("_mean"))
    names = F.array(*[F.lit(c) for c in features])
    every = trees.select(*keys).distinct().withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    whole = Window.partitionBy(*keys)
    both = every.join(means, [*keys, "_f"], "left").withColumn("_mean", F.coalesce("_mean", F.lit(0.0)))
    return both.select(*keys, F.element_at(names, F.col("_f") + 1).alias("feature"), F.coalesce(div(F.col("_mean"), F.sum("_mean").over(whole)), F.lit(0.0)).alias("importance"))
