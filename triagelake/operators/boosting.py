"""Boosted trees with a Poisson loss on histograms, for one model or for one a fold at once.

Features are binned once, a byte each, and written with a score a model. A level of a tree is one pass: every task sums counts, gradients and
Hessians by (model, node, feature, bin) for its rows, the sums are added up by a shuffle, and the driver gets no more than models * nodes * features *
256 of them, however many rows there are. Missing values have a bin of their own, which each split sends to its better side.
Scores are stored anew every `REFRESH` trees; in between a pass adds up the trees since then.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators import scans
from triagelake.sources.records import written

#: Bins of a feature, the one of missing values (0) among them; trees between two writes of the scores; raw scores lie within +-LIMIT.
BINS, REFRESH, LIMIT = 256, 8, 30.0
_HELD = -1


@dataclass
class Tree:
    """Nodes by number, 0 the root. A node with feature -1 is a leaf; rows with 0 < bin <= cut go left, bin 0 where missing_left says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, feature: int, cut: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, leaf in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1)):
            column += [leaf, leaf]
        self.value += list(values)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows * features)."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, missing, left, right = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            code = bins[rows, feature[node]]
            at[rows] = np.where(np.where(code == 0, missing[node], code <= cut[node]), left[node], right[node])
        return at


@dataclass(frozen=True)
class Boosted:
    """A fitted model: features, the upper edges of their bins, and trees over the bins."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    base: float
    trees: tuple[Tree, ...]

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return np.clip(self.base + sum((np.array(t.value)[t.nodes(bins)] for t in self.trees), np.zeros(len(bins))), -LIMIT, LIMIT)


def binned(edges: Sequence[np.ndarray], columns: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (rows * features): 0 for missing values, 1 for those up to the first edge, and so on."""
    return np.stack([np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x)).astype(np.uint8) for e, x in zip(edges, columns, strict=True)], 1)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> tuple[np.ndarray, ...]:
    """Upper edges by quantiles, at most bins - 2 a feature: one aggregate over the rows, of bounded size."""
    at = [i / (bins - 2) for i in range(1, bins - 2)]
    found = df.agg(*(F.percentile_approx(_number(c), at, 10 * bins).alias(f"f{i}") for i, c in enumerate(features))).first()
    return tuple(np.unique(np.array(q if q is not None else [0.0], float)) for q in found)


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _stored(df: DataFrame, features: Sequence[str], label: str, fold: Column, held: Column, edges: Sequence[np.ndarray], bases: list[float]) -> DataFrame:
    """(y, fold, held, bins, scores), written."""

    def binning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))]
            codes = binned(edges, columns) if len(batch) else np.zeros((0, len(features)), np.uint8)
            rows = pa.array([r.tobytes() for r in codes], pa.binary())
            scores = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(bases), pa.array(np.tile(np.array(bases, float), len(batch))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("y", "fold", "held")), rows, scores], names=["y", "fold", "held", "bins", "scores"])

    rows = df.select(F.col(label).cast("double").alias("y"), fold.cast("int").alias("fold"), held.alias("held"), *(_number(c).alias(f"f{i}") for i, c in enumerate(features)))
    return written(rows.filter("y IS NOT NULL").mapInArrow(binning, "y double, fold int, held boolean, bins binary, scores array<double>"))


def _unpacked(batch: pa.RecordBatch, n_features: int, pending: Sequence[Sequence[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    """Bins, and scores with the trees that are not in them yet."""
    flat = batch.column("bins")
    start, end = flat.offset, flat.offset + len(flat)
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[start : end + 1]
    bins = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, n_features)
    scores = np.array(batch.column("scores").flatten()).reshape(len(batch), len(pending)).copy()
    for k, trees in enumerate(pending):
        for tree in trees:
            scores[:, k] += np.array(tree.value)[tree.nodes(bins)]
    return bins, np.clip(scores, -LIMIT, LIMIT)


def _sums(rows: DataFrame, n_features: int, pending: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]]) -> pd.DataFrame:
    """Sums (model, node, at, n, g, h) over the rows that a model trains on, at being feature * BINS + bin; and, as node _HELD, rows held out and their loss."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros((3, len(nodes) * n_features * BINS)) for k, nodes in enumerate(open_nodes)}
        loss = np.zeros((len(pending), 2))
        for batch in batches:
            bins, scores = _unpacked(batch, n_features, pending)
            y, fold, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "held"))
            held = held.astype(bool)
            for k, nodes in enumerate(open_nodes):
                mine = fold != k
                test = mine & held
                loss[k] += test.sum(), (np.exp(scores[test, k]) - y[test] * scores[test, k]).sum()
                place = np.full(len(growing[k].feature), -1)
                place[nodes] = np.arange(len(nodes))
                slot = place[growing[k].nodes(bins)]
                use = mine & ~held & (slot >= 0)
                mean, first, codes = np.exp(scores[use, k]), slot[use] * BINS, np.ascontiguousarray(bins[use].T)
                # A feature's sums are counted on their own: the bins of its nodes, not those of all features.
                for f in range(n_features if nodes else 0):
                    for i, weight in enumerate((None, mean - y[use], mean)):
                        found = np.bincount(first + codes[f], weight, minlength=len(nodes) * BINS)
                        total[k][i].reshape(len(nodes), n_features, BINS)[:, f] += found.reshape(len(nodes), BINS)
        for k, (n, g, h) in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"model": k, "node": np.array(open_nodes[k], np.int64)[at // (n_features * BINS)], "at": at % (n_features * BINS), "n": n[at], "g": g[at], "h": h[at]})
            yield pd.DataFrame({"model": [k], "node": [_HELD], "at": [0], "n": [loss[k][0]], "g": [loss[k][1]], "h": [0.0]})

    def from_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in summed(batches):
            yield pa.RecordBatch.from_pandas(frame.astype({"model": "int32", "node": "int32", "at": "int32", "n": "float64"}), preserve_index=False)

    schema = "model int, node int, at int, n double, g double, h double"
    return rows.mapInArrow(from_arrow, schema).groupBy("model", "node", "at").agg(*(F.sum(c).alias(c) for c in "ngh")).toPandas()


@dataclass(frozen=True)
class Settings:
    """trees at most, of at most 2 ** depth leaves with min_leaf rows or more each. With `patience`, a share of 1 in `held_one_in` rows is held out, and a
    model stops after so many trees that don't lower its loss there by `tolerance`; the trees up to the best stay."""

    trees: int = 100
    depth: int = 5
    rate: float = 0.05
    l2: float = 1.0
    min_leaf: int = 20
    patience: int = 0
    tolerance: float = 1e-7
    held_one_in: int = 7


def best_split(n: np.ndarray, g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing_left) from sums (features * BINS) of a node, of equal gains (to nine digits) the first by feature, cut, missing right."""
    total = [x[0].sum() for x in (n, g, h)]
    score = lambda gg, hh: gg * gg / (hh + settings.l2 + 1e-12)
    gains = np.full((len(n), BINS, 2), -np.inf)
    for side in (0, 1):
        left = [np.cumsum(x[:, 1:], 1) + (x[:, :1] if side else 0) for x in (n, g, h)]
        right = [t - x for t, x in zip(total, left, strict=True)]
        ok = (left[0] >= settings.min_leaf) & (right[0] >= settings.min_leaf)
        gains[:, 1:, side] = np.where(ok, score(left[1], left[2]) + score(right[1], right[2]) - score(total[1], total[2]), -np.inf)
    most = gains.max(initial=-np.inf)
    if not most > 1e-10:
        return None
    f, cut, side = np.unravel_index(int(np.argmax(gains >= most * (1 - 1e-9))), gains.shape)
    return float(most), int(f), int(cut), bool(side)


def fit(df: DataFrame, features: Sequence[str], label: str, *, settings: Settings = Settings(), folds: int = 0, fold: str | None = None, key: Sequence[str] = (), edges: Sequence[np.ndarray] | None = None) -> list[Boosted]:
    """A model of all rows; or, with `folds` and the column `fold`, one for each fold k, which rows of fold k have no part in.

    Null and NaN features are missing values; rows with a null label have no part; without rows, or where all labels are 0, predictions are next to 0. `key` names
    the columns by whose hash rows are held out.
    """
    n_models, settings_ = folds or 1, settings
    of = F.col(fold) if folds else F.lit(-1)
    held = (F.pmod(F.xxhash64(F.lit("held"), *key), F.lit(settings.held_one_in)) == 0) if settings.patience else F.lit(False)
    edges = tuple(edges) if edges is not None else bin_edges(df, features)
    sums = {r["f"]: r for r in df.filter(F.col(label).isNotNull() & ~held).groupBy(of.cast("int").alias("f")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n")).collect()}
    of_model = [[r for f, r in sums.items() if f != k or not folds] for k in range(n_models)]
    bases = [float(np.log(max(sum(r["y"] for r in rs) / max(sum(r["n"] for r in rs), 1), 1e-9))) for rs in of_model]
    rows = _stored(df, features, label, of, held, edges, bases)

    trees: list[list[Tree]] = [[] for _ in range(n_models)]
    stored, best, live = [0] * n_models, [(np.inf, 0)] * n_models, set(range(n_models))
    for number in range(settings.trees):
        growing, open_nodes = [Tree() for _ in range(n_models)], [[0] if k in live else [] for k in range(n_models)]
        for level in range(settings.depth):
            if not any(open_nodes):
                break
            pending = [t[s:] for t, s in zip(trees, stored, strict=True)]
            found = _sums(rows, len(features), pending, growing, open_nodes)
            if level == 0 and settings.patience:
                for k in [*live]:
                    own = found[(found["model"] == k) & (found["node"] == _HELD)]
                    loss = float(own["g"].sum() / max(own["n"].sum(), 1))
                    if loss < best[k][0] - settings.tolerance:
                        best[k] = (loss, number)
                    elif number - best[k][1] >= settings.patience:
                        live.discard(k)
                        open_nodes[k] = []
            below: list[list[int]] = [[] for _ in range(n_models)]
            for k, nodes in enumerate(open_nodes):
                for node in nodes:
                    own = found[(found["model"] == k) & (found["node"] == node)]
                    n, g, h = (_grid(own, c, len(features)) for c in "ngh")
                    split = best_split(n, g, h, settings_)
                    if split is None:
                        continue
                    _, f, cut, side = split
                    ls = [x[f, 1 : cut + 1].sum() + (x[f, 0] if side else 0) for x in (g, h)]
                    rs = [x[f].sum() - y for x, y in zip((g, h), ls, strict=True)]
                    values = tuple(-settings.rate * a / (b + settings.l2 + 1e-12) for a, b in (ls, rs))
                    below[k] += growing[k].grow(node, f, cut, side, values)
            open_nodes = below
        grown = [len(t.feature) > 1 for t in growing]
        for k in [*live]:
            if grown[k]:
                trees[k].append(growing[k])
            else:
                live.discard(k)
        if not live:
            break
        if (number + 1) % REFRESH == 0 and number + 1 < settings.trees:
            rows, stored = _rescored(rows, len(features), [t[s:] for t, s in zip(trees, stored, strict=True)]), [len(t) for t in trees]
    keep = [best[k][1] if settings.patience and best[k][0] < np.inf and k not in live else len(trees[k]) for k in range(n_models)]
    return [Boosted(tuple(features), edges, base, tuple(t[:m])) for base, t, m in zip(bases, trees, keep, strict=True)]


def _grid(own: pd.DataFrame, column: str, n_features: int) -> np.ndarray:
    out = np.zeros(n_features * BINS)
    out[own["at"].to_numpy()] = own[column].to_numpy()
    return out.reshape(n_features, BINS)


def _rescored(rows: DataFrame, n_features: int, pending: list[list[Tree]]) -> DataFrame:
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, scores = _unpacked(batch, n_features, pending)
            lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(pending), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("y", "fold", "held", "bins")), lists], names=batch.schema.names)

    return written(rows.mapInArrow(added, rows.schema))


def predict(df: DataFrame, models: Sequence[Boosted], name: str, fold: str | None = None) -> DataFrame:
    """Adds the expected value: by the only model, or by that of the row's fold (null where there is none)."""
    features = models[0].features

    @F.pandas_udf("double")
    def expected(of: pd.Series, *columns: pd.Series) -> pd.Series:
        out = np.full(len(of), np.nan)
        codes = binned(models[0].edges, [c.to_numpy(float) for c in columns]) if len(of) else np.zeros((0, len(features)), np.uint8)
        for k, model in enumerate(models):
            mine = (of == k).to_numpy()
            out[mine] = np.exp(model.raw(codes[mine]))
        return pd.Series(out).where(~np.isnan(out), None)

    return df.withColumn(name, expected(F.coalesce(F.col(fold), F.lit(-1)) if fold else F.lit(0), *(_number(c) for c in features)))


def permuted_folds(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """(group, fold): groups in an order of their own for each seed, dealt to folds in turn, so that folds differ by one group at most. Null is a group."""
    groups = df.select(group).distinct()
    dealt = scans.running(groups.withColumn("__h", F.xxhash64(F.lit(seed), F.coalesce(F.col(group).cast("string"), F.lit("")))), [], ["__h", group], {"__i": F.lit(1)})
    return dealt.select(group, ((F.col("__i") - 1) % folds).cast("int").alias("fold"))


def cross_fitted(df: DataFrame, features: Sequence[str], label: str, group: str, name: str, *, folds: int = 5, seed: int = 0, settings: Settings = Settings(), key: Sequence[str] = ()) -> DataFrame:
    """Adds fold and the expected value by the model that no row of the fold had a part in: no group is scored by a model that saw it."""
    table = permuted_folds(df, group, folds, seed)
    split = written(df.join(table.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g"))
    return predict(split, fit(split, features, label, settings=settings, folds=folds, fold="fold", key=key), name, "fold")
