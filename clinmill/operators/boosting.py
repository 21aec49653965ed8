"""Gradient-boosted trees under Poisson loss, grown level by level from histograms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .passes import summed
from .select import quantiles


@dataclass
class Tree:
    """Nodes by number: the children of k are 2k + 1 and 2k + 2. A node without a feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray  # rows whose bin is at most this go left
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = 2 * at + 1 + (bins[inner, f[inner]] > self.cut[at])


@dataclass
class PoissonTrees:
    """A fitted model; transform adds `prediction`, the expected count."""

    edges: list[np.ndarray]
    base: float
    rate: float
    features: str
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of values (rows, features): how many edges lie below; missing values have the bin after the last."""
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), len(e) + 1, np.searchsorted(e, x[:, j], "left"))
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.value[t.leaf(bins)] for t in self.trees), np.zeros(len(bins)))

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(np.exp(self.raw(self.binned(np.stack(x.to_numpy())))) if len(x) else np.zeros(0))

        return df.withColumn("prediction", predict(vector_to_array(self.features)))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, cut) of a node's histograms (features, bins); of gains that agree to nine digits the first."""
    gl, hl, nl = (np.cumsum(z, 1)[:, :-1] for z in (g, h, n))
    gt, ht, nt = g.sum(1, keepdims=True), h.sum(1, keepdims=True), n.sum(1, keepdims=True)
    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
    gain = np.where((nl >= least) & (nt - nl >= least), gain, -np.inf)
    top = gain.max(initial=-np.inf)
    if not top > 1e-12:
        return 0.0, -1, 0
    f, cut = np.unravel_index(int(np.argmax(gain >= top * (1 - 1e-9))), gain.shape)
    return float(top), int(f), int(cut)


def fit_poisson_trees(train: DataFrame, target: str, features: str = "features", trees: int = 20, depth: int = 4, rate: float = 0.1, bins: int = 32, least: int = 20, l2: float = 1.0) -> PoissonTrees:
    """Trees on the logarithm of the expected count, as gradient boosting by second derivatives fits them.

    Features are cut at exact quantiles into at most `bins` bins (255 at most) once; binned rows are written and read in
    each pass, a batch of rows as one block. A pass grows one level: tasks sum the gradients (expected less counted), second derivatives (expected)
    and rows by node, feature and bin, the sums meet in a shuffle, and the driver takes each node's best cut. What
    it holds are histograms of 2 ** depth nodes, whatever the number of rows. Missing values have a bin of their own.
    Rows without a target are left out; a table without rows, or without counts above 0, gives the constant model."""
    x = train.select(vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y")).where("y is not null and x is not null")
    head = x.agg(F.max(F.size("x")).alias("d"), F.avg("y").alias("mean"), F.count("*").alias("n")).first()
    if not head["n"] or not head["mean"] > 0:
        return PoissonTrees([], float("-inf") if head["n"] else 0.0, rate, features)
    d, size = head["d"], min(bins, 255) + 1
    named = x.select("y", *(F.col("x")[j].alias(f"x{j}") for j in range(d)))
    cuts = quantiles(named, {f"x{j}": [k / (size - 1) for k in range(1, size - 1)] for j in range(d)})
    edges = [np.unique(np.array([v for v in cuts[f"x{j}"] if v is not None], float)) for j in range(d)]
    model = PoissonTrees(edges, float(np.log(head["mean"])), rate, features)

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = model.binned(np.stack(pdf["x"].to_numpy())) if len(pdf) else np.zeros((0, d), np.uint8)
            yield pd.DataFrame({"y": [pdf["y"].to_numpy(float).tobytes()], "b": [b.tobytes()]})

    rows = stored(x.mapInPandas(to_bins, "y binary, b binary"))
    offset = np.arange(d) * size
    for _ in range(trees):
        nodes = 2 ** (depth + 1) - 1
        tree = Tree(np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes))
        for level in range(depth + 1):
            first, wide = 2**level - 1, 2**level

            def step(pdf: pd.DataFrame, tree=tree, first=first, wide=wide) -> np.ndarray:
                b, y = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(-1, d), np.frombuffer(b"".join(pdf["y"]), float)
                mu = np.exp(model.raw(b))
                node = tree.leaf(b) - first
                here = np.flatnonzero(node >= 0)  # the others stopped above
                cell = (node[here, None] * (d * size) + offset + b[here]).ravel()
                each = [np.repeat(v[here], d) for v in (mu - y, mu)]
                return np.stack([*(np.bincount(cell, v, wide * d * size) for v in each), np.bincount(cell, minlength=wide * d * size).astype(float)]).ravel()

            g, h, n = summed(rows, step, 3 * wide * d * size).reshape(3, wide, d, size)
            for k in range(wide):
                if not n[k, 0].sum():
                    continue
                tree.value[first + k] = -g[k, 0].sum() / (h[k, 0].sum() + l2)
                if level < depth:
                    _, f, cut = best_split(g[k], h[k], n[k], least, l2)
                    tree.feature[first + k], tree.cut[first + k] = f, cut
            if level < depth and (tree.feature[first : first + wide] < 0).all():
                break
        model.trees.append(tree)
    return model
