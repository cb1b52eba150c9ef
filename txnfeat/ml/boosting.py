"""Gradient-boosted trees on histograms, with nulls and categories as they are.

Values become bins once: numbers by quantiles, categories one bin each, nulls a bin of their own. A tree grows level by level;
each level is one pass over the bins, in which every task sums gradients and second derivatives by (node, feature, bin),
and those sums meet in a shuffle on (node, feature). A split's candidates are the running sums of its bins: numbers in
their order, categories by their gradient's ratio, each with the nulls on the left and on the right, so nulls take the side that
fits the label. The driver gets one row for each node of a level.

Sums are integers, of gradients rounded to 2^-20, so they don't depend on how rows lie in tasks, and a fit on a cluster equals
one on a laptop. The state of boosting are the trees alone: a pass computes where its rows are from the bins, so a lost
task needs nothing but the table of bins. Each REFRESH trees the rows' sums of leaves are written with the bins anew."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder, ship

#: Bins of a column without that of its nulls: a bin is one byte.
MOST_BINS = 254
UNIT = float(1 << 20)
REFRESH = 25


@dataclass
class Options:
    trees: int = 100
    rate: float = 0.05
    depth: int = 5
    bins: int = MOST_BINS
    ridge: float = 1.0
    least_rows: int = 20
    least_hessian: float = 1e-3
    #: Added to a category's second derivatives where categories are put in order.
    smooth: float = 10.0


@dataclass
class Bins:
    """For each column the upper borders of its bins but the last, or its categories by frequency."""

    numeric: list[str]
    strings: list[str]
    borders: list[list[float]] = field(default_factory=list)
    categories: list[list[str]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.strings]

    def missing(self) -> list[int]:
        """The bin of each column's nulls; the others are below it."""
        return [len(b) + 1 for b in self.borders] + [len(c) for c in self.categories]

    def codes(self, columns: list) -> np.ndarray:
        """Rows of bins of the columns (numbers as floats with NaN, strings as objects). Categories not seen before count as nulls."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for i, (x, none) in enumerate(zip(columns, self.missing(), strict=True)):
            if i < len(self.numeric):
                x = np.asarray(x, float)
                out[:, i] = np.where(np.isnan(x), none, np.searchsorted(self.borders[i], x, side="left"))
            else:
                place = {c: k for k, c in enumerate(self.categories[i - len(self.numeric)])}
                out[:, i] = [place.get(v, none) for v in x]
        return out


def find_bins(df: DataFrame, numeric: list[str], strings: list[str], most: int = MOST_BINS) -> Bins:
    """Quantiles of all numbers in one aggregation, and the `most` most frequent categories of each string (ties by name)."""
    b = Bins(numeric, strings)
    if numeric:
        at = F.array(*(F.lit(i / most) for i in range(1, most)))
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0)
        row = df.agg(*(F.struct(F.percentile_approx(value(c), at, 100 * most).alias("q"), F.max(value(c)).alias("top")).alias(f"c{i}") for i, c in enumerate(numeric))).first()
        b.borders = [sorted({x for x in r["q"] or () if x < r["top"]}) for r in row]
    if strings:
        one = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(strings)))).alias("e")).select("e.*").where("v is not null")
        place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
        found = one.groupBy("i", "v").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= most).orderBy("i", "place").collect()
        b.categories = [[r["v"] for r in found if r["i"] == i] for i in range(len(strings))]
    return b


@dataclass
class Tree:
    """Nodes in the order of growth. A leaf has feature -1; `left` are the bins that go to the first child, the other follows it."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left: list[list[int]] = field(default_factory=lambda: [[]])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The node of each row."""
        node = np.zeros(len(codes), np.int64)
        table = np.zeros((len(self.feature), 256), bool)
        for i, bins in enumerate(self.left):
            table[i, bins] = True
        feature, child, rows = np.array(self.feature), np.array(self.child), np.arange(len(codes))
        while len(rows):
            f = feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            at = node[rows]
            node[rows] = child[at] + ~table[at, codes[rows, f]]
        return node

    def split(self, node: int, feature: int, left: list[int], values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.left[node], self.child[node] = feature, left, len(self.feature)
        for v in values:
            for column, x in ((self.feature, -1), (self.left, []), (self.child, 0), (self.value, v)):
                column.append(x)
        return self.child[node], self.child[node] + 1


def _margin(trees: list[Tree], codes: np.ndarray, start: np.ndarray | float) -> np.ndarray:
    out = np.full(len(codes), start) if np.isscalar(start) else start.copy()
    for t in trees:
        out += np.array(t.value)[t.places(codes)]
    return out


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def histograms(table: DataFrame, trees: list[Tree], tree: Tree, nodes: list[int], width: int) -> DataFrame:
    """node, feature, bin, g, h (in units of 2^-20), n: sums over the rows of each of the tree's nodes, after the other trees.

    table: label, weight, margin, codes."""
    sent = table.sparkSession.sparkContext.broadcast((trees, tree, nodes))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, tree, nodes = sent.value
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        sums = np.zeros((3, width, len(nodes) * 256), np.int64)
        for b in batches:
            codes = _codes(b.column(3), width)
            y, w, margin = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3))
            at = place[tree.places(codes)]
            codes, y, w, at, margin = (x[at >= 0] for x in (codes, y, w, at, _margin(trees, codes, margin)))
            p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            g, h = np.rint((p - y) * w * UNIT), np.rint(p * (1 - p) * w * UNIT)
            for i in range(width):
                key = at * 256 + codes[:, i]
                # Sums of whole numbers below 2^53 are exact in doubles.
                for k, x in enumerate((g, h, None)):
                    sums[k, i] += np.bincount(key, x, len(nodes) * 256).astype(np.int64)
        feature, key = np.nonzero(sums[2])
        named = np.array(nodes)[key // 256].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (named, feature.astype(np.int32), (key % 256).astype(np.int32), *sums[:, feature, key])], names=["node", "feature", "bin", "g", "h", "n"])

    parts = table.mapInArrow(f, "node int, feature int, bin int, g long, h long, n long")
    # Dealt by node and feature, so neither the sums by bin nor the running sums are shuffled again.
    return parts.repartition("node", "feature").groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))


def candidates(sums: DataFrame, missing: list[int], categorical: int, o: Options) -> DataFrame:
    """node, feature, bin, missing_left, gain, the bins on the left, and g, h, n of both sides of each allowed split.

    Features from `categorical` on are categories. Those with the nulls on either side differ even where there are none."""
    none = F.get(F.array(*(F.lit(m) for m in missing)), F.col("feature"))
    order = F.when(F.col("feature") >= categorical, F.col("g") / (F.col("h") + F.lit(o.smooth * UNIT))).otherwise(F.col("bin").cast("double"))
    rows = sums.withColumns({"absent": F.col("bin") == none, "place": order})
    whole = Window.partitionBy("node", "feature")
    so_far = whole.orderBy("absent", "place", "bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{c}_{k}": x for c in "ghn" for k, x in (("l", F.sum(c).over(so_far)), ("m", F.sum(F.when(F.col("absent"), F.col(c)).otherwise(0)).over(whole)), ("t", F.sum(c).over(whole)))} | {"bins": F.collect_list("bin").over(so_far)})
    rows = rows.where("not absent").withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    left = {c: F.col(f"{c}_l") + F.when(F.col("missing_left"), F.col(f"{c}_m")).otherwise(0) for c in "ghn"}
    rows = rows.withColumns({f"{c}_l": x for c, x in left.items()}).withColumns({f"{c}_r": F.col(f"{c}_t") - F.col(f"{c}_l") for c in "ghn"})
    score = lambda k: (F.col(f"g_{k}") / F.lit(UNIT)) * (F.col(f"g_{k}") / F.lit(UNIT)) / (F.col(f"h_{k}") / F.lit(UNIT) + F.lit(o.ridge))
    allowed = (F.least("n_l", "n_r") >= o.least_rows) & (F.least("h_l", "h_r") >= o.least_hessian * UNIT)
    bins = F.when(F.col("missing_left"), F.concat("bins", F.array(none))).otherwise(F.col("bins"))
    return rows.where(allowed).select("node", "feature", "bin", "missing_left", (score("l") + score("r") - score("t")).alias("gain"), bins.alias("left"), *(f"{c}_{k}" for k in "lr" for c in "ghn"))


def best(splits: DataFrame, *by: str) -> DataFrame:
    """Of each node (or other columns) the candidate with the highest gain; ties: the first feature, nulls left, the fewest rows left, the least bin."""
    rank = F.struct("gain", (-F.col("feature")).alias("f"), "missing_left", (-F.col("n_l")).alias("n"), (-F.col("bin")).alias("b"))
    return splits.groupBy(*by).agg(F.max_by(F.struct(*splits.columns), rank).alias("s")).select("s.*")


@dataclass
class Boosted:
    """The fitted trees; `start` is the log-odds of the rows' mean label."""

    bins: Bins
    trees: list[Tree]
    start: float

    def probability(self) -> Column:
        """Of label 1, as a column over the features of the frame that it is used on."""
        model = self

        @F.pandas_udf("double")
        def p(*columns: pd.Series) -> pd.Series:
            codes = model.bins.codes([c.to_numpy(dtype=float, na_value=np.nan) if i < len(model.bins.numeric) else c.to_numpy() for i, c in enumerate(columns)])
            return pd.Series(1 / (1 + np.exp(-np.clip(_margin(model.trees, codes, model.start), -35, 35))))

        return p(*(F.col(c).cast("double") for c in self.bins.numeric), *(F.col(c) for c in self.bins.strings))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Boosted:
        return cls(Bins(**d["bins"]), [Tree(**t) for t in d["trees"]], d["start"])


def binned(rows: DataFrame, b: Bins, label: str, weight: str, start: float) -> DataFrame:
    """label, weight, margin and codes (a byte for each column) of each row, as a table in the shared folder."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) if i < len(b.numeric) else c.to_pylist() for i, c in enumerate(batch.columns[2:])]
            codes = b.codes(columns)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.full(len(codes), start)), pa.array([r.tobytes() for r in codes], pa.binary())], names=["label", "weight", "margin", "codes"])

    made = rows.select(F.col(label).cast("double"), F.col(weight).cast("double"), *(F.col(c).cast("double") for c in b.numeric), *b.strings)
    return _table(made.mapInArrow(f, "label double, weight double, margin double, codes binary"))


def _table(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "boosted")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _moved(table: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The table with the trees' leaves added to its margins."""
    sent = table.sparkSession.sparkContext.broadcast(trees)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margin = _margin(sent.value, _codes(b.column(3), width), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(margin), b.column(3)], names=b.schema.names)

    return _table(table.mapInArrow(f, table.schema))


def boost(rows: DataFrame, numeric: list[str], strings: list[str], label: str, weight: str, options: Options | None = None) -> Boosted:
    """Fits the trees to rows with label 0 or 1 (others are left out) and a weight.

    A null, and NaN, is a value of its own; a category beyond the most frequent ones counts as null. Without rows, without
    both labels, or where no split is allowed, the model is the mean."""
    o = options or Options()
    ship(rows.sparkSession)
    rows = rows.where(F.col(label).isin(0, 1))
    ones, every = rows.agg(F.sum(F.col(weight) * F.col(label)), F.sum(F.col(weight))).first()
    share = min(max((ones or 0.0) / every, 1e-9), 1 - 1e-9) if every else 0.5
    start = math.log(share / (1 - share))
    b = find_bins(rows, numeric, strings, o.bins)
    if not every or not b.names:
        return Boosted(b, [], start)
    table, done, trees, width = binned(rows, b, label, weight, start), 0, [], len(b.names)
    for _ in range(o.trees):
        tree, nodes = Tree(), [0]
        for _level in range(o.depth):
            sums = histograms(table, trees[done:], tree, nodes, width)
            chosen = best(candidates(sums, b.missing(), len(numeric), o), "node").where("gain > 0").collect()
            nodes = []
            for s in sorted(chosen):
                values = tuple(-o.rate * s[f"g_{k}"] / (s[f"h_{k}"] + o.ridge * UNIT) for k in "lr")
                nodes += tree.split(s["node"], s["feature"], sorted(s["left"]), values)
            if not nodes:
                break
        if len(tree.feature) == 1:
            break
        trees.append(tree)
        if len(trees) - done >= REFRESH and len(trees) < o.trees:
            table, done = _moved(table, trees[done:], width), len(trees)
    return Boosted(b, trees, start)
