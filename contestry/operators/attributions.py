"""What each feature adds to a boosted model's log-odds: Shapley values over the trees' own paths.

A tree's expectation, with only some features known, goes both ways at a node of an unknown feature, in the shares of the
training rows. So a leaf counts with the product, over the features on its path, of either "the row takes the path" (known)
or the path's share of rows (unknown), and the Shapley value of a feature is a sum over leaves whose weights by the number of
known features are the coefficients of a small polynomial. All rows of an Arrow batch go through it at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from contestry.sources.staged import new_path

#: Attributions that are served.
TOP = 5


@dataclass(frozen=True)
class Leaf:
    """value: added to the log-odds. For each feature on the path: its place, the bounds it must lie in (low < x <= high), the path's share of rows."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaves(model: GBTClassificationModel, spark) -> list[Leaf]:
    """The leaves of all trees, from the node tables that the model writes: 2**depth for each tree at most. Features are continuous."""
    path = new_path(spark, "model")
    model.write().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for tree, weight in enumerate(model.treeWeights):
        own = nodes[tree]
        todo = [(own[0], {})]
        while todo:
            node, path_ = todo.pop()
            if node["leftChild"] < 0:
                at = sorted(path_)
                # The raw prediction is half the log-odds.
                out.append(Leaf(2 * weight * node["prediction"], tuple(at), *[tuple(path_[f][i] for f in at) for i in range(3)]))
                continue
            f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high, share = path_.get(f, (-inf, inf, 1.0))
            for child, bounds in ((own[node["leftChild"]], (low, min(high, cut))), (own[node["rightChild"]], (max(low, cut), high))):
                todo.append((child, path_ | {f: (*bounds, share * child["rawCount"] / node["rawCount"])}))
    return out


def base(trees: list[Leaf]) -> float:
    """The log-odds when nothing is known."""
    return float(sum(x.value * np.prod(x.share) for x in trees))


def parts(trees: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values of rows x (row, feature), as many as x has numbers; with base() they add up to the rows' log-odds."""
    out = np.zeros(x.shape)
    for leaf in trees:
        k = len(leaf.features)
        if not k:
            continue
        own = x[:, leaf.features]
        takes = ((own > leaf.low) & (own <= leaf.high)).astype(float)
        weights = [factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)]
        for j, f in enumerate(leaf.features):
            # Coefficient s: the sum, over sets of s known features among the others, of the leaf's share.
            some = [np.ones(len(x))]
            for i in range(k):
                if i != j:
                    z, o = leaf.share[i], takes[:, i]
                    some = [(some[s] * z if s < len(some) else 0) + (some[s - 1] * o if s else 0) for s in range(len(some) + 1)]
            out[:, f] += leaf.value * (takes[:, j] - leaf.share[j]) * sum(w * c for w, c in zip(weights, some, strict=True))
    return out


def attributed(rows: DataFrame, features: list[str], trees: list[Leaf], name: str = "parts") -> DataFrame:
    """rows with an array of each feature's part of the log-odds, in the order of features, none of which may be null."""
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(DoubleType()))])
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(columns.index(c)).cast(pa.float64()).to_numpy() for c in features], axis=1) if b.num_rows else np.zeros((0, len(features)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(parts(trees, x)), pa.list_(pa.float64()))], [*columns, name])

    return rows.mapInArrow(run, schema)


def symmetrised_parts(rows: DataFrame, key: str, features: list[str], trees: list[Leaf]) -> DataFrame:
    """key, the features and parts, half the difference of the row's parts and its mirror's (every feature negated): swapping the corners negates them, and
    they add up to half the difference of both log-odds."""
    both = attributed(rows.select(key, *features), features, trees, "own_")
    back = attributed(both.select(key, *[(-F.col(c)).alias(c) for c in features], *[F.col(c).alias(f"value_{i}") for i, c in enumerate(features)], "own_"), features, trees, "mirrored_")
    half = F.transform(F.arrays_zip("own_", "mirrored_"), lambda p: (p["own_"] - p["mirrored_"]) / 2)
    return back.select(key, *[F.col(f"value_{i}").alias(c) for i, c in enumerate(features)], half.alias("parts"))


def top_features(attributions: DataFrame, key: str, features: list[str], most: int = TOP) -> DataFrame:
    """key, rank, name, value, contribution and direction (red from 0 on) of the most telling features by absolute value; of equals the first in features."""
    each = F.array(*[F.struct((-F.abs(F.col("parts")[i])).alias("order"), F.lit(i).alias("at"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.col("parts")[i].alias("contribution")) for i, c in enumerate(features)])
    best = attributions.select(key, F.posexplode(F.slice(F.array_sort(each), 1, most)).alias("place", "f"))
    return best.select(key, (F.col("place") + 1).alias("rank"), "f.name", "f.value", "f.contribution", F.when(F.col("f.contribution") >= 0, "red").otherwise("blue").alias("direction"))
