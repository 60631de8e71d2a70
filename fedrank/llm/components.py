"""Connected components of links between identifiers, without bringing any to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: So many distinct links, once counted, are joined by one task; more go by rounds over all executors.
TASK_LINKS = 200_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links, and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (label[x], label[y]):  # a group's name takes the smaller of its neighbours' names
            np.minimum.at(new, side, low)
        new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            node, label = labelled(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    return shared.stored(edges.coalesce(1).mapInArrow(run, "node long, label long"), "labels", {})


def follow(rows: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Stores ``rows`` with ``column`` replaced by its ``up`` in ``parent`` (``name, up``), where it has one.  A name that many
    rows hold is salted."""
    n = rows.count()
    hot = shared.hot_keys(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "n", n)
    salt = F.col(next(c for c in rows.columns if c != column))
    joined = shared.join_salted(rows, parent.select(F.col("name").alias(column), F.col("up").alias("to")), column, hot, salt)
    return shared.stored(joined.select(*(F.coalesce("to", column).alias(c) if c == column else F.col(c) for c in rows.columns)), "followed", {})


def hooked(edges: DataFrame, turn: int) -> DataFrame:
    """``name, up``: every name takes the neighbour that comes first in this turn's order, if it comes before itself, and then
    that one's, until all have the last of their way.  The order is a hash, so half of the names go in a turn, on average."""
    place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("name"))
    both = edges.union(edges.select("b", "a"))
    first = both.groupBy("a").agg(F.min(place("b")).alias("b"))
    parent = shared.stored(first.select(F.col("a").alias("name"), F.least(place("a"), F.col("b"))["name"].alias("up")), "parents", {})
    while True:
        far = follow(parent, "up", parent)
        settled = far.join(parent.withColumnRenamed("up", "old"), "name").where("up <> old").isEmpty()
        shared.drop(parent)
        if settled:
            return far
        parent = far


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of the undirected links ``a, b``: the smallest node that can be reached.

    While there are more than TASK_LINKS links, names are hooked together (see hooked()), links take their ends' names and
    those within a name go: a number of turns that is logarithmic in the number of nodes.  Each turn is stored.
    """
    edges = shared.stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", {})
    labels, turn = None, 0
    while edges.count() > TASK_LINKS:
        parent = hooked(edges, turn)
        labels = parent.select(F.col("name").alias("node"), F.col("up").alias("label")) if labels is None else follow(labels, "label", parent)
        renamed = follow(follow(edges, "a", parent), "b", parent).where("a <> b")
        edges, turn = shared.stored(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", {}), turn + 1
    rest = in_one_task(edges)
    if labels is None:
        return rest
    labels = follow(labels, "label", rest.select(F.col("node").alias("name"), F.col("label").alias("up")))
    return follow(labels, "label", labels.groupBy("label").agg(F.min("node").alias("up")).withColumnRenamed("label", "name"))
