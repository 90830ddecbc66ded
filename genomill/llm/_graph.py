"""Connected components by contraction, in DataFrame operations on slim tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm._common import Scratch, join_apart
from genomill.llm._shingles import STEP, U, mixed

#: A graph of at most so many edges is finished by one task, whose memory that bounds; it goes on in the same rounds.
FINISH_EDGES = 200_000


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, levels of the edges a, b, which are few, by the same rounds on arrays."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, name, levels = at[: len(a)], at[len(a) :], np.arange(len(nodes)), []
    while len(a):
        place = mixed(nodes.view(np.uint64) + U(len(levels) + 1) * STEP)
        order = np.argsort(place)
        best = place.copy()
        np.minimum.at(best, a, place[b])
        np.minimum.at(best, b, place[a])
        to = order[np.searchsorted(place[order], best)]
        name = to[name]
        levels.append(nodes[name])
        a, b = to[a], to[b]
        apart = a != b
        pair = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]]), axis=1)
        a, b = pair
    flat = pa.array(np.stack(levels, axis=1).ravel())
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * len(levels)), flat)], ["node", "levels"])


def components(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """node, component, levels for every node of edges (a, b: long); a component's name is one of its nodes.

    levels are the node's names after each round, from small neighbourhoods to the component. Null ends and loops are
    left out. Each round names every node after the first of itself and its neighbours in a random order of its own, and
    goes on with the graph of those names, which shrinks by a constant share however the nodes are numbered. A node with
    very many neighbours is summed up before the shuffle; the joins by name are plain equi-joins that adaptive execution
    splits. Every round's tables are written to the shared folder and read again, so that the planner knows their real
    sizes: a checkpoint would keep the estimate of its plan, which grows beyond all bounds from round to round.
    """
    own = Scratch(edges.sparkSession)
    written = own.table
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds, names = [], None
    while n := left.count():
        if n <= finish_edges:
            names = written(left.coalesce(1).mapInArrow(_finished, "node long, levels array<long>"), "names")
            break
        old, turn = own.made[-1], len(rounds) + 1
        place = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min_by("b", place("b")).alias("b"))
        rounds.append(least := written(best.select(F.col("a").alias("node"), F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("name")), "names"))
        a = least.select(F.col("node").alias("a"), F.col("name").alias("na"))
        b = least.select(F.col("node").alias("b"), F.col("name").alias("nb"))
        left = written(left.join(a, "a").join(b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        own.drop(old)
    if names is None:
        names = edges.sparkSession.createDataFrame([], "node long, levels array<long>")
    # From the last, smallest round back to the first.
    for earlier in reversed(rounds):
        later = names.select(F.col("node").alias("name"), F.col("levels").alias("after"))
        joined = join_apart(earlier, later, "name", "left")
        names = written(joined.select("node", F.concat(F.array("name"), F.coalesce("after", F.array().cast("array<long>"))).alias("levels")), "names")
    return own.done(names.select("node", F.element_at("levels", -1).alias("component"), "levels"), "components")
