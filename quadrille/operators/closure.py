"""Transitive closure of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import materialize


def _jumps(edges: DataFrame, pairs: DataFrame, g: list[str], limit: int) -> DataFrame | None:
    """The closure from the sources of ``pairs`` (their edges) where each source has one edge: round k adds the pairs that
    are 2^k more steps apart, each found once, over the node 2^k steps on. None if the edges have a cycle, on which the
    steps never end."""
    jump = edges
    for _ in range(limit):
        far = jump.select(*g, F.col("src").alias("_mid"), F.col("dst").alias("_far"))
        more = pairs.join(far.withColumnRenamed("_mid", "dst"), [*g, "dst"]).select(*g, "src", F.col("_far").alias("dst"))
        pairs = pairs.unionByName(materialize(more, "pairs")[0])
        jump, _ = materialize(jump.join(far.withColumnRenamed("_mid", "dst"), [*g, "dst"]).select(*g, "src", F.col("_far").alias("dst")), "jump")
        if not jump.limit(1).count():
            return pairs
    return None


def best_below(edges: DataFrame, values: DataFrame, by: list[str]) -> DataFrame | None:
    """For every node the greatest value of itself and of all that reach it: node, the columns of ``by``, val.

    ``edges``: src, dst, one for each src. ``values``: node, by, val (orderable). Round k hands what each node knows of
    its surroundings to the node 2^k steps on, so neither pairs are built nor paths walked. None if a source has
    several edges or there is a cycle."""
    edges, _ = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    stats = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("nodes")).first()
    if (stats["most"] or 0) > 1:
        return None
    jump, best = edges, values.select("node", *by, "val")
    for _ in range((stats["nodes"] or 0).bit_length() + 1):
        handed = jump.join(best.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), *by, "val")
        best, _ = materialize(best.unionByName(handed).groupBy("node", *by).agg(F.max("val").alias("val")), "best")
        jump, _ = materialize(jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")), "jump")
        if not jump.limit(1).count():
            return best
    return None


def closure(edges: DataFrame, seeds: DataFrame | None = None, group: Sequence[str] = (), limit: int = 100_000) -> DataFrame:
    """Pairs (src, dst) that a path of one edge or more joins, once each; edges: src, dst and the columns of ``group``,
    within whose values paths stay. With ``seeds`` (src) only paths from there.

    Semi-naive: each round extends only the pairs that the last one found. Without seeds they are extended by all
    pairs known so far, so the number of rounds is logarithmic in the longest path; where no source has two edges,
    it always is, and each pair is found once. Cycles end as nothing new is found. Each round is written to the shared folder, which cuts the lineage. Nulls join nothing."""
    g = list(group)
    edges = edges.select(*g, "src", "dst").dropna().distinct()
    edges, _ = materialize(edges, "edges")
    stats = edges.groupBy(*g, "src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("nodes")).first()
    if stats["most"] == 1:
        start = edges if seeds is None else materialize(edges.join(seeds.select("src").distinct(), "src", "left_semi").select(*g, "src", "dst"), "start")[0]
        if (pairs := _jumps(edges, start, g, stats["nodes"].bit_length() + 1)) is not None:
            return pairs
    frontier = edges if seeds is None else edges.join(seeds.select("src").distinct(), "src", "left_semi").select(*g, "src", "dst")
    known = frontier
    for step_no in range(1, limit):
        step = (known if seeds is None else edges).select(*g, F.col("src").alias("dst"), F.col("dst").alias("far"))
        new = frontier.join(step, [*g, "dst"]).select(*g, "src", F.col("far").alias("dst")).distinct().join(known, [*g, "src", "dst"], "left_anti")
        frontier, _ = materialize(new, "frontier")
        if not frontier.limit(1).count():
            return known
        known = known.unionByName(frontier)
        if step_no % 16 == 0:
            known, _ = materialize(known, "known")
    raise RuntimeError(f"no fixpoint after {limit} rounds")

