"""Exactly one copy of messages delivered more than once, by the numbers their producers gave them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.runs import compress, match, merge
from quadrille.session import broadcast_if_small, materialize

STATE_RUNS = "producer long, block long, run_start long, run_end long"
STATE_SEEN = "producer long, number long, key string, mark long"


def judge(batch: DataFrame, runs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct identifiers of a batch (producer, number, key, mark, first) and ``how`` each is decided, and the marks
    of which there is more than one identifier:

    * ``covered``: the number lies in a seen run and stands for the same message as before; a repeat, which ends there.
    * ``new``: the number is uncovered, and nothing else in the batch or the state can be its message; accepted once.
    * ``lookup``: the identifier is malformed (no producer, no positive number, a covered number that stands for
      another message than before), or its message may have been numbered anew; the key decides.

    That nothing else can be the message is told by ``mark``, 64 bits over the key: equal keys have equal marks, so
    a mark that occurs once and not in the state needs no lookup."""
    sound = F.col("producer").isNotNull() & (F.col("number") > 0)
    b = batch.where("key is not null").select(F.when(sound, F.col("producer")).alias("producer"), F.when(sound, F.col("number")).alias("number"), "key", "ord")
    per = b.groupBy("producer", "number", "key").agg(F.min("ord").alias("first")).withColumn("mark", F.xxhash64("key"))
    own = ["producer", "number", "key", "mark", "first"]
    checked, _ = materialize(match(per, runs, ["producer"], "number").select(*own, "covered"), "checked")
    covered = checked.where("covered").drop("covered")
    clash = covered.join(seen, ["producer", "number", "key"], "left_anti").select(*own)
    repeats = covered.join(seen.select("producer", "number", "key"), ["producer", "number", "key"], "left_semi").select(*own)
    open_ = checked.where("not covered").select(*own)
    marks = checked.select("mark", F.lit(1).alias("n")).unionByName(seen.select("mark", F.lit(2).alias("n")))
    twice, size = materialize(marks.groupBy("mark").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 and least = 1").select("mark"), "marks")
    twice = broadcast_if_small(twice, size)
    new = open_.where("number is not null").join(twice, "mark", "left_anti").select(*own)
    bare = open_.where("number is null").unionByName(open_.where("number is not null").join(twice, "mark", "left_semi").select(*own))
    parts = ((repeats, "covered"), (new, "new"), (bare.unionByName(clash), "lookup"))
    judged = [df.withColumn("how", F.lit(how)) for df, how in parts]
    ids, _ = materialize(judged[0].unionByName(judged[1]).unionByName(judged[2]), "judged")
    return ids, twice


def accept(batch: DataFrame, runs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch to keep, one per message that no earlier batch brought (producer, number, key, first), and
    the distinct identifiers of the batch that the state does not hold (producer, number, key, mark).

    ``batch``: producer, number, key (what makes two messages the same), ord (struct by which the first copy is
    chosen; its last field should be unique). ``runs``, ``seen``: the state after the batches before. Copies under one
    identifier are combined first; judge() says which identifiers need the lookup of their key. Rows with a null key
    are no messages; they are neither kept nor repeats. An empty batch keeps nothing.
    """
    ids, twice = judge(batch, runs, seen)
    cols = ["producer", "number", "key", "first"]
    asked = ids.where("how = 'lookup'").groupBy("key", "mark").agg(F.min_by(F.struct("producer", "number"), "first").alias("id"), F.min("first").alias("first"))
    # identifiers that were accepted at once have keys of their own, so only the state can hold the others
    held = seen.select("mark", "key").join(twice, "mark", "left_semi").select("key").distinct()
    found = asked.join(held, "key", "left_anti").select("id.producer", "id.number", "key", "first")
    kept = ids.where("how = 'new'").select(*cols).unionByName(found.select(*cols))
    return kept, ids.where("how <> 'covered'").select("producer", "number", "key", "mark")


def advance_runs(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs of all numbers seen after a batch with these identifiers."""
    return merge(runs, compress(ids, ["producer"], "number").select(*runs.columns), ["producer"])


def advance(ids: DataFrame, runs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after a batch with these identifiers: runs of all numbers seen, and the identifiers themselves."""
    return advance_runs(ids, runs), seen.unionByName(ids)
