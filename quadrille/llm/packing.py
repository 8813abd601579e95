"""Containers of fixed capacity filled with items of varying length."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Rows of one length that are ranked by one task, about.
RANKED_TOGETHER = 2_000_000
#: Ranks of one block, at least, and blocks of all lengths, at most about, in the join of items with their segments.
BLOCK_LEAST, BLOCKS = 1024, 200_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each text under a public byte-level vocabulary; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first. Each segment (length, from_rank, to_rank, first, per) puts the items of
    one length with ranks from_rank .. to_rank - 1 into the containers first, first + 1, ..., ``per`` into each.

    Open containers are kept as ranges of equal free space. Items go to the range with the least space that holds
    them, as many into each container as fit, so a range's space is at least halved whenever it is used: there are
    at most 2 x capacity ranges and 2 x capacity x log2(capacity) segments, however many items there are."""
    free: list[tuple[int, int, int]] = []  # space, first, containers; sorted
    out, used = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} for a capacity of {capacity}")

        def put(first: int, n: int, per: int, space: int) -> None:
            nonlocal left, rank
            out.append((length, rank, rank + n * per, first, per))  # noqa: B023
            left, rank = left - n * per, rank + n * per
            if rest := space - per * length:  # noqa: B023
                bisect.insort(free, (rest, first, n))

        while left:
            k = bisect.bisect_left(free, (length, -1, -1))
            space, first, n = free.pop(k) if k < len(free) else (capacity, used, -1)
            per = min(space // length, left)
            take = left // per if n < 0 else min(n, left // per)
            if n < 0:
                used += take
            elif take < n:
                bisect.insort(free, (space, first + take, n - take))
            put(first, take, per, space)
    return out


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """Every item in a container: doc_id, piece, first_token, n_tokens, container_id.

    ``sizes``: doc_id, n_tokens. An item larger than the capacity is cut into full pieces and a rest; no other is
    cut. Items of length 0, null or negative take no space: they keep a row, with n_tokens 0, in container 0.
    Repeated doc_ids are packed as often as they come. Only the histogram of lengths, with no more rows than the
    capacity, reaches the driver; items take their slots by their rank within their length.
    """
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / capacity), F.lit(1)) - 1))
    pieces = sizes.select("doc_id", n.alias("n"), cut.alias("piece")).select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    histogram = {r["n_tokens"]: r["count"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    segments = spark.createDataFrame(plan(histogram, capacity) or [(0, 0, 0, 0, 1)], "n_tokens int, from_rank long, to_rank long, first long, per long")
    lanes = max(8, sum(histogram.values()) // RANKED_TOGETHER)
    laned = pieces.where("n_tokens > 0").withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)))
    per_lane = laned.groupBy("n_tokens", "lane").count()
    before = Window.partitionBy("n_tokens").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_lane.select("n_tokens", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "lane").orderBy("doc_id", "piece")
    ranked = laned.withColumn("rn", F.row_number().over(within)).join(offsets, ["n_tokens", "lane"]).withColumn("rank", F.col("offset") + F.col("rn") - 1)
    # by blocks of ranks an item meets the few segments that reach into its block; there are no more rows of segments
    # than BLOCKS and the plan's bound together
    block = max(BLOCK_LEAST, sum(histogram.values()) // BLOCKS)
    reach = F.sequence(F.floor(F.col("from_rank") / block), F.floor((F.col("to_rank") - 1) / block))
    spread = segments.where("to_rank > from_rank").select("*", F.explode(reach).alias("block"))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block)).join(F.broadcast(spread), ["n_tokens", "block"]).where("rank >= from_rank and rank < to_rank")
    own = ["doc_id", "piece", "first_token", "n_tokens"]
    slots = placed.select(*own, (F.col("first") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per"))).cast("long").alias("container_id"))
    return slots.unionByName(pieces.where("n_tokens = 0").select(*own, F.lit(0).cast("long").alias("container_id")))


def pack_texts(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts packed by their length in tokens; see pack()."""
    sizes, _ = materialize(token_counts(docs, vocabulary), "sizes")
    return pack(sizes, capacity)


def fill(packed: DataFrame) -> DataFrame:
    """Containers by how full they are: n_tokens, n_containers."""
    return packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_containers"))


def audit(sizes: DataFrame, packed: DataFrame, capacity: int, least: float = 0.97) -> DataFrame:
    """One row about a packing: items with all their tokens in consecutive pieces (n_whole), others (n_broken), items
    split although they fit (n_split), containers above the capacity (n_overfull), and whether all but one container
    are filled to ``least`` of the capacity on average (well_filled). Needs unique doc_ids."""
    w = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("k"), F.sum("n_tokens").alias("total"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    w = sizes.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens")).join(w, "doc_id", "full")
    whole = F.coalesce((F.col("n") == F.col("k")) & (F.col("last") == F.col("n") - 1) & (F.col("total") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")), F.lit(False))
    items = w.agg(F.count_if(whole).alias("n_whole"), F.count_if(~whole).alias("n_broken"), F.count_if((F.col("n_tokens") <= capacity) & (F.col("n") > 1)).alias("n_split"))
    c = fill(packed).agg(F.coalesce(F.sum(F.when(F.col("n_tokens") > capacity, F.col("n_containers"))), F.lit(0)).alias("n_overfull"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_containers")) >= least * capacity * (F.sum("n_containers") - 1), F.lit(True)).alias("well_filled"))
    return items.crossJoin(c)
