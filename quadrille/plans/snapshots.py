"""Which deliveries of trust states count, and the account rows of the snapshots they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.text import clean, clean_lower, digest, pack_key
from quadrille.session import broadcast_if_small, materialize
from quadrille.sources.tables import table

#: Rows of one account in one delivery beyond which such repeats are combined before the shuffle.
HOT_REPEATS = 100_000


class Snapshots:
    """The snapshots of every registry: one per (registry, counter) with a complete delivery.

    A delivery is complete if its rows name as many different accounts as ``n_accounts`` says. Where several
    complete deliveries carry one snapshot, the first received counts and the others are repeats of it.
    ``chain``: chain_id, registry, ord (1-based place in the chain), counter, next_counter (null at the end),
    trust_state_hash, recorded (time of receipt), delivery_id. Deliveries without a registry or counter, and rows
    without a pubkey or agent, belong to no snapshot. An empty complete delivery is a snapshot without accounts.
    """

    def __init__(self, snapshots: DataFrame, accounts: DataFrame):
        self._accounts = accounts
        keyed = accounts.select("delivery_id", *(c.alias(f"h{i}") for i, c in enumerate(digest(clean_lower("pubkey"), clean("agent")))), clean("pubkey").isNotNull().alias("a"), clean("agent").isNotNull().alias("b"))
        per = (
            keyed.where("a and b").groupBy("delivery_id", "h0", "h1").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n_found"), F.max("n").alias("most"))
        )
        own = snapshots.select("delivery_id", clean("registry").alias("registry"), clean("trust_state_hash").alias("trust_state_hash"), F.col("trust_state_counter").alias("counter"), F.col("received_at").alias("recorded"), "n_accounts")
        complete = own.join(per, "delivery_id", "left").where((F.coalesce("n_found", F.lit(0)) == F.col("n_accounts")) & F.col("registry").isNotNull() & F.col("counter").isNotNull())
        first = complete.withColumn("rn", F.row_number().over(Window.partitionBy("registry", "counter").orderBy(F.col("recorded").asc_nulls_last(), "delivery_id"))).where("rn = 1")
        w = Window.partitionBy("registry").orderBy("counter")
        chain = first.select("registry", "counter", "trust_state_hash", "recorded", "delivery_id", F.coalesce("most", F.lit(0)).alias("most"), F.row_number().over(w).alias("ord"), F.lead("counter").over(w).alias("next_counter"), F.xxhash64("registry").alias("chain_id"))
        self.chain, self.n_bytes = materialize(chain, "chain")

    def small(self, *cols: str) -> DataFrame:
        return broadcast_if_small(self.chain.select(*cols), self.n_bytes)

    def states(self, *attrs: str) -> DataFrame:
        """One row per account and snapshot: chain_id, ord, pk, agent and the attributes, clustered by
        (pk, agent, chain_id) and sorted by ord within. Of several rows for an account in a delivery the one
        with the latest name_created_at counts, a null being earliest, then the smallest acc_row."""
        forms = {"status": clean_lower("status"), "name": clean("name")}
        rows = (
            self._accounts.join(self.small("delivery_id", "chain_id", "ord"), "delivery_id")
            .select("chain_id", "ord", pack_key(clean_lower("pubkey")).alias("pk"), clean("agent").alias("agent"), *(forms.get(a, F.col(a)).alias(a) for a in attrs), F.col("name_created_at").alias("_t"), F.col("acc_row").alias("_r"))
            .where("pk is not null and agent is not null")
        )
        key = ["pk", "agent", "chain_id"]
        if self.chain.where(F.col("most") > HOT_REPEATS).limit(1).count():
            best = F.max(F.struct(F.col("_t").isNotNull().alias("k"), F.col("_t"), (-F.col("_r")).alias("n"), F.struct(*attrs, "_r").alias("v"))).alias("x")
            rows = rows.groupBy(*key, "ord").agg(best).select(*key, "ord", *(F.col(f"x.v.{a}").alias(a) for a in attrs), F.col("x._t").alias("_t"), F.col("x.v._r").alias("_r"))
        w = Window.partitionBy(*key).orderBy("ord", F.col("_t").desc_nulls_last(), "_r")
        return rows.withColumn("_p", F.lag("ord").over(w)).where("_p is null or _p <> ord").select(*key, "ord", *attrs)


def read_snapshots(spark: SparkSession, sf_dir: str) -> Snapshots:
    return Snapshots(table(spark, sf_dir, "trust_snapshots"), table(spark, sf_dir, "trust_accounts"))
