"""Full-text search by an inverted index with BM25 scores."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Folders that a stored index is divided into.
BUCKETS = 64


def terms(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def build_index(docs: DataFrame, key: str | list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (word, key, tf) and lengths (key, n_words). Null texts have no words; the texts of one key are one."""
    keys = [key] if isinstance(key, str) else key
    w = docs.select(*keys, terms(F.col(text)).alias("w")).where("w is not null")
    lengths = w.groupBy(*keys).agg(F.sum(F.size("w")).alias("n_words"))
    return w.select(*keys, F.explode("w").alias("word")).groupBy("word", *keys).agg(F.count(F.lit(1)).alias("tf")), lengths


def bucket_of(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def store_index(index: tuple[DataFrame, DataFrame], path: str) -> None:
    """Write an index. Postings lie in a folder for each bucket of words, so that a search reads those of its words."""
    postings, lengths = index
    bucket = (F.crc32(F.encode("word", "UTF-8")) % BUCKETS).cast("int")
    postings.withColumn("bucket", bucket).repartition(F.col("bucket"), F.pmod(F.hash("word"), F.lit(8))).sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def search(index: tuple[DataFrame, DataFrame], query: str, key: str | list[str], all_words: bool = True) -> DataFrame:
    """key and score of what matches the words of a query; with ``all_words`` only what holds each of them."""
    postings, lengths = index
    keys = [key] if isinstance(key, str) else key
    words = postings.sparkSession.createDataFrame([(query,)], "q string").select(F.array_distinct(terms(F.col("q")))).first()[0]
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean"))
    hit = postings.where(F.col("word").isin(words))
    if "bucket" in postings.columns:
        hit = hit.where(F.col("bucket").isin([bucket_of(w) for w in words])).drop("bucket")
    df = hit.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    x = hit.join(F.broadcast(df), "word").join(lengths, keys).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.col("mean")))
    out = x.groupBy(*keys).agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("n_hit"))
    if all_words:
        out = out.where(F.col("n_hit") == len(words))
    return out.drop("n_hit")


def snippet(text: Column, word: str, around: int = 40) -> Column:
    """The text around the first occurrence of a word."""
    at = F.instr(F.lower(text), F.lit(word.lower()))
    return F.when(at > 0, F.substr(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word))))


class TextSearch:
    """The literals of quads as searchable texts, one for each subject and property. ``index``: a stored one (see
    read_index), else it is built from the quads when asked."""

    KEY = ["s", "p"]

    def __init__(self, literals: DataFrame, index: tuple[DataFrame, DataFrame] | None = None):
        self.literals, self._index = literals.where("o_kind = 'lit'").select("s", "p", "o"), index

    def index(self) -> tuple[DataFrame, DataFrame]:
        return self._index or build_index(self.literals, self.KEY, "o")

    def matches(self, query: str, prop: str | None = None) -> DataFrame:
        """s, p, score, snippet of the subjects and properties whose text holds some of the words; with ``prop`` of that
        property only. The snippet is around the first word of the query that the text holds."""
        found = search(self.index(), query, self.KEY, all_words=False)
        if prop is not None:
            found = found.where(F.col("p") == prop)
        words = self.literals.sparkSession.createDataFrame([(query,)], "q string").select(F.array_distinct(terms(F.col("q")))).first()[0]
        near = F.coalesce(*(F.when(F.array_contains(terms(F.col("o")), w), snippet(F.col("o"), w)) for w in words), F.lit(None).cast("string")) if words else F.lit(None).cast("string")
        texts = self.literals.join(found.select("s", "p"), self.KEY, "left_semi").groupBy("s", "p").agg(F.min(near).alias("snippet"))
        return found.join(texts, self.KEY)
