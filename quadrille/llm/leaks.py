"""Held-out test items of which a passage stands in a document of the corpus."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.forms import words
from quadrille.session import broadcast_if_small, materialize

#: Consecutive words that make a leak, and the words of a shingle.
PASSAGE, SHINGLE = 13, 5
#: So many different shingles of the items, at most, are handed to the tasks as they are; beyond it as a bit set of
#: this size, which lets a few others pass.
SET_LIMIT, BITS = 2_000_000, 1 << 28
#: Words whose hashes a worker keeps.
KEPT_WORDS = 1 << 20

HITS = "doc_id long, pos int, n_words int, shingle long, head int, near array<string>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_kept: dict[str, int] = {}


def shingles(ws: list[str], n: int = SHINGLE) -> np.ndarray:
    """A hash of each n words in a row, made of those of the words."""
    if len(ws) < n:
        return np.empty(0, np.int64)
    if len(_kept) > KEPT_WORDS:
        _kept.clear()
    hs = []
    for w in ws:
        h = _kept.get(w)
        if h is None:
            h = _kept[w] = xxhash.xxh64_intdigest(w)
        hs.append(h)
    own = np.array(hs, np.uint64)
    out = own[: len(ws) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + own[k : len(ws) - n + 1 + k]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


class Shingles:
    """A sorted array of shingles."""

    def __init__(self, values: list[int]):
        self.values = np.array(sorted(values), np.int64)

    def holds(self, hs: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(hs), bool)
        return self.values[np.minimum(np.searchsorted(self.values, hs), len(self.values) - 1)] == hs


class ShingleBits:
    """Two bits for each shingle, in a set of fixed size however many there are; holds() may be true for others."""

    def __init__(self, values: Iterator[int], bits: int = BITS):
        self.mask, self.data = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8)
        while chunk := list(itertools.islice(values, 1 << 16)):
            for at in self._places(np.array(chunk, np.int64)):
                np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _places(self, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = hs.view(np.uint64)
        return u & self.mask, (u >> np.uint64(32)) & self.mask

    def holds(self, hs: np.ndarray) -> np.ndarray:
        out = np.ones(len(hs), bool)
        for at in self._places(hs):
            out &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return out


def _hits(wanted, passage: int, n: int):
    """Positions of wanted shingles. A shingle that can be part of a passage, since it stands in a row of enough
    wanted ones, carries the words around it (near, which starts at word ``head``)."""
    row = passage - n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                hs = shingles(ws, n)
                at = np.flatnonzero(known.holds(hs)).tolist()
                k = 0
                while k < len(at):
                    j = k
                    while j + 1 < len(at) and at[j + 1] == at[j] + 1:
                        j += 1
                    for i in at[k : j + 1]:
                        head = max(0, i - row + 1)
                        for col, v in zip(out, (doc, i, len(ws), int(hs[i]), head, ws[head : i + passage] if j - k + 1 >= row else None), strict=True):
                            col.append(v)
                    k = j + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.list_(pa.string()))], ["doc_id", "pos", "n_words", "shingle", "head", "near"])

    return run


def _passages(passage: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                hs = shingles(ws, n).tolist()
                rows += [(item, i, ws[i : i + passage], hs[i : i + passage - n + 1]) for i in range(len(ws) - passage + 1)]
            a, p, w, h = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(w, pa.list_(pa.string())), pa.array(h, pa.list_(pa.int64()))], ["item_id", "start", "words", "shingles"])

    return run


def leaks(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, n: int = SHINGLE, set_limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, item_id of every document that holds ``passage`` consecutive words of an item's text.

    ``docs``: doc_id, text; ``items``: item_id, text. Texts are brought to one form and cut into words first. Every
    passage of an item is a sequence of word shingles; the rarest of them in the corpus is its prefix. Documents that
    hold the shingle give candidates: the passage then starts at a known word, which must leave room for it on both
    sides, and all its words are compared there. Items shorter than a passage leak nothing; null texts and ids are
    left out; repeated rows and passages give one row.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    i = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    found, _ = materialize(i.mapInArrow(_passages(passage, n), "item_id long, start int, words array<string>, shingles array<long>"), "passages")
    flat = found.select("item_id", "start", "words", F.posexplode("shingles").alias("offset", "shingle"))
    wanted = flat.select("shingle").distinct()
    few = wanted.count() <= set_limit
    own = spark.sparkContext.broadcast(Shingles([r[0] for r in wanted.collect()]) if few else ShingleBits(r[0] for r in wanted.toLocalIterator()))
    hits = d.mapInArrow(_hits(own, passage, n), HITS)
    if not few:
        hits = hits.join(wanted, "shingle", "left_semi").select("doc_id", "pos", "n_words", "shingle", "head", "near")
    hits, _ = materialize(hits, "hits")
    rarity = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    prefix = (
        flat.join(rarity, "shingle", "left").groupBy("item_id", "start")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("p"), F.first("words").alias("words"))
        .where("p.df > 0").select("item_id", "words", "p.shingle", "p.offset")
    )
    prefix, size = materialize(prefix.groupBy("shingle", "offset", "words").agg(F.collect_set("item_id").alias("items")), "prefix")
    room = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + passage <= F.col("n_words"))
    same = F.slice("near", F.col("pos") - F.col("offset") - F.col("head") + 1, passage) == F.col("words")
    cand = hits.where("near is not null").join(broadcast_if_small(prefix, size), "shingle").where(room).where(same)
    return cand.select("doc_id", F.explode("items").alias("item_id")).distinct()
