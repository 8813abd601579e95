"""One consistent form for text that looks alike, and classes of texts that share it."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import materialize

# Letters of the Cyrillic and Greek alphabets and the Latin letters drawn like them, and other letters
# of the two alphabets that are drawn like each other (the Greek one is the prototype).
CYRILLIC_LOWER, LATIN_FOR_CYRILLIC_LOWER = "аеорсухіјѕһԁԛԝӏ", "aeopcyxijshdqwl"
CYRILLIC_UPPER, LATIN_FOR_CYRILLIC_UPPER = "АВЕКМНОРСТУХЅІЈҮԚԜԌӀ", "ABEKMHOPCTYXSIJYQWGI"
GREEK_LOWER, LATIN_FOR_GREEK_LOWER = "ονϲϳ", "ovcj"
GREEK_UPPER, LATIN_FOR_GREEK_UPPER = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"
CYRILLIC_AS_GREEK, GREEK_FOR_CYRILLIC = "ГПФф", "ΓΠΦφ"
# Characters without width, and blanks of special width.
ZERO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Full-width signs outside the block that mirrors ASCII.
WIDE_SIGNS, ORDINARY_SIGNS = "￠￡￢￣￤￥￦", "¢£¬¯¦¥₩"

LOOKALIKES = str.maketrans(CYRILLIC_LOWER + CYRILLIC_UPPER + GREEK_LOWER + GREEK_UPPER + CYRILLIC_AS_GREEK, LATIN_FOR_CYRILLIC_LOWER + LATIN_FOR_CYRILLIC_UPPER + LATIN_FOR_GREEK_LOWER + LATIN_FOR_GREEK_UPPER + GREEK_FOR_CYRILLIC)
PROTOTYPES = LOOKALIKES | dict.fromkeys(map(ord, ZERO_WIDTH)) | dict.fromkeys(map(ord, BLANKS), " ") | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | str.maketrans(WIDE_SIGNS, ORDINARY_SIGNS)

WORD = re.compile(r"[^\W_]+")


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(PROTOTYPES))


def plain_form(text: str) -> str:
    """The skeleton with its accents composed: the one form to compare and store."""
    return text if text.isascii() else unicodedata.normalize("NFC", skeleton(text))


def words(text: str) -> list[str]:
    """Runs of letters and digits of the plain form, in lower case."""
    return WORD.findall(plain_form(text).lower())


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, skel, raw = b.column(0), [], []
        for t in b.column(1).to_pylist():
            raw.append(_digest(t))
            skel.append(raw[-1] if t.isascii() else _digest(skeleton(t)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(skel, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "skel", "raw"])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, skel, raw: 128-bit digests of the skeleton and of the text as stored. Rows with a null text are left
    out, as there is nothing to see; an empty text is a text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_digests, "doc_id long, skel binary, raw binary")


def lookalike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with the class of texts that look like its own (class_id) and the text's own digest (raw)."""
    return digests(docs, doc_id, text).select("doc_id", F.col("skel").alias("class_id"), "raw")


def lookalike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All pairs doc_id_a < doc_id_b of documents that differ as stored but have equal skeletons.

    Only the different texts of a class are paired, and each pair of texts is then joined with the documents that
    carry them, so copies of one text are never compared with each other. Repeated rows count once; a null doc_id
    is in no pair."""
    rows, _ = materialize(lookalike_classes(docs, doc_id, text).where("doc_id is not null"), "classes")
    texts = rows.select("class_id", "raw").distinct()
    mixed = texts.groupBy("class_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("class_id")
    members = rows.join(mixed, "class_id", "left_semi").distinct()
    one = members.select("class_id", "raw").distinct()
    pairs = one.withColumnRenamed("raw", "raw_a").join(one.withColumnRenamed("raw", "raw_b"), "class_id").where("raw_a < raw_b")
    side = lambda s: members.select("class_id", F.col("raw").alias(f"raw_{s}"), F.col("doc_id").alias(f"id_{s}"))
    x = pairs.join(side("a"), ["class_id", "raw_a"]).join(side("b"), ["class_id", "raw_b"]).where("id_a <> id_b")
    return x.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()


def class_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first_doc (the least doc_id of the class, which names it), n_links: every document that looks like others of
    another text, and how many those are. The counts stand for all pairs of lookalike_pairs(), which are not built: a
    class of any size takes a row per document. Repeated rows count once; a null doc_id is left out."""
    rows, _ = materialize(lookalike_classes(docs, doc_id, text).where("doc_id is not null").distinct(), "classes")
    per = rows.groupBy("class_id", "raw").agg(F.count(F.lit(1)).alias("own"), F.min("doc_id").alias("least"))
    whole = per.groupBy("class_id").agg(F.sum("own").alias("whole"), F.min("least").alias("first_doc"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    return rows.join(per.drop("least").join(whole, "class_id"), ["class_id", "raw"]).select("doc_id", "first_doc", (F.col("whole") - F.col("own")).alias("n_links"))
