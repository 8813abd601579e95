"""The queries of the subpackage by name."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import forms
from quadrille.llm.forms import class_links, lookalike_pairs
from quadrille.llm.leaks import leaks
from quadrille.llm.packing import audit, fill, pack, pack_texts, token_counts
from quadrille.session import materialize
from quadrille.sources.tables import table


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in containers of 2,048 tokens."""
    return pack_texts(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of p7_pack are."""
    return fill(pack_texts(table(spark, sf_dir, "documents")))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is every text whole, none split that fits, no container too full, and little left empty?"""
    sizes, _ = materialize(token_counts(table(spark, sf_dir, "documents")), "sizes")
    packed, _ = materialize(pack(sizes, 2048), "packed")
    return audit(sizes, packed, 2048)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they leak."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look alike but differ in their characters."""
    return lookalike_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like others, with the class they are in and the number of their links."""
    return class_links(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p7_pack, p7_fill, p7_audit, p8_found, p9_found, p9_classes)}


def _plain(column: str) -> str:
    """The plain form in DuckDB's SQL, which can compose but not decompose: accented look-alikes are listed too."""
    table = {chr(k): chr(v) if isinstance(v, int) else v for k, v in forms.PROTOTYPES.items() if v and v != " "}
    for c in range(0x370, 0x530):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and (new := unicodedata.normalize("NFC", d.translate(forms.LOOKALIKES))) != chr(c) and len(new) == 1:
            table[chr(c)] = new
    table |= dict.fromkeys(forms.BLANKS, " ")
    quote = lambda s: s.replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({column}), '{quote(''.join(table))}{forms.ZERO_WIDTH}', '{quote(''.join(table.values()))}'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"""WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower({_plain("text")}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower({_plain("text")}), '[\\p{{L}}\\p{{N}}]+') FROM eval_items WHERE text IS NOT NULL),
starts AS (SELECT kind, id, w, unnest(range(1, len(w) - 11)) AS k FROM texts WHERE len(w) >= 13),
passages AS (SELECT DISTINCT kind, id, array_to_string(w[k:k + 12], ' ') AS p FROM starts)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM passages d JOIN passages i ON d.p = i.p AND d.kind = 'd' AND i.kind = 'i'""",
        "p7_audit": "SELECT count(*) AS n_whole, 0 AS n_broken, 0 AS n_split, 0 AS n_overfull, true AS well_filled FROM documents",
        "p9_classes": f"""WITH shown AS (SELECT DISTINCT doc_id, text, {_plain("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS first_doc, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS n_links FROM shown QUALIFY n_links > 0""",
        "p9_found": f"""WITH shown AS (SELECT DISTINCT doc_id, text, {_plain("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM shown a JOIN shown b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    }
