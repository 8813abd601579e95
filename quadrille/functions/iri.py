"""Column functions on IRIs and names derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_for_uri(c: Column) -> Column:
    """Percent-encoding of all but the unreserved characters; url_encode is for forms and differs in three."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


# Fixed value: what may stand before and, shortly, behind the code of a base IRI.
TRUSTY = r"^(.*[^A-Za-z0-9\-_]RA[A-Za-z0-9\-_]{43})([^A-Za-z0-9\\-_].{0,43})?$"


def trusty_base(c: Column) -> Column:
    """The IRI up to and with its artifact code, if no more than a short part after a separator follows; else null."""
    return F.nullif(F.regexp_extract(c, TRUSTY, 1), F.lit(""))


def parent_prefix(c: Column) -> Column:
    """The IRI without fragment, query, trailing slashes and last path segment; null if nothing but the host is left
    or it has no authority part."""
    base = F.regexp_replace(F.regexp_replace(c, r"[#?].*$", ""), r"/+$", "")
    return F.nullif(F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/]+(?:/.*)?)/[^/]*$", 1), F.lit(""))


def shard_name(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.sha2(value, 256))


def short_key(c: Column) -> Column:
    """A label for a long public key: one character at its start and five at its fortieth place."""
    return F.when(F.length(c) >= 45, F.concat(F.substring(c, 1, 1), F.lit(".."), F.substring(c, 41, 5), F.lit(".."))).otherwise(c)


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def repo_of_path(c: Column) -> Column:
    """/repo/a/b names the repository a_b."""
    return F.regexp_replace(F.regexp_replace(c, "^/?repo/", ""), "/", "_")
