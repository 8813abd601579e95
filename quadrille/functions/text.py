"""Column functions on the spelling of values: blanks, keys, artifact codes, base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming removes.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

ARTIFACT_CODE = "RA[A-Za-z0-9_-]{43}"


def clean(c: Column | str) -> Column:
    """Trimmed of all white space; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c, F.lit(BLANKS))
    return F.nullif(t, F.lit(""))


def clean_lower(c: Column | str) -> Column:
    return F.lower(clean(c))


def artifact_code(c: Column | str) -> Column:
    """The first artifact code in an IRI, or null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, f"({ARTIFACT_CODE})", 1), F.lit(""))


def pack_key(c: Column) -> Column:
    """Half-size binary form of a hexadecimal SHA-256 in lower case; any other text keeps its bytes.
    The first byte tells which, so the form can be reversed by unpack_key."""
    return F.when(c.rlike("^[0-9a-f]{64}$"), F.unhex(F.concat(F.lit("00"), c))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(c, "UTF-8")))


def unpack_key(b: Column) -> Column:
    body = F.substring(b, 2, 2**31 - 1)
    return F.when(F.substring(b, 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(body))).otherwise(F.decode(body, "UTF-8"))


def base64_bytes(c: Column | str) -> Column:
    """The bytes of base64 in the plain or the URL alphabet, padded or not; null where it is not base64."""
    t = F.rtrim(F.translate(clean(c), "-_", "+/"), F.lit("="))
    n = F.length(t) % 4
    pad = F.when(n == 2, F.lit("==")).when(n == 3, F.lit("=")).otherwise(F.lit(""))
    return F.when(t.rlike("^[A-Za-z0-9+/]*$") & (n != 1), F.unbase64(F.concat(t, pad)))


def base64_key(c: Column | str) -> Column:
    """The bytes of base64 in one spelling. Text that is not base64 is kept with a mark before it, so that it equals
    itself only; null where the text is blank or null."""
    return F.coalesce(F.base64(base64_bytes(c)), F.concat(F.lit("!"), F.rtrim(F.translate(clean(c), "-_", "+/"), F.lit("="))))


def digest(*cols: Column | str) -> list[Column]:
    """128 bits over the columns, nulls and boundaries included, as two longs."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    parts = [x for c in cs for x in (c, c.isNull())]
    return [F.xxhash64(F.lit("a"), *parts), F.xxhash64(F.lit("b"), *parts)]
