"""Message, type and title normalisation as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: rules in the order they apply -----------------------------
# Pattern, placeholder, and literals of which any match must contain one (none: always
# tried). ASCII word boundaries are spelled out with lookarounds, because "\b" changes
# meaning with the JVM release while the results may not.
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
MESSAGE_RULES = (
    (r"(?<!\w)[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?!\w)",
     "<uuid>", ("-",)),
    (r"(?<!\w)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?(?!\w)",
     "<timestamp>", (":",)),
    (r"(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?(?!\w)", "<ip>", (".",)),
    (_EDGE + r"[\w.+-]+@[\w-]+\.[\w.-]+" + _EDGE, "<email>", ("@",)),
    (r"(?<!\w)[a-zA-Z][a-zA-Z0-9+.-]*://\S+", "<url>", ("://",)),
    (r"(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/]){2,}[\w.-]*", "<path>", ("/", "\\")),
    (r"(?<!\w)0x[0-9a-fA-F]+(?!\w)", "<hex>", ("0x",)),
    (r"(?<!\w)[0-9a-fA-F]{8,}(?!\w)", "<hex>", ()),
    (r"(?<!\w)\d[\d_,]*(?:\.\d+)?" + _EDGE, "<num>", ()),
)
# What counts as whitespace at the ends of a text.
WHITESPACE = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2008\u2009\u200a\u2028\u2029\u205f\u3000")
# -------------------------------------------------------------------------------


def is_blank(c: Column) -> Column:
    # Trimming on the left alone stops at the first character of a text.
    return c.isNull() | (F.ltrim(c, F.lit(WHITESPACE)) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def strip(c: Column) -> Column:
    """Trim all whitespace; Spark's plain ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def _replace(text: Column, pattern: str, placeholder: str, markers: tuple[str, ...]) -> Column:
    """Regex replacement, skipped where a byte search shows that nothing can match.

    The one-element transform binds the text, which would otherwise be computed twice.
    """
    def guarded(t: Column) -> Column:
        possible = reduce(lambda a, b: a | b, [t.contains(m) for m in markers])
        return F.when(possible, F.regexp_replace(t, pattern, placeholder)).otherwise(t)

    if not markers:
        return F.regexp_replace(text, pattern, placeholder)
    return F.get(F.transform(F.array(text), guarded), F.lit(0))


def normalize_message(message: Column) -> Column:
    """Replace the variable parts of a message by placeholders; null gives ''."""
    text = strip(message)
    for rule in MESSAGE_RULES:
        text = _replace(text, *rule)
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def normalize_type(exception_type: Column) -> Column:
    """Drop compiler-made lambda and anonymous-class suffixes from a type name."""
    bare = F.regexp_replace(strip(exception_type), r"\$\$Lambda.*$", "")
    bare = F.regexp_replace(bare, r"\$\d+$", "")
    return F.when(is_blank(exception_type), F.lit("<unknown>")).otherwise(bare)


def title(kind: Column, message: Column) -> Column:
    """``SimpleType: message`` cut to 200 characters, from already normalised parts."""
    simple = F.when(kind.endswith("."), kind).otherwise(F.substring_index(kind, ".", -1))
    full = F.when(is_blank(message), simple).otherwise(F.concat(simple, F.lit(": "), message))
    return F.when(~utf16_longer_than(full, 200), full).otherwise(
        F.concat(truncate(full, 199), F.lit("…")))


def utf16_longer_than(c: Column, limit: int) -> Column:
    """Length test in UTF-16 units; only borderline strings are re-encoded."""
    units = F.octet_length(F.encode(c, "UTF-16BE")) / 2
    return (F.when(F.length(c) > limit, True)
            .when(F.length(c) * 2 <= limit, False)
            .otherwise(units > limit))


def truncate(c: Column, limit: int) -> Column:
    """The first ``limit`` UTF-16 units; a pair that the cut would split is left out whole."""
    units = F.encode(c, "UTF-16BE")
    split = F.hex(F.substring(units, 2 * limit - 1, 1)).between("D8", "DB")
    kept = F.when(split, limit - 1).otherwise(limit)
    return F.when(utf16_longer_than(c, limit), F.decode(
        F.substring(units, F.lit(1), 2 * kept), "UTF-16BE")).otherwise(c)
