"""Text helpers: whitespace, null tokens, tags, escaping, fingerprints."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# FIXED VALUES: white space as a Python ``str.strip()`` sees it (Unicode
# white space plus the ASCII separator controls). Spark's ``trim`` only
# removes spaces.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# FIXED VALUES: white space as a browser's ``trim`` and ``\\s`` see it: with the
# byte-order mark, without the separator controls and the next-line character.
BROWSER_WS_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680"
                    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                    "\u2028\u2029\u202f\u205f\u3000\ufeff")
# The same set as a pattern: ``\\p{Z}`` is its spaces and its two Unicode line ends.
BROWSER_RUN_RE = r"[\t-\r\p{Z}\x{feff}]+"

# FIXED VALUES: key values treated as missing (case-sensitive), after strip.
MISSING_KEY_TOKENS = ("", "nan", "None")
# FIXED VALUES: scraped cell values dropped (compared lower-cased), after strip.
SCRAPE_NULL_TOKENS = ("", "nan", "none", "-")


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def lower_strip(c: ColumnLike) -> Column:
    """Header normalisation: lower case, then strip."""
    return strip(F.lower(_c(c)))


def lower_ascii(c: ColumnLike) -> Column:
    """A-Z become a-z; all else stays (F3: the letters that a LIKE folds)."""
    return F.translate(_c(c), string.ascii_uppercase, string.ascii_lowercase)


def collapse_ws(c: ColumnLike) -> Column:
    """Runs of a browser's white space become one space, then strip (X2). After
    the collapse only single spaces remain at the ends, so ``trim`` is enough."""
    return F.trim(F.regexp_replace(_c(c), BROWSER_RUN_RE, " "))


def browser_trim(c: ColumnLike) -> Column:
    """Remove leading and trailing white space as a browser does."""
    return F.btrim(_c(c), F.lit(BROWSER_WS_CHARS))


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(_c(c), F.lit(""))


def blank_default(c: ColumnLike, default: str) -> Column:
    """``x or default``: null or '' becomes the default."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def is_missing_key(c: ColumnLike) -> Column:
    """Key null, or blank/'nan'/'None' after strip (F9). Never null itself."""
    k = _c(c)
    return k.isNull() | strip(k).isin(*MISSING_KEY_TOKENS)


def token_clean_bulk(c: ColumnLike) -> Column:
    """Bulk value cleaning: strip; '', 'nan', 'None' become NULL."""
    v = strip(_c(c))
    return F.when(_c(c).isNull() | v.isin(*MISSING_KEY_TOKENS), F.lit(None)).otherwise(v)


def token_clean_scrape(c: ColumnLike) -> Column:
    """Scraped value cleaning: strip; '', nan, none, '-' (any case) dropped."""
    v = strip(F.coalesce(_c(c), F.lit("")))
    return F.when(F.lower(v).isin(*SCRAPE_NULL_TOKENS), F.lit(None)).otherwise(v)


def tag_split(c: ColumnLike) -> Column:
    """Comma list to trimmed array; blank gives no tags, a trailing comma an
    empty tag (X3)."""
    v = _c(c)
    return F.when(v.isNull() | (v == ""), F.array().cast("array<string>")).otherwise(
        F.transform(F.split(v, ","), lambda t: browser_trim(t)))


def tag_join(arr: ColumnLike) -> Column:
    """Join tags with ', ' (X4)."""
    return F.array_join(_c(arr), ", ")


def first_int(c: ColumnLike) -> Column:
    """First run of digits as a number, else NULL."""
    return F.nullif(F.regexp_extract(_c(c), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def html_escape(c: ColumnLike) -> Column:
    """Escape &, <, >, " in that order; NULL becomes '' (X13)."""
    v = F.coalesce(_c(c).cast("string"), F.lit(""))
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(raw), F.lit(ent))
    return v


def canonical_key(m: ColumnLike) -> Column:
    """Key-order independent fingerprint of a map: JSON list of [key, value]
    pairs sorted by key (X14)."""
    mc = _c(m)
    pairs = F.transform(F.array_sort(F.map_keys(mc)),
                        lambda k: F.to_json(F.array(k, F.element_at(mc, k))))
    return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))
