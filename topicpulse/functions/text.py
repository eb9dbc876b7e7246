"""Text column expressions (JVM-side regular expressions; no Python row functions).

Character classes are spelled out so they mean the same as Python's Unicode
``\\s`` / ``\\w`` (Java's defaults are ASCII-only) and can be written the same way
in other engines' SQL:

* ``WS``   : Python's ``str.isspace`` set: ASCII controls + all ``\\p{Z}`` separators;
* ``WORD`` : letters, digits and ``_`` in any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_INNER = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
WS = f"[{WS_INNER}]"
NOT_WS = f"[^{WS_INNER}]"
WORD = r"[\p{L}\p{N}_]"
URL = rf"http{NOT_WS}+|www{NOT_WS}+"
DISPLAY_CHARS = 500


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_if(x: Column, needles: list[str], pattern: str) -> Column:
    """``regexp_replace(x, pattern, '')``, skipped for rows that contain none of the
    literal ``needles`` every match must contain (a byte search instead of a decode,
    regex scan and re-encode of the whole text). Same result either way."""
    has = None
    for n in needles:
        c = x.contains(n)
        has = c if has is None else has | c
    return F.when(has, F.regexp_replace(x, pattern, "")).otherwise(x)


def collapse_ws(c) -> Column:
    """Runs of whitespace -> one space, then strip (Python's ``" ".join(s.split())``)."""
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def normalise_text(c, max_chars: int | None = None) -> Column:
    """B1: collapse whitespace, trim; null -> ''. With ``max_chars`` only so many characters are kept."""
    x = collapse_ws(c)
    return F.coalesce(x if max_chars is None else F.substring(x, 1, max_chars), F.lit(""))


def full_text(title, content) -> Column:
    """Title + ' ' + content with nulls as '' (an empty title leaves a leading space)."""
    return F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(content), F.lit("")))


def strip_urls(c) -> Column:
    """Remove ``http...``/``www...`` runs, collapse whitespace, trim."""
    return collapse_ws(remove_if(_c(c), ["http", "www"], URL))


def display_text(c, max_chars: int = DISPLAY_CHARS) -> Column:
    """C2 as stored: the cleaned text cut to its first ``max_chars`` characters."""
    return F.substring(strip_urls(c), 1, max_chars)


def preprocess(c) -> Column:
    """Model preprocessing, in the original order of rules."""
    x = F.lower(_c(c))
    x = remove_if(x, ["http", "www"], rf"http{NOT_WS}+|www{NOT_WS}+|https{NOT_WS}+")
    x = remove_if(x, ["/r/"], rf"/r/{WORD}+")
    x = remove_if(x, ["/u/"], rf"/u/{WORD}+")
    x = remove_if(x, ["u/"], rf"u/{WORD}+")
    x = remove_if(x, ["&"], rf"&{WORD}+;")
    x = F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}_{WS_INNER}!?.,'\-]", "")
    return F.coalesce(collapse_ws(x), F.lit(""))


def keyword_tokens(cleaned) -> Column:
    """Lower-cased word tokens: every non-word, non-space character becomes a space and the
    text is split at whitespace, i.e. the maximal runs of word characters (one regex split)."""
    return F.filter(F.split(F.lower(_c(cleaned)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 0)


def is_blank(c) -> Column:
    """Null, empty or whitespace only."""
    return F.coalesce(F.length(collapse_ws(c)) == 0, F.lit(True))


def split_list(c, drop_blanks: bool = True) -> Column:
    """C17: 'a, b ,c' -> ['a','b','c'] (blanks dropped as the dashboard does)."""
    parts = F.transform(F.split(_c(c), ","), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 0) if drop_blanks else parts


# --- C12 pattern entities (on the original text) ---------------------------------
# fixed values: the three patterns and their confidences
ORG_PATTERN = rf"\b([A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*)\b"
MONEY_PATTERN = r"(?i)\$[\d,]+(?:\.\d{2})?|\d+(?:,\d{3})*(?:\.\d{2})?" + WS + r"*(?:dollars?|USD)"
PERCENT_PATTERN = r"\d+(?:\.\d+)?%"
ORG_CONF, MONEY_CONF, PERCENT_CONF = 0.7, 0.9, 0.9


def _entity(kind: str, conf: float):
    return lambda m: F.struct(m.alias("text"), F.lit(kind).alias("entity_type"),
                              F.lit(conf).alias("confidence"))


def entities(c, stopwords: list[str], caps: tuple | None = None) -> Column:
    """Capitalised runs (len<=2 and stop words dropped), money, percentages, concatenated in
    that order, as ARRAY<STRUCT<text,entity_type,confidence>>. ``caps`` = (runs, money, percentages)
    keeps only the first so many matches of each kind (runs are cut before any is dropped)."""
    txt = F.coalesce(_c(c), F.lit(""))
    stop = F.array(*[F.lit(w) for w in stopwords])
    first = lambda x, k: x if caps is None else F.slice(x, 1, caps[k])
    orgs = F.filter(first(F.regexp_extract_all(txt, F.lit(ORG_PATTERN), 1), 0),
                    lambda m: (F.length(m) > 2) & ~F.array_contains(stop, F.lower(m)))
    money = first(F.regexp_extract_all(txt, F.lit(MONEY_PATTERN), 0), 1)
    pct = first(F.regexp_extract_all(txt, F.lit(PERCENT_PATTERN), 0), 2)
    return F.concat(F.transform(orgs, _entity("ORG_OR_PERSON", ORG_CONF)),
                    F.transform(money, _entity("MONEY", MONEY_CONF)),
                    F.transform(pct, _entity("PERCENT", PERCENT_CONF)))


def entities_flat(c) -> Column:
    """'TYPE:text|TYPE:text' rendering of an entity array (for display and checks)."""
    return F.array_join(F.transform(_c(c), lambda e: F.concat(e["entity_type"], F.lit(":"), e["text"])), "|")
