"""String helpers as Column expressions (JVM side only)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, functions as F

from .fixed import SPACE_CHARS, rx

# Every Unicode decimal digit with its ASCII counterpart, built from the rule
# "general category Nd" so that numbers written in full-width digits count.
_DIGITS = [
    (c, str(unicodedata.digit(c)))
    for c in map(chr, range(128, sys.maxunicode + 1))
    if unicodedata.category(c) == "Nd"
]
_DIGITS_FROM = "".join(a for a, _ in _DIGITS)
_DIGITS_TO = "".join(b for _, b in _DIGITS)


def ascii_digits(c: Column) -> Column:
    """Replace any Unicode decimal digit by 0-9 (meant for short strings)."""
    return bind(c, lambda d: F.when(d.rlike(r"[^\x00-\x7f]"), F.translate(d, _DIGITS_FROM, _DIGITS_TO)).otherwise(d))


def strip(c: Column) -> Column:
    """Trim all Unicode white space at both ends.

    The trailing run is anchored by a look-behind, so each run of spaces inside
    the text is scanned once and the cost stays linear.
    """
    w = SPACE_CHARS
    return F.regexp_replace(c, rf"\A[{w}]+|(?<![{w}])[{w}]+\z", "")


def collapse(c: Column) -> Column:
    """Squeeze white-space runs to one space and trim."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE_CHARS}]+", " "))


def contains_ci(text_lower: Column, words: list[str]) -> Column:
    """True when one of the words occurs in an already lower-cased text."""
    hit = F.lit(False)
    for w in words:
        hit = hit | text_lower.contains(w.lower())
    return hit


def first_word(text_lower: Column, words: list[str]) -> Column:
    """First list entry contained in the text; list order decides."""
    out = F.when(text_lower.contains(words[0].lower()), F.lit(words[0]))
    for w in words[1:]:
        out = out.when(text_lower.contains(w.lower()), F.lit(w))
    return out


def find_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern)), F.lit(group))


def find_first(c: Column, pattern: str, group: int = 1) -> Column:
    """First match or NULL (``regexp_extract`` alone gives ''); the text is searched once, also
    where the result stands behind a condition."""
    return bind(F.regexp_extract(c, rx(pattern), group), lambda m: F.when(m != "", m))


def distinct_ci(arr: Column) -> Column:
    """Order-keeping, case-insensitive distinct of a string array."""
    return first_of_each(arr, F.lower)


def bind(value: Column, then) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def first_of_each(arr: Column, key) -> Column:
    """The first element for each value of ``key(element)``, in their old order.

    Equal keys meet by sorting, so the cost is that of a sort, not a search per element.
    """
    keyed = F.sort_array(F.transform(arr, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("x"))))

    def firsts(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None)), F.transform(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda e: e["key"]))
        new = F.zip_with(s, before, lambda e, k: F.when(e.isNotNull() & (k.isNull() | (e["key"] != k)), F.struct(e["i"].alias("i"), e["x"].alias("x"))))
        return F.transform(F.sort_array(F.filter(new, lambda e: e.isNotNull())), lambda e: e["x"])

    return bind(keyed, firsts)


# HTML ------------------------------------------------------------------------

# fixed values: entities replaced by strip_html, '&amp;' last
ENTITIES = [
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
]
INVISIBLE = r"(?is)<(?:script\b[^>]*>.*?</script[^>]*>|style\b[^>]*>.*?</style[^>]*>|!--.*?-->|!doctype[^>]*>)"
TAG = r"</?[a-zA-Z][^>]*>"


def drop_invisible(html: Column) -> Column:
    return F.regexp_replace(html, INVISIBLE, "")


def unescape(c: Column) -> Column:
    for name, ch in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def tag_text(html: Column, sep: str = "") -> Column:
    """Text of a piece of markup that is already free of invisible parts."""
    return unescape(F.regexp_replace(html, TAG, sep))


def strip_html(html: Column) -> Column:
    """Visible text of a page."""
    return tag_text(drop_invisible(html))
