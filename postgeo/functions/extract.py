"""Facts taken from the text of one post: pay, category, date, city, addresses.

All functions map Columns to Columns and run inside the JVM. Patterns that start
with a run of letters are tried only where such a run starts or where the
previous match ended (``run_start``). A match found later inside a run can always
be extended back to the start of the run, so the result is the same while the
cost drops from quadratic to linear in the length of the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.pin import pin
from . import fixed as X
from .fixed import SPACE_CHARS, rx
from .text import ascii_digits, bind, collapse, contains_ci, distinct_ci, find_all, find_first, first_word, strip

BIGINT_MAX = 9223372036854775807


def run_start(char_class: str) -> str:
    return rf"(?:\G|(?<!{char_class}))"


# --- pay -----------------------------------------------------------------------


def _whole_number(c: Column) -> Column:
    """Digits to BIGINT; numbers beyond BIGINT saturate so that the later check
    of the stored range still rejects the row instead of storing NULL."""
    return F.when(
        c.isNotNull(), F.coalesce(ascii_digits(c).try_cast("bigint"), F.lit(BIGINT_MAX))
    )


def wage_numbers(body: Column) -> Column:
    return find_all(F.replace(body, F.lit(","), F.lit("")), "(<D>+)")


def wage_from_numbers(numbers: Column) -> tuple[Column, Column]:
    """(wage_min, wage_max): first and last number of the whole text."""
    return (
        _whole_number(F.try_element_at(numbers, F.lit(1))),
        _whole_number(F.try_element_at(numbers, F.lit(-1))),
    )


ANCHORED_WAGE = (
    r"(?i)\$[<W>]*(<D>+)(?:\.<D>+)?(?:[<W>]*[-~–][<W>]*\$?[<W>]*(<D>+)(?:\.<D>+)?)?"
    r"[<W>]*(?:/|per)[<W>]*(?:hour|hr|h)(?![A-Za-z])"
)


def anchored_wage(body: Column) -> tuple[Column, Column]:
    """(wage_min, wage_max) from ``$XX/hour`` or ``$XX-XX/hour`` only."""
    low = find_first(body, ANCHORED_WAGE, 1)
    high = find_first(body, ANCHORED_WAGE, 2)
    return _whole_number(low), _whole_number(F.coalesce(high, low))


# --- category, city, date --------------------------------------------------------


def category(title: Column, body: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))
    out = None
    for name, words in X.CATEGORY_WORDS:
        hit = contains_ci(text, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(X.CATEGORY_DEFAULT))


def city_hint(text: Column) -> Column:
    return first_word(F.lower(text), X.HINT_CITIES)


def posted_date(text: Column) -> Column:
    """First valid date; a pattern whose first match is no date is passed over."""
    tries = []
    for pattern, fmt in X.DATE_PATTERNS:
        d = F.try_to_date(ascii_digits(find_first(text, f"({pattern})")), fmt)
        tries.append(bind(d, lambda d: F.when(F.year(d) >= 1, d)))
    return F.coalesce(*tries).cast("timestamp")


# --- addresses --------------------------------------------------------------------
#
# Letter case is ignored by spelling out both cases in character classes: the
# regex engine then tests plain classes, which is several times faster than its
# Unicode case-insensitive mode. S, K and I have extra forms that fold to them.

FOLDED = {"s": "ſ", "k": "\u212a", "i": "İı"}
LETTERS = "A-Za-zſ\u212aİı"


def any_case(pattern: str) -> str:
    """Spell out both cases of the ASCII letters outside classes and tokens."""

    def spell(m: re.Match) -> str:
        c = m.group(0)
        if len(c) > 1:
            return c.replace("A-Z", LETTERS) if c == "[A-Z]" else c
        return f"[{c.upper()}{c.lower()}{FOLDED.get(c.lower(), '')}]"

    return re.sub(r"\[[^\]]*\]|<[WD]>|[A-Za-z]", spell, pattern)


def any_of(words: str) -> str:
    return "(?:" + any_case(words) + ")"


LETTER_RUN = f"[A-Za-z<W>{LETTERS[6:]}]"
STORE_RUN = f"[A-Za-z<W>&{LETTERS[6:]}]"
WORD = f"[{LETTERS}]"
_POST = any_case(X.POSTCODE)
_TAIL = rf"[,<W>]+{LETTER_RUN}+(?:,[<W>]*)?"
_STREET = rf"<D>+{WORD}?[<W>]{LETTER_RUN}+"
_NUMBER = rf"(?=<D>){run_start('<D>')}"

STREET_PATTERNS = [
    rf"{_NUMBER}({_STREET}{any_of(X.STREET_WORDS_LONG)}{_TAIL}(?:{_POST}|{any_of(X.PROVINCES)})?)",
    rf"{_NUMBER}({_STREET}{any_of(X.STREET_WORDS)}[,<W>]+{LETTER_RUN}+)",
    rf"{run_start(LETTER_RUN)}({LETTER_RUN}+{any_of(X.STREET_WORDS)}{_TAIL}(?:{_POST}|{any_of(X.PROVINCES)})?)",
]
# strict mode: a house number is required and the street word must be a whole word
STRICT_PATTERN = (
    rf"{_NUMBER}({_STREET}(?<!{WORD}){any_of(X.STREET_WORDS_LONG)}(?!{WORD})"
    rf"{_TAIL}(?:{_POST}|{any_of(X.PROVINCES)})?)"
)
AREA_CITY_PATTERN = (
    rf"{run_start(WORD)}({WORD}{{2,}}{any_of(X.AREA_ENDINGS)}[,<W>]+{any_of(X.AREA_CITIES)})"
)
AREA_WORD_PATTERN = (
    rf"{run_start(WORD)}({WORD}{{2,}}(?:・|/|[<W>]+){WORD}{{2,}}{any_of(X.AREA_WORDS)})"
)
STORE_STREET_PATTERN = (
    rf"(?:{run_start(STORE_RUN)}{STORE_RUN}+{any_of('|'.join(X.STORE_WORDS_ADDRESS))}[,<W>]+)?"
    rf"{_NUMBER}{_STREET}{any_of(X.STREET_WORDS)}{_TAIL}(?:{_POST})?"
)


def search_form(text: Column) -> Column:
    """Lower-case form for quick word tests; the letters that only fold to s and i
    are replaced, so a word matched in any case is always found here."""
    for odd, plain in (("ſ", "s"), ("İ", "i"), ("ı", "i")):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


# Street, area and store patterns consist of these characters only. A text is cut at all
# others, the pieces without an anchor (a street word before a comma or space, a city, an
# area word) are left out, and the patterns run over the rest. No match can reach across
# a cut, so the result is that over the whole text.
CUT = "\u0001"
_AREA_SIGNS = "".join(sorted({c for c in X.AREA_WORDS if ord(c) > 127}))
_BARRIER = rf"[^{LETTERS}<D><W>,&・/{_AREA_SIGNS}]+"
STREET_ANCHORS = [w.lower() + c for w in X.STREET_WORDS_LONG.split("|") for c in " ,"]
AREA_ANCHORS = [w.lower() for w in [*X.AREA_CITIES.split("|"), *X.AREA_WORDS.split("|")]]


#: White space that is no plain space.
_ODD_SPACE = f"[{SPACE_CHARS}&&[^ ]]"


def pieces(text: Column) -> Column:
    return F.split(text, rx(_BARRIER))


def anchored(text_pieces: Column, low_pieces: Column, anchors: list[str]) -> Column:
    """The pieces whose search form holds an anchor, with cuts between them."""
    held = F.zip_with(text_pieces, low_pieces, lambda t, low: F.when(contains_ci(low, anchors), t))
    return F.array_join(F.filter(held, lambda t: t.isNotNull()), CUT)


def _found_if(condition: Column, matches: Column) -> Column:
    return F.when(condition, matches).otherwise(F.array().cast("array<string>"))


def _label_word(label: str) -> str:
    """The plain word of a label pattern."""
    return re.sub(r"[\[<].*", "", label.split("[<W>]+", 1)[-1] if label.startswith("Work") else label)


def labelled_addresses(text: Column, low: Column) -> Column:
    """Rest of the line behind an address label. ``low``: search form of the text."""
    found = F.concat(
        *[
            _found_if(
                contains_ci(low, [_label_word(label)]), find_all(text, rf"{any_case(label)}([^\n]+)")
            )
            for label in X.ADDRESS_LABELS
        ]
    )
    clean = F.transform(found, collapse)
    return F.filter(
        clean,
        lambda a: (F.length(a) > 5) & ~a.contains("@") & ~F.lower(a).contains("http"),
    )


def _trimmed(arr: Column, longer_than: int) -> Column:
    return F.filter(F.transform(arr, strip), lambda a: F.length(a) > longer_than)


def area_names(text: Column, low: Column) -> Column:
    by_city = _found_if(contains_ci(low, X.AREA_CITIES.split("|")), find_all(text, AREA_CITY_PATTERN))
    by_word = _found_if(contains_ci(low, X.AREA_WORDS.split("|")), find_all(text, AREA_WORD_PATTERN))
    return _trimmed(F.concat(by_city, by_word), 5)


def store_addresses(text: Column) -> Column:
    """Store name and street of each match; the street starts at the first digit."""
    joined = F.transform(
        find_all(text, STORE_STREET_PATTERN, 0),
        lambda m: F.trim(
            F.concat(
                strip(F.regexp_extract(m, r"\A[^\p{Nd}]*", 0)),
                F.lit(" "),
                strip(F.regexp_extract(m, r"(?s)\p{Nd}.*\z", 0)),
            )
        ),
    )
    return F.filter(joined, lambda a: F.length(a) > 10)


def with_addresses(df: DataFrame, text: str, out: str, mode: str = "reference") -> DataFrame:
    """Adds all addresses of a text, first by kind of rule, then by place. A null text has none.

    ``mode='reference'`` keeps the loose street rules, under which a street word
    may sit inside another word; ``mode='strict'`` wants a house number and a
    whole street word.

    Each text is cut once and the rules for streets and areas run over its anchored pieces
    (see ``anchored``). Where the first street rule finds nothing, the narrower numbered
    rules cannot find anything either and are skipped.
    """
    body, low, streets, numbered = F.col(text), F.col("_low"), F.col("_streets"), F.col("_numbered")
    first = STREET_PATTERNS[0] if mode == "reference" else STRICT_PATTERN
    df = pin(df, _low=search_form(body))
    # the search form keeps the cuts, as no other character folds to one of the pieces
    df = pin(df, _pieces=pieces(body), _low_pieces=pieces(F.regexp_replace(low, _ODD_SPACE, " ")))
    cut = [F.col("_pieces"), F.col("_low_pieces")]
    df = pin(df, _streets=anchored(*cut, STREET_ANCHORS), _areas=anchored(*cut, AREA_ANCHORS)).drop("_pieces", "_low_pieces")
    df = pin(df, _numbered=find_all(streets, first))
    some = F.size("_numbered") > 0
    if mode == "reference":
        found = [
            _trimmed(numbered, 10),
            _found_if(some, _trimmed(find_all(streets, STREET_PATTERNS[1]), 10)),
            _trimmed(find_all(streets, STREET_PATTERNS[2]), 10),
        ]
        stores = [_found_if(some, store_addresses(streets))]
    else:
        found, stores = [_trimmed(numbered, 10)], []
    parts = [labelled_addresses(body, low), *found, area_names(F.col("_areas"), low), *stores]
    # pinned: what is taken from the addresses must not find them anew
    return pin(df, **{out: distinct_ci(F.concat(*parts))}).drop("_low", "_streets", "_areas", "_numbered")


# --- store name and location text ---------------------------------------------------

STORE_LABEL_PATTERNS = [rf"{any_case(label)}([^\n]+)" for label in X.STORE_LABELS]
STORE_NAME_PATTERN = rf"(?<!{STORE_RUN})({STORE_RUN}+{any_of('|'.join(X.STORE_WORDS))})"


def store_name(body: Column, title: Column) -> Column:
    """The title if it names a kind of store, else the first name in the body."""
    named = F.when(contains_ci(F.lower(title), X.STORE_WORDS), title)
    tries = []
    for pattern in [*STORE_LABEL_PATTERNS, STORE_NAME_PATTERN]:
        tries.append(bind(strip(find_first(body, pattern)), lambda s: F.when(F.length(s) > 3, s)))
    by_name = F.when(contains_ci(search_form(body), X.STORE_WORDS), tries.pop())
    return F.coalesce(named, *tries, by_name)


def location_text(first_address: Column, store: Column, hint: Column) -> Column:
    """First address, completed by the city; else store and city; else the city."""
    low = F.lower(first_address)
    complete = contains_ci(low, X.ADDRESS_CITIES) | low.contains(F.lower(hint))
    return (
        F.when(
            first_address.isNotNull(),
            F.when(hint.isNull() | complete, first_address).otherwise(
                F.concat(first_address, F.lit(", "), hint, F.lit(", BC"))
            ),
        )
        .when(store.isNotNull() & hint.isNotNull(), F.concat(store, F.lit(", "), hint, F.lit(", BC")))
        .when(hint.isNotNull(), F.concat(hint, F.lit(", BC")))
    )


# --- contacts (for duplicate detection; only hashes leave this function) -------------

PHONE = (
    r"(?<![A-Za-z0-9_])(?:1[-. ]?)?\(?([0-9]{3})\)?[-. ]{0,2}([0-9]{3})[-. ]?([0-9]{4})(?![A-Za-z0-9_])"
)
EMAIL = r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)"


def contact_hashes(body: Column) -> Column:
    """Distinct SHA-256 fingerprints of the phone numbers and e-mail addresses."""
    phones = F.transform(
        find_all(body, PHONE, 0),
        lambda p: F.concat(
            F.lit("tel:"), F.substring(F.regexp_replace(p, "[^0-9]", ""), -10, 10)
        ),
    )
    mails = F.transform(find_all(body, EMAIL, 1), lambda m: F.concat(F.lit("mail:"), F.lower(m)))
    return F.transform(F.array_distinct(F.concat(phones, mails)), lambda k: F.sha2(k, 256))
