"""Quality rules: how far a text's histograms are from those of its language."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgeo.operators.pin import pin
from postgeo.session import cut_lineage

#: Commonest words of a language that its reference holds, and texts that make a reference.
COMMON, REFERENCE_ROWS = 8, 20
#: Digits count with the small letters: numbers and keys inside prose are no sign of junk.
CLASSES = ["small", "upper", "space", "point", "symbol", "other"]
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
POINTS = r"[.,;:!?'\"()\-]+"
#: Guards: a histogram of fewer characters or words says nothing.
MIN_CHARS, MIN_WORDS = 200, 200
#: A text of fewer words fails the base rules.
MIN_BASE_WORDS = 50
#: Distances (0 to 1) beyond which a text is far from every language.
MAX_CHARS, MAX_WORDS = 0.13, 0.25


def _less(text: str, pattern: str) -> Column:
    """Characters of ``text`` in runs of ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _counted(ordered: Column) -> Column:
    """Map from each value of a sorted array to its count, in one pass over its runs."""
    new = lambda x, i: (i == 0) | (x != F.get(ordered, i - 1))
    starts = F.filter(F.transform(ordered, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())

    def lengths(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(ordered)))
        return F.zip_with(starts, F.slice(ends, F.lit(1), F.size(starts)), lambda a, b: b - a)

    return F.map_from_arrays(F.array_distinct(ordered), _let(starts, lengths))


def _marked(ordered: Column, same) -> Column:
    """Elements of a sorted array that equal a neighbour in the sense of ``same``.

    ``ordered`` is a column or lambda variable, so naming it again costs nothing.
    """
    n = F.size(ordered)
    after = F.zip_with(ordered, F.slice(ordered, F.lit(2), n), lambda a, b: F.coalesce(same(a, b), F.lit(False)))

    def either(after: Column) -> Column:
        before = F.concat(F.array(F.lit(False)), F.slice(after, F.lit(1), F.greatest(n - 1, F.lit(0))))
        marks = F.zip_with(after, before, lambda a, b: a | F.coalesce(b, F.lit(False)))
        return F.filter(F.zip_with(ordered, marks, lambda x, e: F.when(e, x)), lambda x: x.isNotNull())

    return _let(after, either)


def _places(windows: Column) -> Column:
    """Bits that number the windows: the smallest 2**k - 1 that is no less than their count."""
    return F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(F.size(windows) + 1.0))).cast("long") - 1, F.lit(0).cast("long"))


def _packed(windows: Column, low: Column) -> Column:
    """Sorted numbers with a window's hash above and its place in the ``low`` bits."""
    return F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))


def _covered(windows: Column, packed: Column, low: Column) -> Column:
    """Words inside windows of three that occur twice or more.

    The upper bits of the packed numbers find the windows that may repeat; only these are
    compared by their whole hash.
    """
    place = lambda x: x.bitwiseAND(low).cast("int")
    maybe = _marked(packed, lambda a, b: F.bitwise_not(low).bitwiseAND(a.bitwiseXOR(b)) == 0)
    whole = F.sort_array(F.transform(maybe, lambda x: F.struct(F.get(windows, place(x)).alias("h"), place(x).alias("i"))))
    at = F.sort_array(F.transform(_let(whole, lambda w: _marked(w, lambda a, b: a["h"] == b["h"])), lambda w: w["i"]))
    steps = F.aggregate(
        at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return steps


def _words(text: Column) -> Column:
    text = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(text) > 0, F.split(text, GAP)).otherwise(F.array().cast("array<string>"))


def common_words(docs: DataFrame, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Per language the COMMON words with the greatest mean share of a text, over all its
    rows that have the words the base rules ask for; languages with fewer than
    REFERENCE_ROWS such rows have none. A share is counted in millionths, so that sums do
    not depend on their order and one long text counts no more than others."""
    t = pin(docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_text")), words=_words(F.col("_text")))
    t = t.where(F.size("words") >= MIN_BASE_WORDS).select("lang", "words", F.round(1e6 / F.size("words")).cast("long").alias("share"))
    enough = t.groupBy("lang").count().where(F.col("count") >= REFERENCE_ROWS).select("lang")
    sums = t.select("lang", F.explode("words").alias("word"), "share").groupBy("lang", "word").agg(F.sum("share").alias("share"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "word"))
    rows = sums.join(enough, "lang", "left_semi").withColumn("place", best).where(F.col("place") <= COMMON).collect()
    return {lang: sorted(r["word"] for r in rows if r["lang"] == lang) for lang in sorted({r["lang"] for r in rows})}


def measure(docs: DataFrame, text_col: str, keep: list[str], listed: list[str]) -> DataFrame:
    """``keep`` plus the counts, the shares by CLASSES and the count of each of the ``listed`` words."""
    t = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    t = pin(
        t, _words=_words(F.col("_text")), _rest=F.regexp_replace("_text", r"[\p{L}\p{M}]+", ""),
        _lines=F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        _upper=F.length(F.regexp_replace("_text", r"\P{Lu}+", "")), _chars=F.length("_text"),
    )
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    t = pin(
        t.drop("_text"), n_words=n.cast("long"), _chars=F.col("_chars"), _upper=F.col("_upper"),
        _letters=F.col("_chars") - F.length("_rest"), _digit=_less("_rest", r"\p{Nd}+"), _space=_less("_rest", GAP),
        n_symbols=_less("_rest", SYMBOLS).cast("long"), _point=_less("_rest", POINTS),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _windows=F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<long>")),
        _common=F.sort_array(F.filter("_words", lambda w: w.isin(listed))),
    ).drop("_words", "_rest", "_lines")
    c = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    alike = F.col("_letters") + F.col("_digit")
    named = [alike - F.col("_upper"), F.col("_upper"), F.col("_space"), F.col("_point"), F.col("n_symbols")]
    other = F.col("_chars") - alike - F.col("_space") - F.col("_point") - F.col("n_symbols")
    # sorted in a step of its own, where generated code sorts plain numbers
    t = pin(t, _low=F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _places(F.col("_windows"))).otherwise(F.lit(-1).cast("long")))
    t = pin(t, _packed=F.when(F.col("_low") >= 0, _packed(F.col("_windows"), F.col("_low"))))
    repeated = F.when(
        F.col("_low") >= 0, _covered(F.col("_windows"), F.col("_packed"), F.col("_low"))
    ).otherwise(F.lit(0).cast("long"))
    return t.select(
        *keep, "n_words", (F.col("_chars") - F.col("_space")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        repeated.alias("n_repeat_words"), F.col("_chars").cast("long").alias("n_chars"),
        F.array(*[x / c for x in [*named, other]]).alias("by_class"),
        _counted(F.col("_common")).alias("counts"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def by_word(words: Column) -> Column:
    """Shares of the given words in a measured text, then that of all others."""
    w = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    shares = F.transform(words, lambda v: F.coalesce(F.try_element_at(F.col("counts"), v), F.lit(0)) / w)
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x))))


def references(measured: DataFrame, lang_col: str, common: dict[str, list[str]]) -> dict[str, dict[str, list]]:
    """Per language with common words and REFERENCE_ROWS rows that pass the base rules the
    median share of every bin over all of these; one small row per language reaches the driver."""
    if not common:
        return {}
    own = F.create_map(*[x for k, v in common.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    rows = measured.where(F.col(lang_col).isin(list(common)) & ~base_failed())
    rows = pin(rows, _own=F.try_element_at(own, F.col(lang_col)))
    rows = pin(rows, by_word=by_word(F.col("_own")))
    bins = {"by_class": len(CLASSES), "by_word": COMMON + 1}
    medians = [
        F.array(*[F.coalesce(F.percentile_approx(F.get(c, F.lit(i)), F.lit(0.5), F.lit(2000)), F.lit(0.0)) for i in range(k)]).alias(c)
        for c, k in bins.items()
    ]
    made = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("_n"), *medians).where(F.col("_n") >= REFERENCE_ROWS).collect()
    out = {}
    for r in made:
        words = common[r[lang_col]]
        # of a language with fewer different words the share of all others is the next bin
        parts = {"by_class": r["by_class"], "by_word": r["by_word"][: len(words) + 1]}
        out[r[lang_col]] = {"words": words} | {c: [v / max(sum(p), 1e-9) for v in p] for c, p in parts.items()}
    return out


def js_distance(histogram: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, 0 (equal) to 1 (nothing in common)."""
    part = lambda a, m: F.when(a > 0, a * F.ln(a / m)).otherwise(F.lit(0.0))
    both = F.zip_with(histogram, reference, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * math.log(2)))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Counts, base rule, distances and verdict per row.

    A text is kept if it passes the base rules and is near some language: by characters if
    it has MIN_CHARS of them, by common words if it has MIN_WORDS words. Null, empty and
    blank texts have zero counts and fail the base rules. Every language of ``lang_col``
    with REFERENCE_ROWS rows that pass gives a reference. A text of another language is
    judged by the base rules alone (its distances are 0); one of null language is compared
    with all references. Without any (also: empty table) only the base rules decide.
    Repeated rows repeat; other columns are not read.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_t"))
    common = common_words(keyed, "_t", "_lang")
    listed = sorted({w for ws in common.values() for w in ws})
    measured = cut_lineage(measure(keyed, "_t", ["_id", "_lang"], listed), "measured")
    refs = references(measured, "_lang", common)
    far = measured.withColumns({"class_distance": F.lit(0.0), "word_distance": F.lit(0.0)})
    if refs:
        many = lambda xs: F.array(*[F.lit(x) for x in xs])
        given = F.array(*[F.struct(*[many(r[c]).alias(c) for c in ("words", "by_class", "by_word")]) for r in refs.values()])
        judged = F.col("_lang").isNull() | F.col("_lang").isin(list(refs))
        nearest = lambda distance: F.when(judged, F.least(F.array_min(F.transform(given, distance)), F.lit(1.0))).otherwise(F.lit(0.0))
        far = pin(
            measured, class_distance=nearest(lambda r: js_distance(F.col("by_class"), r["by_class"])),
            word_distance=nearest(lambda r: js_distance(by_word(r["words"]), r["by_word"])),
        )
    odd = ((F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CHARS)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORDS)
    )
    return far.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~odd).alias("kept"), "class_distance", "word_distance",
    )
