"""Spelling variants: words one edit apart, by permuterm rotations.

A word w with its terminator has len(w) + 1 rotations. Two words differ by one replaced
code point if a rotation of each agrees in all but its last one; a word is another one with
a code point put in if its whole rotation is the other's rotation without the last one. So
every rotation is laid out twice, whole and without its last code point, all are sorted, and
equal ones, lying side by side, are scanned. Such a group has at most one whole rotation and
one other per letter of the alphabet, so no group grows with the table.

A rotation is told by its length and three residues of its polynomial hash (93 bits), taken
from running sums, so the rows of a word of any length are as many as its rotations and of
fixed size. Words are numbered in code-point order; numbers travel, texts join back once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postgeo.session import cut_lineage

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a run consists of, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: One of so many runs per document loses a code point.
DAMAGED = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
_PRIMES = (2147483647, 2147483629, 2147483587)
_BASES = (1103515245, 1664525, 22695477)
#: Code points of all words that are turned at a time; a longer word stands alone.
_BLOCK = 1 << 20
_WHOLE, _FIRST, _OTHER = 0, 1, 2
_ROTATION = "a long, b long, kind byte, no long, n long"
_NEAR = "no long, n_near long, form_n long, form_no long"


# --- words of documents ----------------------------------------------------------------


def damaged(key: Column, run: Column, least: int = LEAST_LENGTH) -> Column:
    """The run, without one code point where the checksum of ``key:run`` says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(DAMAGED)) == 0, cut).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH,
                count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all whole texts: words of ``least`` code points with ``count`` occurrences.

    A null text has no words, a null id counts as an empty one, repeated rows count again.
    """
    lower = F.translate(F.col(text_col), UPPER, SMALL)
    # a shorter run cannot give a word, as an edit only shortens it
    runs = F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select(
        damaged(F.col("id"), F.col("run")).alias("word")
    )
    counts = words.where(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= count)


# --- rotations ------------------------------------------------------------------------


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n]


def rotations(words: list[str]) -> tuple[np.ndarray, ...]:
    """(a, b, kind, owner): both forms of every rotation of every word.

    ``kind`` is _WHOLE, or for a rotation without its last code point _FIRST where that one
    is not repeated right after it (so that each inserted or deleted one is met once), else
    _OTHER.
    """
    codes = np.frombuffer("".join(w + "\0" + w + "\0" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(2 * size)])[:-1]
    owner = np.repeat(np.arange(len(words)), size)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    start, whole = begin[owner] + turn, size[owner]
    skipped = np.flatnonzero(turn > 0)
    starts = np.concatenate([start, start[skipped]])
    ends = np.concatenate([start + whole, (start + whole - 1)[skipped]])
    parts = []
    for prime, base in zip(_PRIMES, _BASES):
        p, up = np.uint64(prime), _powers(base, prime, len(codes))
        down = _powers(pow(base, -1, prime), prime, len(codes))
        total = np.concatenate([[np.uint64(0)], np.cumsum(codes * up % p, dtype=np.uint64)])
        parts.append((total[ends] - total[starts]) % p * down[starts] % p)
    a = (parts[0] << np.uint64(31) | parts[1]).astype(np.int64)
    b = (parts[2] << np.uint64(32)).astype(np.int64) | (ends - starts)
    # the one left out stands just before the rotation, and the next one at its start
    first = codes[start[skipped] - 1] != codes[start[skipped]]
    kind = np.concatenate([np.full(len(start), _WHOLE, np.int8), np.where(first, _FIRST, _OTHER).astype(np.int8)])
    return a, b, kind, np.concatenate([owner, owner[skipped]])


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1).to_pylist()
        no, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        begin = 0
        while begin < len(words):
            end, points = begin, 0
            while end < len(words) and (end == begin or points + 2 * len(words[end]) <= _BLOCK):
                points += 2 * len(words[end]) + 2
                end += 1
            a, b, kind, owner = rotations(words[begin:end])
            owner = owner + begin
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, kind, no[owner], n[owner])], ["a", "b", "kind", "no", "n"])
            begin = end


# --- scan of the sorted rotations -------------------------------------------------------


def _neighbours(a, b, kind, no, n) -> Iterator[tuple[np.ndarray, ...]]:
    """(no, n_near, form_n, form_no) from whole groups, sorted: the whole rotation first, then
    by falling n and rising number. A word comes up once per group in which it has near words."""
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    start = np.flatnonzero(new)
    group, size = np.cumsum(new) - 1, np.diff(np.append(start, len(a)))
    has = kind[start] == _WHOLE
    lead, skips = start + has, size - has
    # replaced: all rotations without their last code point are near each other
    row = np.flatnonzero((kind != _WHOLE) & (skips[group] > 1))
    best = np.where(row == lead[group[row]], row + 1, lead[group[row]])
    yield no[row], skips[group[row]] - 1, n[best], no[best]
    # put in: the whole rotation is near every other one, met at its first place
    row = np.flatnonzero((kind == _FIRST) & has[group])
    best = start[group[row]]
    yield no[row], np.ones(len(row), np.int64), n[best], no[best]
    at, first, many = np.unique(group[row], return_index=True, return_counts=True)
    yield no[start[at]], many, n[row[first]], no[row[first]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def near(rows):
        for part in _neighbours(*rows) if len(rows[0]) else ():
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in part], ["no", "n_near", "form_n", "form_no"])

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(5)]
        if left is not None:
            rows = [np.concatenate(x) for x in zip(left, rows)]
        a, b = rows[:2]
        turns = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        cut = turns[-1] + 1 if len(turns) else 0
        yield from near([x[:cut] for x in rows])
        left = [x[cut:] for x in rows]
    if left is not None:
        yield from near(left)


def near_words(words: DataFrame) -> DataFrame:
    """(no, n_near, form_n, form_no) for every word of (no, word, n) that has near words: how
    many, and the one of largest n, of these the one of smallest number."""
    turned = words.select("no", "word", "n").mapInArrow(_laid_out, _ROTATION)
    order = [F.col("a"), F.col("b"), F.col("kind") != _WHOLE, F.desc("n"), F.col("no")]
    scanned = turned.repartition("a", "b").sortWithinPartitions(*order).mapInArrow(_scan, _NEAR)
    found = scanned.groupBy("no").agg(
        F.sum("n_near").alias("n_near"), F.max(F.struct("form_n", (-F.col("form_no")).alias("back"))).alias("best")
    )
    return found.select("no", "n_near", F.col("best.form_n").alias("form_n"), (-F.col("best.back")).alias("form_no"))


# --- forms and roots --------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(no, root_no): the last of each chain no -> form_no. Every step of a chain has a larger
    n by a factor over 1, so chains are short; a round doubles the reach."""
    roots = cut_lineage(forms.select("no", F.col("form_no").alias("root_no")), "roots")
    while True:
        after = roots.select(F.col("no").alias("root_no"), F.col("root_no").alias("next"))
        step = cut_lineage(roots.join(after, "root_no", "left").select("no", F.coalesce("next", "root_no").alias("root_no"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("no", "root_no")
        roots = step.drop("moved")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``counts`` (word, n).

    ``form`` is the near word of largest n (ties: smallest in code-point order), if that is
    at least ``ratio`` (over 1) times the word's own; ``root`` ends the chain of forms, the
    word itself if it has none. Words are distinct and not null and n is; words may be of any length and
    letters (but the zero character, the terminator). An empty table gives no rows; other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("a form must occur more often than its variants")
    words = counts.select("word", "n").orderBy("word").withColumn("no", F.monotonically_increasing_id())
    words = cut_lineage(words, "words")
    best = near_words(words).withColumnRenamed("form_n", "near_n")
    held = F.col("near_n") >= ratio * F.col("n")
    judged = cut_lineage(
        words.join(best, "no", "left").select(
            "no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(held, F.col("near_n")).alias("form_n"), F.when(held, F.col("form_no")).alias("form_no"),
        ), "judged",
    )
    forms = judged.where(F.col("form_no").isNotNull()).select("no", "form_no")
    named = (
        forms.join(_roots(forms), "no")
        .join(words.select(F.col("no").alias("form_no"), F.col("word").alias("form")), "form_no")
        .join(words.select(F.col("no").alias("root_no"), F.col("word").alias("root")), "root_no")
        .select("no", "form", "root")
    )
    return judged.join(named, "no", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
