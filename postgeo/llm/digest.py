"""Document fingerprints: a digest of bucket quartiles that can be compared.

Three triplets of each window of four bytes are hashed into BUCKETS buckets by random tables.
Each bucket's count is coded by the quartile of all counts it lies in (two bits); before
these stand the length on a logarithmic scale and the ratios of the quartiles. Two digests
differ by the steps between their codes, of which BOUND at most count; the likeness falls
from 1 to 0 along it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postgeo.session import cut_lineage

BUCKETS, WINDOW = 128, 4
#: A step of the length's scale is a tenth; bytes of a digest: length, ratios, codes.
LENGTH_STEP, SIZE = 1.1, 2 + BUCKETS // 4
#: Difference from which on two digests are not alike at all.
BOUND = 256
#: Bytes of text that are counted at a time; longer texts are counted in slices.
SLICE = 1 << 20
ROWS = 512
_tables = np.stack([np.random.default_rng(12 + k).permutation(256) % BUCKETS for k in range(8)]).astype(np.uint8)
_codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
_steps = np.abs(_codes[:, None] - _codes[None])
#: Difference of two bytes of codes; opposite quartiles count double.
_apart = np.where(_steps == 3, 6, _steps).sum(2).astype(np.uint8)


def _slices(texts: Sequence[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Owners and slices of texts, about SLICE bytes together. A slice brings the bytes its
    last windows reach into; after the end of a text these are zero."""
    owners: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        t += b"\0" * (WINDOW - 1)
        for at in range(0, len(t) - WINDOW + 1, SLICE):
            part = t[at : at + SLICE + WINDOW - 1]
            owners.append(i)
            parts.append(part)
            size += len(part)
            if size >= SLICE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def bucket_counts(texts: Sequence[bytes]) -> np.ndarray:
    """Counts of the hashed triplets of every text, a row each."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    for owners, parts in _slices(texts):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        base = np.repeat(np.arange(len(parts)) * BUCKETS, size)
        # windows that begin in the last bytes of a slice belong to the next one or to none
        ends = np.cumsum(size)
        for k in range(1, WINDOW):
            base[ends - k] = len(parts) * BUCKETS
        base = base[: len(raw) - WINDOW + 1]
        b0, b1, b2, b3 = (raw[k : len(raw) - WINDOW + 1 + k] for k in range(WINDOW))
        t = _tables
        two = t[0][b0] ^ t[1][b1]
        counts = np.zeros((len(parts) + 1) * BUCKETS, np.int64)
        for h in (two ^ t[2][b2], two ^ t[3][b3], t[4][b0] ^ t[5][b2] ^ t[6][b3]):
            counts += np.bincount(base + h, minlength=len(counts))
        np.add.at(out, owners, counts[: len(parts) * BUCKETS].reshape(-1, BUCKETS))
    return out


def digests(texts: Sequence[bytes]) -> np.ndarray:
    """A row of SIZE bytes for every text."""
    out = np.zeros((len(texts), SIZE), np.uint8)
    if not len(texts):
        return out
    counts = bucket_counts(texts)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1, None] for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    out[:, 2:] = codes.reshape(len(texts), -1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    size = np.fromiter(map(len, texts), np.float64, len(texts))
    out[:, 0] = np.minimum(255, np.rint(np.log1p(size) / np.log(LENGTH_STEP)))
    top = np.maximum(q3, 1)
    out[:, 1] = (np.minimum(15, q1 * 16 // top) * 16 + np.minimum(15, q2 * 16 // top))[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of two arrays of digests; 1 for equal ones."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    differ = _apart[a[:, 2:], b[:, 2:]].sum(1, dtype=np.int64) + np.abs(a[:, 0] - b[:, 0])
    differ += np.abs((a[:, 1] >> 4) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15) - (b[:, 1] & 15))
    return 1 - np.minimum(differ, BOUND) / BOUND


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of every whole text in hexadecimal; null counts as empty.

    A column of the name ``out_col`` is replaced. Rows may repeat; an empty table stays empty.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    boxed = docs.select(F.struct(*kept).alias("_row"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(digests(texts)), pa.string())], ["_row", out_col])

    made = boxed.mapInArrow(run, f"_row {boxed.schema['_row'].dataType.simpleString()}, `{out_col}` string")
    return made.select("_row.*", f"`{out_col}`")


def compare(pairs: DataFrame, left: str, right: str, out_col: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of digests, null where one is null.

    A column of the name ``out_col`` is replaced. Digests are of this module's form.
    """
    kept = [F.col(f"`{c}`") for c in pairs.columns if c != out_col]
    boxed = pairs.select(F.struct(*kept).alias("_row"), F.col(f"`{left}`").alias("_a"), F.col(f"`{right}`").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            both = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
            sides = [np.frombuffer(bytes.fromhex("".join(x[i] for i in both)), np.uint8).reshape(-1, SIZE) for x in (a, b)]
            score: list = [None] * len(a)
            for i, s in zip(both, likeness(*sides).tolist()):
                score[i] = s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["_row", out_col])

    made = boxed.mapInArrow(run, f"_row {boxed.schema['_row'].dataType.simpleString()}, `{out_col}` double")
    return made.select("_row.*", f"`{out_col}`")


# --- documents against an edit of themselves and the next one ------------------------------

_FIELDS = [
    ("doc_id", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"),
    ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"),
]
_RESULT = ", ".join(f"{n} {t}" for n, _, t in _FIELDS)
#: Rows done, and the first and last text of a partition, which the next one decides.
_DONE, _HEAD, _TAIL = 0, 1, 2
_STEP = f"part int, edge int, text string, {_RESULT}"


def edited(text: str, following: str) -> str:
    """``text``, its last half replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judged(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    marks = digests(changed)
    cols = [
        ids, [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], _hex(own), _hex(marks),
        likeness(own, marks), likeness(own, after),
    ]
    return [pa.array(c, t) for c, (_, t, _) in zip(cols, _FIELDS)]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition, each judged with the one after it."""
    part, last, mark = TaskContext.get().partitionId(), None, np.zeros((0, SIZE), np.uint8)

    def step(edge: int, texts: list, cols: list[pa.Array]) -> pa.RecordBatch:
        n = len(cols[0])
        lead = [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(lead + cols, ["part", "edge", "text", *[f[0] for f in _FIELDS]])

    def open_row(edge: int, key, text: str) -> pa.RecordBatch:
        return step(edge, [text], [pa.array([key], pa.int64())] + [pa.nulls(1, t) for _, t, _ in _FIELDS[1:]])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            ids, texts = rows.column(0).to_pylist(), [t or "" for t in rows.column(1).to_pylist()]
            marks = digests([t.encode() for t in texts])
            if last is None:
                yield open_row(_HEAD, ids[0], texts[0])
            else:
                ids, texts, marks = [last[0], *ids], [last[1], *texts], np.concatenate([mark, marks])
            yield step(_DONE, [None] * (len(ids) - 1), _judged(ids[:-1], texts[:-1], texts[1:], marks[:-1], marks[1:]))
            last, mark = (ids[-1], texts[-1]), marks[-1:]
    if last is not None:
        yield open_row(_TAIL, *last)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, following = (c.to_pylist() for c in batch.columns)
        own, after = digests([t.encode() for t in texts]), digests([t.encode() for t in following])
        yield pa.RecordBatch.from_arrays(_judged(ids, texts, following, own, after), [f[0] for f in _FIELDS])


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint, that of its edited text (see ``edited``), and how alike it is to
    that and to the next row's, by rising id; the first follows the last.

    A null text counts as empty, a null id comes before all others. Rows of one id follow each
    other by a hash of their text (equal rows in any order, which changes nothing). Texts are
    dealt out once, by ranges of these; only the first and last text of a range are written and
    joined to their neighbours. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    steps = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_along, _STEP), "along")
    heads = steps.where(F.col("edge") == _HEAD).select("part", F.col("text").alias("following"))
    tails = steps.where(F.col("edge") == _TAIL).select("part", "doc_id", "text")
    # one number per range, as for any range partitioning
    parts = sorted(r.part for r in tails.select("part").collect())
    pairs = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    met = tails.join(pairs, "part").join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    done = steps.where(F.col("edge") == _DONE).select(*[f[0] for f in _FIELDS])
    return done.unionByName(met.mapInArrow(_across, _RESULT))
