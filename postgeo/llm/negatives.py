"""Hard negatives of anchors, by angular triangle filtering.

Every row stores its angles to a few reference directions. For an anchor and a row the angle
between them is at least the difference and at most the sum of their angles to any
reference, which gives an interval of the cosine; times both lengths, widened by all
rounding, it bounds the integer inner product. Only rows whose bounds overlap a window of
scores that can still matter are scored.

Anchors meet all rows in blocks of bounded size, dealt by hash of row numbers, so no label,
id or vector can make a block large. A first pass finds each anchor's positives, a second
one its negatives in the windows that these give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from postgeo.session import cut_lineage

#: Reference directions, chosen far apart among at most so many rows of smallest hash.
REFERENCES, SAMPLED = 8, 512
#: Rows and anchors of a block at most, about; anchors bounded at a time.
ROWS, ANCHORS, TOGETHER = 2048, 512, 64
#: Stored angles are whole steps; an angle and its rounding stay within one step.
STEPS = 1 << 15
SCALE = 256
#: Whole-number vectors up to this length are multiplied in doubles without rounding.
EXACT = 1 << 53
#: Vectors below this length have inner products that fit into 64 bits.
LONGEST = 1 << 31


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Lists of numbers as rows, short ones filled up with zero."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), wide), column.type.value_type.to_pandas_dtype())
    out[np.arange(wide) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(vectors.astype(np.float64)).sum(1))


def angle_steps(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to references, in steps (0 to STEPS for 0 to pi)."""
    size = np.maximum(_lengths(vectors), 1e-300)
    cos = (vectors / size[:, None]) @ references.T
    return np.rint(np.arccos(np.clip(cos, -1, 1)) * (STEPS / np.pi)).astype(np.int32)


def pick_references(vectors: np.ndarray, many: int) -> np.ndarray:
    """Unit rows that are far apart: each next one is farthest from those picked."""
    size = _lengths(vectors)
    rows = vectors[size > 0] / size[size > 0, None]
    picked = rows[:1]
    while 0 < len(picked) < min(many, len(rows)):
        nearest = (rows @ picked.T).max(1)
        if nearest.min() > 1 - 1e-9:
            break
        picked = np.concatenate([picked, rows[[nearest.argmin()]]])
    return picked


def score_bounds(
    a_angles: np.ndarray, a_size: np.ndarray, angles: np.ndarray, size: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products possible, whole numbers as doubles, a row per anchor.

    Both stored angles may be off by one step each, the cosine, the lengths and their product
    by a few units in the last place; a score is whole, so one more each way covers those.
    """
    apart = np.zeros((len(a_angles), len(angles)), np.int32)
    over = np.full(apart.shape, STEPS, np.int32)
    for k in range(angles.shape[1]):
        mine, theirs = a_angles[:, None, k], angles[None, :, k]
        np.maximum(apart, np.abs(mine - theirs), out=apart)
        both = mine + theirs
        np.minimum(over, np.minimum(both, 2 * STEPS - both), out=over)
    cos = np.cos(np.arange(STEPS + 1) * (np.pi / STEPS))
    most = a_size[:, None] * size
    slack = 1 + np.abs(most) * 1e-12
    high = np.ceil(most * cos[np.maximum(apart - 2, 0)] + slack)
    low = np.floor(most * cos[np.minimum(over + 2, STEPS)] - slack)
    return low, high


def _scores(vectors: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of some rows with one anchor."""
    if exact:
        return (vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return (vectors * anchor).sum(1)


class _Block:
    """Rows of a cell as arrays."""

    def __init__(self, table: pa.Table, wide: int):
        table = table.combine_chunks()
        col = {n: table.column(n).combine_chunks() for n in table.column_names}
        self.no, self.id, self.label = (col[n].to_numpy(zero_copy_only=False) for n in ("no", "vec_id", "label"))
        self.vector, self.angles = _matrix(col["vector"], wide), _matrix(col["angles"], REFERENCES)
        self.size = _lengths(self.vector)
        self.table = table


def _wide(*tables: pa.Table) -> int:
    return max(pc.max(pc.list_value_length(t.column("vector"))).as_py() or 0 for t in tables)


def _first(order: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``order`` the first ``k``: higher scores, then smaller ids."""
    if len(order) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = scores >= edge
        order, ids, scores = order[held], ids[held], scores[held]
    return order[np.lexsort((ids, -scores))[:k]]


def _cell(anchors: _Block, rows: _Block):
    """(anchor, low, high, scorer) for every anchor: bounds to all rows, and exact scores of some."""
    longest = float(anchors.size.max(initial=0)) * float(rows.size.max(initial=0))
    for at in range(0, len(anchors.no), TOGETHER):
        part = slice(at, at + TOGETHER)
        low, high = score_bounds(anchors.angles[part], anchors.size[part], rows.angles, rows.size)
        for i in range(len(low)):
            yield at + i, low[i], high[i], lambda idx, v=anchors.vector[at + i]: _scores(rows.vector[idx], v, longest < EXACT / 4)


def _positives(k: int):
    """Cell function: per anchor its first ``k`` rows of the same label; one that has the
    anchor's own id and score is the anchor itself and is told apart later."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            wide = _wide(left, right)
            anchors, rows = _Block(left, wide), _Block(right, wide)
            for i, _, high, score in _cell(anchors, rows):
                same = np.flatnonzero(rows.label == anchors.label[i])
                # the rows of the highest bounds set the score that others must be able to reach
                lead = same[np.argpartition(-high[same], k - 1)[:k]] if len(same) > k else same
                if len(same) > k:
                    same = same[high[same] >= score(lead).min()]
                s = score(same)
                best = _first(np.arange(len(same)), rows.id[same], s, k)
                out += [(anchors.no[i], rows.id[same[j]], s[j]) for j in best]
        return _table(out, ["a_no", "other", "score"])

    return run


def _negatives(k: int, window: tuple[int, int, int]):
    """Cell function: per anchor and positive the first ``k`` rows of another label whose score
    lies in the positive's window."""
    lower, unit, upper = window

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            wide = _wide(left, right)
            anchors, rows = _Block(left, wide), _Block(right, wide)
            wanted = anchors.table.column("positives").to_pylist()
            for i, low, high, score in _cell(anchors, rows):
                spans = [(-(-lower * p["score"] // unit), upper * p["score"] // unit, p) for p in wanted[i]]
                spans = [x for x in spans if x[0] <= x[1]]
                if not spans:
                    continue
                reach = np.zeros(len(low), bool)
                for a, b, _ in spans:
                    reach |= (high >= a) & (low <= b)
                idx = np.flatnonzero(reach & (rows.label != anchors.label[i]))
                s = score(idx)
                order = np.lexsort((rows.id[idx], -s))
                idx, s = idx[order], s[order]
                for a, b, p in spans:
                    # falling scores: the window is one stretch
                    begin, end = np.searchsorted(-s, -b, "left"), np.searchsorted(-s, -a, "right")
                    for j in range(begin, min(end, begin + k)):
                        out.append((anchors.no[i], p["place"], rows.id[idx[j]], s[j]))
        return _table(out, ["a_no", "place", "other", "score"])

    return run


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.table({n: pa.array([int(x) for x in c], pa.int64()) for n, c in zip(names, cols)})


def prepare(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str, changed: int | None = 7) -> DataFrame:
    """(no, vec_id, label, vector, angles) of the rows that take part. Written.

    Left out are rows with a null id or label, a null vector or component, a component that is
    not finite, or a vector of LONGEST whole steps or more. Labels of ids divisible by
    ``changed`` become (label + 1) % 10.
    """
    given = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), given.alias("given"))
    fine = F.forall("given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select("vec_id", "label", F.transform("given", lambda x: F.floor(x * SCALE)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.where(square < float(LONGEST) ** 2)
    label = F.col("label")
    if changed:
        label = F.when(F.col("vec_id") % changed == 0, (label + 1) % 10).otherwise(label)
    rows = rows.select("vec_id", label.alias("label"), F.col("v").cast("array<long>").alias("vector"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLED).collect()
    wide = max([0, *(len(r.vector) for r in sample)])
    given = np.array([r.vector + [0] * (wide - len(r.vector)) for r in sample], np.float64).reshape(len(sample), wide)
    references = pick_references(given, REFERENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            longest = max([wide, *np.diff(column.offsets.to_numpy()).tolist()])
            full = np.zeros((REFERENCES, longest))
            full[: len(references), :wide] = references
            # directions that do not exist stand at a right angle to everything: no bound
            steps = angle_steps(_matrix(column, longest).astype(np.float64), full)
            steps[:, len(references) :] = STEPS // 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), column, pa.array(steps.tolist(), pa.list_(pa.int32()))], ["vec_id", "label", "vector", "angles"]
            )

    made = rows.mapInArrow(run, "vec_id long, label long, vector array<long>, angles array<int>")
    return cut_lineage(made.withColumn("no", F.monotonically_increasing_id()), "vectors")


def _first_rows(df: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """Of every key the first ``k``; of a key each block brings ``k`` at most, and Spark's
    group limit drops the rest before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100,
    positives: int = 5, negatives: int = 10, window: tuple[int, int, int] = (30, 100, 90), changed: int | None = 7,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``every``. Positives: the first other rows of
    the same label; negatives of each: the first rows of another label with lower * positive
    <= unit * score <= upper * positive; higher scores first, then smaller ids. Which rows take
    part: see ``prepare``. Vectors of unlike lengths are filled up with zeros; scores must fit
    into 64 bits. Every row counts, also repeated ones: an anchor's copy is another row, and
    is an anchor too. An empty table, or one without anchors, gives no rows; other columns
    are not read.
    """
    rows = prepare(embeddings, id_col, vector_col, label_col, changed)
    # columns of their own, as a cogroup of a table with itself is ambiguous
    anchors = rows.where(F.col("vec_id") % every == 0).select(*[F.col(c).alias(c) for c in rows.columns])
    slices, groups = max(1, -(-rows.count() // ROWS)), max(1, -(-anchors.count() // ANCHORS))

    def cells(df: DataFrame, own: str, many: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("no", F.lit(own)), F.lit(many)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    right = cells(rows, "slice", slices, "group", groups).groupBy("slice", "group")

    def met(left: DataFrame, run, schema: str) -> DataFrame:
        return cells(left, "group", groups, "slice", slices).groupBy("slice", "group").cogroup(right).applyInArrow(
            lambda key, a, b: run(key, a, b), schema
        )

    # one more, as the anchor may be among them
    near = met(anchors, _positives(positives + 1), "a_no long, other long, score long")
    own = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    me = anchors.select(F.col("no").alias("a_no"), F.col("vec_id").alias("anchor_id"), own.alias("own"))
    near = _first_rows(near, ["a_no"], positives + 1, "place").join(me, "a_no")
    itself = (F.col("other") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    seen = F.max(F.when(itself, F.col("place"))).over(Window.partitionBy("a_no"))
    near = near.withColumn("_me", seen).where(F.col("_me").isNull() | (F.col("place") != F.col("_me"))).withColumn(
        "place", F.col("place") - F.when(F.col("place") > F.col("_me"), 1).otherwise(0)
    ).where(F.col("place") <= positives)
    near = cut_lineage(near.select("a_no", "anchor_id", F.col("place").cast("long").alias("place"), "other", "score"), "positives")
    lists = near.groupBy("a_no").agg(F.collect_list(F.struct("place", "score")).alias("positives"))
    asked = anchors.join(lists.withColumnRenamed("a_no", "no"), "no")
    hard = met(asked, _negatives(negatives, window), "a_no long, place long, other long, score long")
    hard = _first_rows(hard, ["a_no", "place"], negatives, "rank")
    return hard.select("a_no", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")).join(
        near.select("a_no", "place", "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["a_no", "place"]
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
