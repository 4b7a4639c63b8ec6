"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and an elastic-net penalty, so most weights stay
exactly zero, and calibrated by one temperature on part of the training rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
#: At most about so many training rows per language are fitted.
ROWS_PER_LANGUAGE = 600
CHUNK = 1 << 20
UNKNOWN = "und"


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; runs of anything but letters become one space."""
    u = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    plain = (u >= 97) & (u <= 122)
    rest = np.flatnonzero(~plain & (u >= 128))
    letter = plain.copy()
    if len(rest):
        kinds, where = np.unique(u[rest], return_inverse=True)
        letter[rest] = np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))[where]
    u = np.where(letter, u, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return u[keep]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text and their counts; none without a letter."""
    total = None
    for start in range(0, len(text), CHUNK):
        u = _codes(text[max(0, start - 2) : start + CHUNK]).astype(np.uint64)
        if not (u != 32).any():
            continue
        u = np.concatenate([[np.uint64(32)], u, [np.uint64(32)]])
        h, counts = np.zeros(len(u), np.uint64), np.zeros(DIMENSIONS, np.int64)
        for k in range(max(ORDERS)):
            n = len(u) - k
            h = (h[:n] + u[k:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            counts += np.bincount((h % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
        total = counts if total is None else total + counts
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.flatnonzero(total)
    return at, total[at].astype(float)


@dataclasses.dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.linalg.norm(x), 1e-12)

    def scores(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.vector(at, counts) @ self.weights[at] + self.weights[-1]
        z = (z - z.max()) / self.temperature
        return np.exp(z) / np.exp(z).sum()


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 5,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5,
) -> Model:
    """FTRL-proximal over the rows in a fixed random order; every fifth row is kept for the temperature."""
    names = sorted(set(langs))
    want = np.array([names.index(x) for x in langs])
    seen = np.bincount(np.concatenate([a for a, _ in rows]), minlength=DIMENSIONS) if rows else np.zeros(DIMENSIONS)
    model = Model(names, np.log((1 + len(rows)) / (1 + seen)) + 1, np.zeros((DIMENSIONS + 1, len(names))), 1.0)
    if len(names) < 2:
        return model
    xs = [(np.append(a, DIMENSIONS), np.append(model.vector(a, c), 1.0)) for a, c in rows]
    order = np.random.default_rng(7).permutation(len(rows))
    held = order[::5]
    learn = np.setdiff1d(np.arange(len(rows)), held)
    z, n = np.zeros((DIMENSIONS + 1, len(names))), np.zeros((DIMENSIONS + 1, len(names)))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0
        return w

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, x = xs[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[want[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    model.weights = weights(slice(None))
    logits = np.array([xs[i][1] @ model.weights[xs[i][0]] for i in held])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), want[held]]).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    model.temperature = float(grid[np.argmin([loss(t) for t in grid])])
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, text_col: str, lang_col: str, learn: Column, per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on the rows where ``learn`` holds and text and language are there.

    Of each language about ``per_language`` rows are drawn by a hash of the text; equal
    texts are drawn together and used once. Counts cover all rows; texts are whole.
    """
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    there = {r[0]: r[1] for r in usable.groupBy(F.col(lang_col)).agg(F.count(F.lit(1))).collect()}
    if not there:
        return fit([], [])
    share = F.create_map(*[x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = usable.where(
        F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < F.element_at(share, F.col(lang_col)) * (1 << 20)
    ).select(F.col(lang_col), F.col(text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()),
                 pa.array([c.astype(np.float32).tobytes() for _, c in made], pa.binary())],
                ["lang", "at", "counts"],
            )

    rows = drawn.mapInArrow(count, "lang string, at binary, counts binary").distinct().collect()
    rows = sorted((r for r in rows if len(r["at"])), key=lambda r: (r["lang"], bytes(r["at"])))
    return fit(
        [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["counts"], np.float32).astype(float)) for r in rows],
        [r["lang"] for r in rows],
    )


def predict(docs: DataFrame, text_col: str, model: Model, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the likeliest language and its calibrated chance.

    Null texts and texts without a letter are UNKNOWN with score 0, as is everything if the
    model has no language. Columns named like the new ones are replaced; nothing but the
    text is looked at. Repeated rows repeat; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in (lang_out, score_out)]
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))
    place = keep.index(text_col)
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(0).field(place):
                at, counts = features(t.as_py() or "")
                if len(at) and names:
                    p = model.scores(at, counts)
                    langs.append(names[int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_row", "_lang", "_score"]
            )

    schema = f"_row {boxed.schema['_row'].dataType.simpleString()}, _lang string, _score double"
    return boxed.mapInArrow(run, schema).select("_row.*", F.col("_lang").alias(lang_out), F.col("_score").alias(score_out))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = ROWS_PER_LANGUAGE,
) -> DataFrame:
    """(id_col, held_out, lang_pred, score): learnt from rows that are not held out, told for all."""
    model = train(docs, text_col, lang_col, ~held_out(id_col), per_language)
    rows = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return predict(rows, "__text", model).drop("__text")
