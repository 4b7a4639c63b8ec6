"""Quality classifier: evidence of the text, combined with what its site is like.

A logistic regression on surface features gives each document a chance to be good. Chances
are then pooled by host and by path within the host: a host's mean is shrunk toward the
global mean and a path's toward its host's, the more the fewer documents there are. How
strongly is estimated from the spread between sites (empirical Bayes, by moments).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from postgeo.session import cut_lineage

#: At most about so many labelled rows are fitted.
LABELLED_ROWS = 20_000
#: Sites up to this number are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_SITES = 50_000
#: Bounds of the prior strength, in documents.
STRENGTH = (5.0, 1000.0)
KEEP = 0.5
FEATURES = 8


def features(text: Column) -> Column:
    """FEATURES numbers between 0 and about 1 per text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(t, r"[\p{Ll}\p{Nd}]+", "")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    inline = F.struct(F.length(t).alias("c"), rest.alias("rest"), words.alias("w"), F.lit(0).alias("one"))

    def measured(x: Column) -> Column:
        c = F.greatest(x["c"], F.lit(1)).cast("double")
        n = F.size(x["w"])
        some = F.greatest(n, F.lit(1)).cast("double")
        upper = F.length(F.regexp_replace(x["rest"], r"\P{Lu}+", "")) / c
        symbol = F.length(F.regexp_replace(x["rest"], r"[^#*$%&|<>!~^=+_\\@]+", "")) / c
        alike = F.size(F.array_distinct(x["w"])) / some
        return F.array(
            F.least(F.ln(1 + some) / 10, F.lit(1.0)), upper, F.least(upper * 5, F.lit(1.0)), F.least(symbol * 10, F.lit(1.0)),
            alike, F.least(F.lit(1.0), alike * 3), F.least(x["c"] / (12 * some), F.lit(1.0)), F.when(n > 0, 1.0).otherwise(0.0),
        )

    return F.get(F.transform(F.array(inline), measured), F.lit(0))


def fit(rows: np.ndarray, good: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and bias of the logistic regression (Newton's method); zeros unless both kinds are there."""
    x = np.column_stack([rows, np.ones(len(rows))]) if len(rows) else np.zeros((0, FEATURES + 1))
    w = np.zeros(FEATURES + 1)
    if len(set(good.tolist())) < 2:
        return w
    ridge = l2 * len(x) * np.diag([1.0] * FEATURES + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (good - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(found: Column, weights: np.ndarray) -> Column:
    z = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        z = z + F.lit(float(w)) * F.get(found, F.lit(i))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _bounded(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def _strength(groups: DataFrame, mean: Column, up: Column) -> float:
    """Documents that the level above is worth, from the spread of group means around it."""
    around = F.sum(F.col("n") * (mean - up) ** 2)
    r = groups.agg(
        around.alias("between"), F.sum(F.col("q") - F.col("n") * mean * mean).alias("within"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    ).first()
    if not r["n"] or r["k"] < 2 or r["n"] <= r["k"]:
        return STRENGTH[1]
    within = max(r["within"], 0.0) / (r["n"] - r["k"])
    spread = (r["between"] - (r["k"] - 1) * within) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(min(max(within / spread if spread > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1]))


def sites(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) from rows (host, path, p), and the global mean."""
    paths = cut_lineage(
        scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")),
        "paths",
    )
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    total = min(max(0.5 if total is None else total, 1e-6), 1 - 1e-6)
    hosts = cut_lineage(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"]), "hosts")
    k = _strength(hosts, F.col("s") / F.col("n"), F.lit(total))
    hosts = hosts.select("host", ((F.col("s") + k * total) / (F.col("n") + k)).alias("host_posterior"))
    placed = cut_lineage(paths.join(hosts, "host"), "placed")
    k = _strength(placed, F.col("s") / F.col("n"), F.col("host_posterior"))
    post = (F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)
    return cut_lineage(placed.select("host", "path", "host_posterior", post.alias("path_posterior")), "sites"), total


def judge(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, prefix: str = "",
) -> DataFrame:
    """``docs`` with evidence, host_posterior, path_posterior, score and kept.

    ``host`` and ``path`` (the latter within the host) are expressions over ``docs``; nulls
    are sites like others. ``score`` is the chance that the text is good given both: the
    odds of its evidence times those of its path over the global ones. Labels (id_col,
    label_col: 1 good, 0 bad) of null or unknown ids and null labels are left out; unless
    good and bad ones are there, nothing is rejected. Null and empty texts are judged by
    their (empty) features. New columns start with ``prefix``; ones of ``docs`` with the
    same names are replaced; repeated rows repeat; an empty table stays empty.
    """
    new = {c: prefix + c for c in ("evidence", "host_posterior", "path_posterior", "score", "kept")}
    text = F.col(f"`{text_col}`")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lean = cut_lineage(
        docs.select(F.col(id_col).alias("_id"), name(host).alias("host"), name(path).alias("path"), features(text).alias("x")), "features"
    )
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_good"))
    share = min(1.0, labelled_rows / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # one row per labelled id, however often it stands among the documents
    one = F.min(F.struct("x", "_good")).alias("one")
    rows = drawn.join(lean.select("_id", "x"), "_id").groupBy("_id").agg(one).select("one.*").collect()
    weights = fit(np.array([r["x"] for r in rows]), np.array([r["_good"] for r in rows]))
    known, total = sites(lean.select("host", "path", chance(F.col("x"), weights).alias("p")))
    known = known.withColumnsRenamed({"host": "__host", "path": "__path", **new})
    if known.count() <= BROADCAST_SITES:
        known = F.broadcast(known)
    kept_cols = [F.col(f"`{c}`") for c in docs.columns if c not in new.values()]
    scored = docs.select(*kept_cols, name(host).alias("__host"), name(path).alias("__path"), chance(features(text), weights).alias(new["evidence"]))
    odds = _logit(_bounded(F.col(new["evidence"]))) + _logit(_bounded(F.col(new["path_posterior"]))) - _logit(F.lit(total))
    return (
        scored.join(known, ["__host", "__path"], "left").drop("__host", "__path")
        .withColumn(new["score"], 1 / (1 + F.exp(-odds)))
        .withColumn(new["kept"], F.col(new["score"]) >= KEEP if weights.any() else F.lit(True))
    )
