"""Spelling variants, document digests and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postgeo.llm import digest, negatives, spelling

# --- spelling variants ----------------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows):
    n = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(n):
    out, form = [], {}
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w, vs in around.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(vs), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def found_variants(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def edits(rng, word):
    for _ in range(rng.choice([1, 1, 2])):
        i, c = rng.randrange(len(word)), rng.choice("abcnéÿÀ")
        word = rng.choice([word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + c + word[i:]])
    return word


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcn") for _ in range(rng.choice([7, 7, 8, 9, 12]))) for _ in range(40)]
    words += ["aaaaaaa", "aaaaaaaa", "banananana", "Ünglücklich", "x" * 3000, "x" * 1500 + "y" + "x" * 1499]
    weights = [rng.choice([1, 2, 30, 300]) for _ in words]
    rows = []
    for i in range(400):
        picked = rng.choices(words, weights, k=rng.choice([0, 3, 40]))
        rows.append((i, " ".join(edits(rng, w) if rng.random() < 0.15 else (w.upper() if rng.random() < 0.05 else w) for w in picked)))
    rows += [(None, "aaaaaaa banananana"), (7, None), (8, ""), (9, "1234 ... \n"), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def test_variants_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, word string, n int").repartition(5)
    got = found_variants(spelling.variants(spelling.count_words(docs)))
    want = brute_variants(brute_words(texts))
    assert got == want
    assert sum(r[3] is not None for r in want) > 20 and max(len(r[0]) for r in want) > 1000


def test_chains_of_forms_and_ties(spark):
    n = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000, "aaabbbbb": 200000,
         "ccccccc": 1, "ccccccd": 10, "cccccca": 10, "lonely word": 5, "": 3, "a": 3}
    counts = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    got = found_variants(spelling.variants(counts))
    assert got == brute_variants(n)
    by = {r[0]: r for r in got}
    assert by["aaaaaaaa"][5] == "aaabbbbb" and by["ccccccc"][3] == "cccccca"


def test_variants_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(none)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(none, 1)


# --- digests -----------------------------------------------------------------------------------


def plain_digest(text: bytes) -> str:
    """The digest written out triplet by triplet."""
    t, padded, counts = digest._tables, text + b"\0\0\0", [0] * 128
    for i in range(len(text)):
        a, b, c, d = padded[i : i + 4]
        for h in (t[0][a] ^ t[1][b] ^ t[2][c], t[0][a] ^ t[1][b] ^ t[3][d], t[4][a] ^ t[5][c] ^ t[6][d]):
            counts[h] += 1
    q1, q2, q3 = (sorted(counts)[32 * k - 1] for k in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    top = max(1, q3)
    head = [round(math.log1p(len(text)) / math.log(1.1)), min(15, q1 * 16 // top) * 16 + min(15, q2 * 16 // top)]
    return bytes(head + [sum(codes[4 * k + j] << 2 * j for j in range(4)) for k in range(32)]).hex()


def plain_likeness(a: str, b: str) -> float:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    far = abs(x[0] - y[0]) + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
    for p, q in zip(x[2:], y[2:]):
        for j in (0, 2, 4, 6):
            step = abs((p >> j & 3) - (q >> j & 3))
            far += 6 if step == 3 else step
    return 1 - min(far, 256) / 256


def sample_texts(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    return ["".join(rng.choice(words) + " " for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(60)]


def test_digests_equal_plain_ones_also_over_slices(monkeypatch):
    texts = [t.encode() for t in ["", "a", "ab", "é" * 9, *sample_texts()[:12]]]
    want = [plain_digest(t) for t in texts]
    assert digest._hex(digest.digests(texts)) == want
    monkeypatch.setattr(digest, "SLICE", 97)
    assert digest._hex(digest.digests(texts)) == want


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, mark, following = (plain_digest(x.encode()) for x in (text, changed, after))
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, mark, plain_likeness(own, mark), plain_likeness(own, following)))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_edits_equal_brute_force(spark, parts):
    texts = sample_texts(2)
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, texts[0]), (1003, texts[0]), (None, "none's words"), (1004, "日本語のテキスト" * 30)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fingerprint string, part int").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = digest.edit_likeness(docs)
        assert got.columns == COLUMNS
        assert Counter(map(tuple, got.collect())) == Counter(brute_edits(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edits_of_repeated_rows_one_row_and_none(spark):
    rows = [(1, "some words here"), (1, "some words here"), (1, "other words"), (2, "two"), (2, "two")]
    got = digest.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == {1: 3, 2: 2}
    one = digest.edit_likeness(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == brute_edits(rows[:1])
    assert digest.edit_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edited_texts_are_nearer_than_others():
    texts = [t for t in sample_texts(3) if len(t) > 300]
    own = digest.digests([t.encode() for t in texts])
    after = np.roll(own, -1, axis=0)
    changed = digest.digests([digest.edited(t, f).encode() for t, f in zip(texts, texts[1:] + texts[:1])])
    small = digest.digests([(t[:100] + "xyz " + t[104:]).encode() for t in texts])
    assert (digest.likeness(own, own) == 1).all()
    assert np.median(digest.likeness(own, small)) > np.median(digest.likeness(own, changed)) > np.median(digest.likeness(own, after))
    assert (digest.likeness(own, small) > digest.likeness(own, after)).all()


def test_fingerprint_and_compare_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "old"), (2, None, "old"), (3, "", "old"), (1, "a text", None)], "doc_id long, text string, fingerprint string")
    marked = digest.fingerprint(docs)
    assert marked.columns == ["doc_id", "text", "fingerprint"]
    rows = marked.collect()
    assert {r.text: r.fingerprint for r in rows} == {t: plain_digest((t or "").encode()) for t in ("a text", None, "")}
    pairs = marked.selectExpr("fingerprint as a", "case when doc_id < 3 then fingerprint end as b", "1 as likeness")
    assert sorted((r.b is None, r.likeness) for r in digest.compare(pairs, "a", "b").collect() if r.b) == [(False, 1.0)] * 3
    assert [r.likeness for r in digest.compare(pairs, "a", "b").collect() if r.b is None] == [None]


# --- hard negatives ----------------------------------------------------------------------------


def brute_negatives(rows, every=100):
    """``rows``: (vec_id, vector, label); repeated rows count each."""
    held = []
    for key, vec, label in rows:
        if key is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        held.append((key, (label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * x) for x in vec]))
    out = Counter()
    for i, (key, label, vec) in enumerate(held):
        if key % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), k, lab) for j, (k, lab, v) in enumerate(held) if j != i)
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            for rank, (s, nid, _) in enumerate(fits, 1):
                out[key, pid, rank, nid, -p, -s] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int, no long, score string"


def vectors(seed, n, wide=8, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, wide))
    rows = []
    for i in range(n):
        v = centres[rng.integers(5)] + rng.normal(size=wide) * spread
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(4)), None, "x"))
    return rows


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = vectors(1, 700)
    rows += [(700 + i, rows[100][1], i % 3, None, "x") for i in range(60)]  # a group of copies, an anchor among them
    rows += [rows[100], rows[100], rows[203], (100, rows[5][1], 2, None, "x"), (900, [0.0] * 8, 1, None, "x")]
    rows += [
        (None, [1.0] * 8, 1, None, "x"), (901, None, 1, None, "x"), (902, [1.0] * 8, None, None, "x"), (903, [float("nan")] + [1.0] * 7, 1, None, "x"),
        (904, [None] + [1.0] * 7, 1, None, "x"), (905, [float("inf")] + [1.0] * 7, 1, None, "x"), (1000, [float("-inf")] * 8, 1, None, "x"),
        (906, [], 1, None, "x"), (907, [1.0, 2.0], 2, None, "x"), (1100, [0.5, 0.5, 0.5], 2, None, "x"), (1200, [0.25] * 12, 3, None, "x"),
    ]
    want = brute_negatives([r[:3] for r in rows])
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    assert Counter(map(tuple, negatives.mine(df).collect())) == want and len(want) > 100
    for name, small in (("ROWS", 64), ("ANCHORS", 3), ("TOGETHER", 2)):
        monkeypatch.setattr(negatives, name, small)
    assert Counter(map(tuple, negatives.mine(df).collect())) == want


def test_negatives_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.mine(none).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1, None, "x")], VECTORS)).collect() == []
    assert negatives.mine(spark.createDataFrame([(100, [1.0], 1, None, "x")], VECTORS)).collect() == []
    # large values: beyond what doubles multiply exactly, and beyond what scores can hold
    big = [(100, [3.1e5, 1e5], 1), (101, [3e5, 1.1e5], 1), (102, [1.5e5, 1e5], 2), (103, [1e5, 1.3e5], 3), (104, [1e30, 0.0], 1)]
    got = negatives.mine(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"))
    assert Counter(map(tuple, got.collect())) == brute_negatives(big[:4])


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-300, 300, (200, 16)), rng.integers(-2, 3, (50, 16)), rng.normal(size=(1, 16)) * 10 + rng.normal(size=(300, 16))]).astype(np.int64)
    v[240] = 0
    refs = negatives.pick_references(v.astype(float), 8)
    size, steps = negatives._lengths(v), negatives.angle_steps(v.astype(float), refs)
    low, high = negatives.score_bounds(steps, size, steps, size)
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    # rows of two bunches: one bunch is left out when scores of the other are asked for
    bunch = np.rint(rng.normal(size=(2, 1, 16)) * 200 + rng.normal(size=(2, 50, 16)) * 10).astype(np.int64)
    a, b = bunch
    refs = negatives.pick_references(np.concatenate(bunch).astype(float), 8)
    _, high = negatives.score_bounds(negatives.angle_steps(a, refs), negatives._lengths(a), negatives.angle_steps(b, refs), negatives._lengths(b))
    assert (high < (a @ a.T).min()).mean() > 0.9
