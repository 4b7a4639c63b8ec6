"""Similarity join on word shingles by vertical partitioning.

The n-grams are ordered by hash and that order is cut into fragments. A document's set is
cut alike, and a fragment's task sees the pieces of all documents:

1. Each block of documents sends one piece per fragment; an n-gram that several documents
   of the block hold travels once. Each fragment learns which n-grams more than one
   document holds and sends only those back.
2. A document of which fewer than 80 % of the n-grams are shared can't be linked. The rest
   (``nodes``) list their rarest n-grams; linked documents share one of these.
3. Per listed n-gram the most typical document is the hub. Overlaps of hubs with the others
   of their lists are counted per fragment of the order and summed per pair.
4. Only lists that still span several components give further pairs, each once, and only
   where sizes, the overlaps with the hub, the places of their first common n-gram and
   sketches of both sets leave 80 % possible. They are counted alike.

No list is expanded into all its pairs while it is connected, and none is cut short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postgeo.session import cut_lineage

from .components import components
from .words import blocks, mix, shingle_sets

WIDTH = 5
#: Text bytes per fragment of the n-gram order; at least MIN_FRAGMENTS, for long enough hashes.
FRAGMENT_BYTES = 8 << 20
MIN_FRAGMENTS = 64
#: A block closes after so many shingles or documents (ordinals have 16 bits).
BLOCK_SHINGLES = 1_500_000
BLOCK_DOCS = 60_000
#: Fragments in which the overlaps of a pair are counted separately.
COUNTED_FRAGMENTS = 4
SKETCH_BITS = 1024

_SENT = pa.schema([
    ("route", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())),
    *[(c, pa.binary()) for c in "abcde"],
])
SENT = "route int, block long, kind int, ids array<long>, a binary, b binary, c binary, d binary, e binary"
_SHARED = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())),
    *[(c, pa.binary()) for c in "abcde"],
])
SHARED = "block long, kind int, part int, ids array<long>, a binary, b binary, c binary, d binary, e binary"
_PROFILE = pa.schema([
    ("id", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("m", pa.int64()),
    ("rare", pa.list_(pa.int64())), ("parts", pa.list_(pa.binary())), ("sketch", pa.list_(pa.int64())),
])
PROFILE = "id long, sid binary, n long, m long, rare array<long>, parts array<binary>, sketch array<long>"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _code(part, h32: np.ndarray) -> np.ndarray:
    """An n-gram as fragment and low bits of its hash; orders like the fragments."""
    return (np.uint64(part) << np.uint64(32)) | h32.astype(np.uint64)


def _own_route(block: int) -> int:
    """Route of a block's own row, apart from the fragments; two blocks hardly ever share one,
    so no task loads the rows of many blocks at once."""
    return -1 - int(mix(np.array([block], np.uint64))[0] >> np.uint64(33))


def _sketch(codes: np.ndarray) -> list[int]:
    """Parities of a set's n-grams in SKETCH_BITS classes, as whole numbers. Sets that differ
    in d n-grams differ in at most d of these bits."""
    odd = np.bincount((mix(codes) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _block_rows(block: int, ids: list, sets: list[np.ndarray], seen: set, fragments: int) -> list[tuple]:
    sids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    fresh = np.zeros(len(sets), bool)
    for i, sid in enumerate(sids):
        if len(sets[i]) and sid not in seen:
            seen.add(sid)
            fresh[i] = True
    new = np.flatnonzero(fresh)
    h = np.concatenate([sets[i] for i in new]) if len(new) else np.zeros(0, np.uint64)
    owner = np.repeat(new, [len(sets[i]) for i in new]).astype(np.uint16)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    several = np.repeat(times > 1, times)
    part = _fragment(h, fragments)
    once, owner1, part1 = h[~several], owner[~several], part[~several]
    firsts = first[times > 1]
    many, many_part, many_times = h[firsts], part[firsts], times[times > 1]
    out = []
    cuts = np.searchsorted(part1, np.arange(fragments + 1, dtype=np.uint64))
    cuts_many = np.searchsorted(many_part, np.arange(fragments + 1, dtype=np.uint64))
    for f in range(fragments):
        a, b, c, d = cuts[f], cuts[f + 1], cuts_many[f], cuts_many[f + 1]
        if a == b and c == d:
            continue
        by = np.argsort(owner1[a:b], kind="stable")
        docs, lens = np.unique(owner1[a:b], return_counts=True)
        out.append((
            f, block, 0, None, docs.astype(np.uint16).tobytes(), lens.astype(np.uint32).tobytes(),
            once[a:b][by].astype(np.uint32).tobytes(), many[c:d].astype(np.uint32).tobytes(),
            many_times[c:d].astype(np.uint32).tobytes(),
        ))
    held = np.flatnonzero(several)
    codes = (part[held] << np.uint64(32)) | (h[held] & np.uint64(0xFFFFFFFF))
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    out.append((
        _own_route(block), block, 1, ids, n.tobytes(), b"".join(sids), fresh.tobytes(),
        codes.tobytes(), owner[held].tobytes(),
    ))
    return out


def _sender(width: int, fragments: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        block = TaskContext.get().partitionId() << 24
        ids, sets, size = [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in blocks(texts):
                more = shingle_sets(texts[a:b], width)
                ids += keys[a:b]
                sets += more
                size += sum(map(len, more))
                while size >= BLOCK_SHINGLES or len(ids) >= BLOCK_DOCS:
                    yield _table(_block_rows(block, ids[:BLOCK_DOCS], sets[:BLOCK_DOCS], seen, fragments), _SENT)
                    block += 1
                    ids, sets = ids[BLOCK_DOCS:], sets[BLOCK_DOCS:]
                    size = sum(map(len, sets))
        if ids:
            yield _table(_block_rows(block, ids, sets, seen, fragments), _SENT)

    return send


def _count_fragment(t: pa.Table) -> pa.Table:
    """Pieces of one fragment: keep the n-grams that several documents hold, with their number."""
    rows = t.to_pylist()
    out = [(r["block"], 1, None, r["ids"], *(r[c] for c in "abcde")) for r in rows if r["kind"] == 1]
    rows = [r for r in rows if r["kind"] == 0]
    if rows:
        once = [np.frombuffer(r["c"], np.uint32) for r in rows]
        many = [np.frombuffer(r["d"], np.uint32) for r in rows]
        times = [np.frombuffer(r["e"], np.uint32) for r in rows]
        n1 = sum(map(len, once))
        _, where = np.unique(np.concatenate(once + many), return_inverse=True)
        holders = np.bincount(where, weights=np.concatenate([np.ones(n1), *times])).astype(np.uint32)[where]
        a, b = 0, n1
        for r, h, g in zip(rows, once, many):
            d1, d2 = holders[a : a + len(h)], holders[b : b + len(g)]
            a, b = a + len(h), b + len(g)
            keep = d1 > 1
            who = np.repeat(np.frombuffer(r["a"], np.uint16), np.frombuffer(r["b"], np.uint32))[keep]
            docs, lens = np.unique(who, return_counts=True)
            if len(docs) or len(g):
                out.append((
                    r["block"], 0, r["route"], None, docs.tobytes(), lens.astype(np.uint32).tobytes(),
                    h[keep].tobytes(), d1[keep].tobytes(), g.tobytes() + d2.tobytes(),
                ))
    return pa.Table.from_batches([_table(out, _SHARED)])


def _assembler(fragments: int):
    def assemble(t: pa.Table) -> pa.Table:
        """All pieces of one block: a row per document, with its set where it may have links."""
        rows = t.to_pylist()
        base = next(r for r in rows if r["kind"] == 1)
        rows = [r for r in rows if r["kind"] == 0]
        ids, n, fresh = base["ids"], np.frombuffer(base["a"], np.int64), np.frombuffer(base["c"], bool)
        sids = [base["b"][16 * i : 16 * i + 16] for i in range(len(ids))]
        who, codes, held = [], [], []
        many, many_held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for r in rows:
            who.append(np.repeat(np.frombuffer(r["a"], np.uint16), np.frombuffer(r["b"], np.uint32)))
            codes.append(_code(r["part"], np.frombuffer(r["c"], np.uint32)))
            held.append(np.frombuffer(r["d"], np.uint32))
            g = np.frombuffer(r["e"], np.uint32)
            many.append(_code(r["part"], g[: len(g) // 2]))
            many_held.append(g[len(g) // 2 :])
        table, table_held = np.concatenate(many), np.concatenate(many_held)
        by = np.argsort(table)
        table, table_held = table[by], table_held[by]
        pair_codes = np.frombuffer(base["d"], np.uint64)
        who.append(np.frombuffer(base["e"], np.uint16))
        codes.append(pair_codes)
        held.append(table_held[np.searchsorted(table, pair_codes)])
        who, codes, held = np.concatenate(who).astype(np.int64), np.concatenate(codes), np.concatenate(held)
        m = np.bincount(who, minlength=len(ids))
        node = fresh & (5 * m >= 4 * n) & (n > 0)
        mine = node[who]
        who, codes, held = who[mine], codes[mine], held[mine]
        by = np.lexsort((codes, held, who))
        who, codes = who[by], codes[by]
        start = np.searchsorted(who, np.arange(len(ids) + 1))
        borders = -(-np.arange(1, COUNTED_FRAGMENTS) * fragments // COUNTED_FRAGMENTS)
        borders = borders.astype(np.uint64) << np.uint64(32)
        out = []
        for i, key in enumerate(ids):
            sid = sids[i] if n[i] else None
            if node[i]:
                mine = codes[start[i] : start[i + 1]]
                rare = mine[: int(n[i] // 5 + 1 - (n[i] - m[i]))].astype(np.int64)
                ordered = np.sort(mine)
                parts = [p.tobytes() for p in np.split(ordered, np.searchsorted(ordered, borders))]
                out.append((key, sid, int(n[i]), int(m[i]), rare, parts, _sketch(mine)))
            else:
                out.append((key, sid, int(n[i]), None, None, None, None))
        return pa.Table.from_batches([_table(out, _PROFILE)])

    return assemble


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
        x = []
        for p, q in zip(left, right):
            both = np.sort(np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)]))
            x.append(int(np.count_nonzero(both[1:] == both[:-1])))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(x, pa.int64())], ["a", "b", "x"])


def overlaps(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, x): partial overlaps of the pairs, counted per fragment and summed."""
    pieces = nodes.select("sid", F.posexplode("parts").alias("part", "piece"))
    cut = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(COUNTED_FRAGMENTS - 1))).alias("part"))
    both = cut.join(pieces.select(F.col("sid").alias("a"), "part", F.col("piece").alias("pa")), ["a", "part"]).join(
        pieces.select(F.col("sid").alias("b"), "part", F.col("piece").alias("pb")), ["b", "part"]
    )
    counted = both.select("a", "b", "pa", "pb").mapInArrow(_overlap, "a binary, b binary, x long")
    return counted.groupBy("a", "b").agg(F.sum("x").alias("x"))


def _linked(x, na, nb):
    """100 * intersection >= 80 * union, with union = na + nb - intersection."""
    return 9 * x >= 4 * (na + nb)


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, sid, n, m, rare, parts, sketch) per row of ``docs``; see the module text. Written."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    fragments = max(MIN_FRAGMENTS, -(-size // FRAGMENT_BYTES))
    sent = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _sender(width, fragments), SENT
    )
    shared = sent.groupBy("route").applyInArrow(_count_fragment, SHARED)
    return cut_lineage(shared.groupBy("block").applyInArrow(_assembler(fragments), PROFILE), "profiles")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between sets that join all that similarity joins; nodes: written profiles."""
    listed = nodes.select("sid", "n", "m", F.posexplode("rare").alias("pos", "gram"))
    typical = F.struct((F.col("m") / F.col("n")).alias("share"), "n", "sid", "m")
    hubs = cut_lineage(
        listed.groupBy("gram").agg(F.max(typical).alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1"), "hubs"
    )
    around = listed.join(hubs, "gram").select(
        "gram", "pos", "sid", "n", "m", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("hub_n")
    )
    met = around.where("sid <> hub").groupBy(F.col("hub").alias("a"), F.col("sid").alias("b")).agg(
        F.first("hub_n").alias("na"), F.first("n").alias("nb")
    )
    met = cut_lineage(met, "met")
    first = cut_lineage(overlaps(met, nodes).join(met, ["a", "b"]), "overlaps")
    near = first.where(_linked(F.col("x"), F.col("na"), F.col("nb"))).select("a", "b")
    roots = components(near)
    placed = (
        around.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        .join(first.select(F.col("a").alias("hub"), F.col("b").alias("sid"), "x"), ["hub", "sid"], "left")
        .select("gram", "pos", "sid", "n", "m", "hub", F.coalesce("x", "m").alias("x"), F.coalesce("root", "sid").alias("root"))
    )
    placed = cut_lineage(placed, "placed")
    open_lists = placed.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    rest = cut_lineage(
        placed.where("sid <> hub").join(open_lists.select("gram"), "gram").join(nodes.select("sid", "rare", "sketch"), "sid")
        .withColumn("before", F.expr("slice(rare, 1, pos)")).drop("rare", "hub"),
        "rest",
    )
    p, q = rest.alias("p"), rest.alias("q")
    common = F.least("p.m", "q.m")
    bound = F.least("p.x", "q.x") + F.least(F.col("p.m") - F.col("p.x"), F.col("q.m") - F.col("q.x"))
    # they have no n-gram in common that is rarer than this one
    later = F.least(F.col("p.m") - F.col("p.pos"), F.col("q.m") - F.col("q.pos"))
    apart = sum((F.bit_count(F.get("p.sketch", F.lit(i)).bitwiseXOR(F.get("q.sketch", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    more = cut_lineage(
        p.join(
            q,
            (F.col("p.gram") == F.col("q.gram")) & (F.col("p.sid") < F.col("q.sid")) & (F.col("p.root") != F.col("q.root"))
            & _linked(common, F.col("p.n"), F.col("q.n")) & _linked(bound, F.col("p.n"), F.col("q.n"))
            & _linked(later, F.col("p.n"), F.col("q.n")) & (9 * (F.col("p.m") + F.col("q.m") - apart) >= 8 * (F.col("p.n") + F.col("q.n")))
            & ~F.arrays_overlap("p.before", "q.before"),
        ).select(F.col("p.sid").alias("a"), F.col("q.sid").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")),
        "more",
    )
    second = overlaps(more, nodes).join(more, ["a", "b"]).where(_linked(F.col("x"), F.col("na"), F.col("nb")))
    return near.union(second.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, n_shingles, component_id): similar texts by Jaccard similarity of 0.8 or more.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A text with
    fewer words than ``width`` is one shingle; a null, empty or wordless text has none,
    n_shingles 0, and is linked with nothing. component_id is the smallest id that links
    reach; rows without id count as members but give no id (all without: null). Repeated
    rows stay, each with its result. An empty table gives no rows. Other columns of
    ``docs`` are not read. Ids are cast to long; the chance that two n-grams count as one
    is about 2**-38 per pair of n-grams, or less on larger tables.
    """
    prof = profiles(docs, id_col, text_col, width)
    nodes = cut_lineage(
        prof.where("m is not null").groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "m", "rare", "parts", "sketch")]), "nodes"
    )
    roots = components(links(nodes))
    lean = prof.select("id", "sid", "n")
    placed = cut_lineage(
        lean.where("n > 0").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        .select("id", "n", F.coalesce("root", "sid").alias("root")),
        "placed",
    )
    lowest = cut_lineage(placed.groupBy("root").agg(F.min("id").alias("low")), "lowest")
    linked = placed.join(lowest, "root").select("id", "n", "low")
    alone = lean.where("n = 0").select("id", "n", F.col("id").alias("low"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id")
    )
