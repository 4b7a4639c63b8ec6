"""Byte-level BPE over rank files, on padded numpy matrices.

Distinct pieces are bucketed by length into matrices of ids; each round every row merges
its leftmost pair of least rank, found by a hashed pair table, and the matrix closes up.
A row of many columns would move all of them in every round. So longer pieces share one
row whose places wait in queues by rank, and a round merges all places of the least rank
that come before any other pair's turn: the same merges in the same order, in time that grows
with the length (times its logarithm) and not with its square.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

#: Bytes of a piece from which on rows are kept as linked lists; the ids do not depend on it.
LONG = 192
#: Encoded word pieces kept per Python worker; older ones go when it is full.
CACHED = 250_000
CACHED_CHARS = 48
#: Text encoded at a time.
SLICE_BYTES = 2 << 20
NONE = np.int32(2**31 - 1)
_tables: dict[tuple[str, str], "Ranks"] = {}


class Ranks:
    """A rank file with its pair table, kept once per process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        self.pairs = _PairTable(np.array(left, np.uint64), np.array(right, np.uint64), np.array(made, np.int32))
        self.split = regex.compile(pattern)
        self.cut = regex.compile(r" (?=\S)")
        self.odd = regex.compile(r" \s| $")
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "Ranks":
        if (path, pattern) not in _tables:
            _tables[path, pattern] = cls(path, pattern)
        return _tables[path, pattern]

    # --- merging ---------------------------------------------------------------------

    def _long(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of long pieces, laid out as one row with gaps that no pair crosses.

        Places wait in queues by the rank of their pair and the row is a linked list, so a
        round touches only the places it merges. It merges all places of the least rank from
        the left, up to the first after which a pair of lower rank has its turn.
        """
        gap = np.int32(-1)
        ids = np.concatenate([np.append(self.byte[np.frombuffer(p, np.uint8)], gap) for p in [b"", *pieces]])
        size = len(ids)
        after, before = np.append(np.arange(1, size), 0), np.append(size - 1, np.arange(size - 1))
        alive = np.ones(size, bool)

        def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return np.where((left == gap) | (right == gap), NONE, self.pairs.find(left, right))

        rank = ranked(ids, ids[after])
        queues: dict[int, list[np.ndarray]] = {}
        least_first: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            turns = np.flatnonzero(np.diff(rank[at])) + 1
            for own in np.split(at, turns) if len(at) else ():
                r = int(rank[own[0]])
                if r not in queues:
                    queues[r] = []
                    heapq.heappush(least_first, r)
                queues[r].append(own)

        wait(np.arange(size))
        while least_first:
            least = heapq.heappop(least_first)
            at = np.unique(np.concatenate(queues.pop(least)))
            at = at[alive[at] & (rank[at] == least)]
            if not len(at):
                continue
            # of places that touch, every second one counted from the left
            starts = np.concatenate([[True], after[at[:-1]] != at[1:]])
            first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            mine = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[mine]
            right, left = after[gone], before[mine]
            # the row as it is when the place has its turn: those to its left are merged
            joined = np.concatenate([[False], right[:-1] == mine[1:]])
            lower = (ranked(np.where(joined, least, ids[left]), np.full(len(mine), least, np.int32)) < least) | (
                ranked(np.full(len(mine), least, np.int32), ids[right]) < least
            )
            if lower.any():
                upto = int(lower.argmax()) + 1
                late = at[at > mine[upto - 1]]
                mine, gone, right = mine[:upto], gone[:upto], right[:upto]
            else:
                late = at[:0]
            ids[mine], alive[gone] = least, False
            after[mine], before[right] = right, mine
            near = np.unique(np.concatenate([before[mine], mine]))
            rank[near] = ranked(ids[near], ids[after[near]])
            wait(np.unique(np.concatenate([near, late[alive[late] & (rank[late] == least)]])))
        ends = np.flatnonzero(ids == gap)
        return [ids[a + 1 : b][alive[a + 1 : b]].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces that all have ``width`` bytes."""
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), width)
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))

        def settle(which: np.ndarray) -> None:
            size, blob = 4 * ids.shape[1], ids[which].astype("<u4").tobytes()
            for k, i in enumerate(row[which].tolist()):
                out[i] = blob[k * size : (k + 1) * size]

        while ids.shape[1] > 1 and len(row):
            rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
            at = rank.argmin(1)
            least = rank[np.arange(len(row)), at]
            go = least != NONE
            settle(~go)
            ids, at, least, row = ids[go], at[go], least[go], row[go]
            ids[np.arange(len(row)), at] = least
            keep = np.ones(ids.shape, bool)
            keep[np.arange(len(row)), at + 1] = False
            ids = ids[keep].reshape(len(row), ids.shape[1] - 1)
        settle(np.ones(len(row), bool))
        return out

    def merge(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece as bytes (little-endian unsigned 32-bit). All rows of a matrix
        lose one column a round, so equal lengths share a matrix and no padding is left."""
        out: dict[str, bytes] = {}
        long: dict[str, bytes] = {}
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for text in pieces:
            p = text.encode()
            whole = self.rank.get(p)
            if whole is not None:
                out[text] = whole.to_bytes(4, "little")
            elif len(p) > LONG:
                long[text] = p
            else:
                names, rows = by_length.setdefault(len(p), ([], []))
                names.append(text)
                rows.append(p)
        for width, (names, rows) in by_length.items():
            out.update(zip(names, self._matrix(rows, width)))
        if long:
            out.update(zip(long, self._long(list(long.values()))))
        return out

    # --- texts -----------------------------------------------------------------------

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of text chunks; pieces that stood alone as chunks before are known."""
        cut = [self.split.findall(c) for c in chunks]
        known = {}
        new = []
        for p in dict.fromkeys([p for c in cut for p in c]):
            ids = self.cache.get(p[1:]) if p[0] == " " else None
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        known.update(self.merge(new))
        return [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A space before a non-space always starts a piece, so texts
        fall apart there into chunks, and each distinct chunk is encoded once. The cache
        holds the ids of a space and the chunk that is the key."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        out, heads, late, new = [], [], [], set()
        for t in texts:
            first, *rest = self.cut.split(t) if self.odd.search(t) else t.split(" ")
            heads.append(first)
            ids = list(map(self.cache.get, rest))
            if None in ids:
                new.update([c for c, i in zip(rest, ids) if i is None])
                late.append((len(out), rest))
            out.append(ids)
        chunks = list(new)
        self.cache.update(zip(chunks, self._chunks([" " + c for c in chunks])))
        for i, rest in late:
            out[i] = list(map(self.cache.__getitem__, rest))
        for c in chunks:
            if len(c) > CACHED_CHARS:
                del self.cache[c]
        names = list(dict.fromkeys(heads))
        start = dict(zip(names, self._chunks(names)))
        return [start[h] + b"".join(ids) for h, ids in zip(heads, out)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _PairTable:
    """Open addressing over (left, right) ids; looks up whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(4, int(len(made) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = (left << np.uint64(32)) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            placed, first = np.unique(slot[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[placed], self.values[placed] = key[won], made[won]
            todo = np.setdiff1d(todo, won)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE without one."""
        key = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NONE)
        todo = np.flatnonzero((there != key) & (there != np.uint64(2**64 - 1)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            todo, slot = todo[go], slot[go]
        return out.reshape(left.shape)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of about SLICE_BYTES; a longer value stands alone, whole."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > SLICE_BYTES:
            yield start, i - start
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes) - start


def _with_binary(df: DataFrame, column: str, outs: list[str], work) -> DataFrame:
    """``df`` with binary columns ``outs``, made by ``work(values)`` for short lists of values."""
    inside = df.select(F.col(f"`{column}`").alias("_in"), F.struct(*[c for c in df.columns if c != column]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in _slices(batch.column(0)):
                made = [pa.array(m, pa.binary()) for m in work(batch.column(0).slice(a, n).to_pylist())]
                names = ["_row", *[f"_out{i}" for i in range(len(made))]]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, n), *made], names)

    schema = f"_row {inside.schema['_row'].dataType.simpleString()}" + "".join(f", _out{i} binary" for i in range(len(outs)))
    return inside.mapInArrow(run, schema).select("_row.*", *[F.col(f"_out{i}").alias(o) for i, o in enumerate(outs)])


def encode(
    df: DataFrame, text_col: str, path: str, pattern: str, out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``df`` without the text and with its token ids: binary, little-endian unsigned 32-bit.

    Each match of ``pattern`` is encoded alone; special tokens have no meaning. A null text
    counts as empty, an empty one has no ids. All other columns stay as they are; one named
    ``out`` is replaced. With ``decoded``, a column of that name gets what the ids decode to.
    An empty table stays empty; repeated rows repeat. A text may be one unbroken run of any
    length. ``path`` is read on the workers.
    """
    outs = [out] if decoded is None else [out, decoded]

    def work(texts: list) -> list[list[bytes]]:
        table = Ranks.load(path, pattern)
        ids = table.encode([t or "" for t in texts])
        return [ids] if decoded is None else [ids, [table.decode(i) for i in ids]]

    others = [c for c in df.columns if c not in (text_col, "__text", *outs)]
    rows = df.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in others])
    return _with_binary(rows, "__text", outs, work)


def decode(df: DataFrame, ids_col: str, path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids in ``ids_col`` stand for; null ids count as none."""

    def work(ids: list) -> list[list[bytes]]:
        table = Ranks.load(path, pattern)
        return [[table.decode(i or b"") for i in ids]]

    rows = df.drop(out) if out != ids_col else df
    return _with_binary(rows.withColumn("_ids", F.col(ids_col)), "_ids", [out], work)
