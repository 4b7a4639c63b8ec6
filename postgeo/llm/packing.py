"""Packing of token pieces into sequences of fixed length.

Documents are tokenised, closed with an end id and cut every ``length`` ids. Full pieces
are sequences of their own; tails are packed by first-fit decreasing in random groups of
about GROUP pieces, so a group's memory is bounded and no task sees the whole corpus.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postgeo.session import cut_lineage

from .bpe import Ranks

GROUP = 4096
_PIECES = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_encoders: dict[tuple, tuple] = {}


def _encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The library's encoder; texts with very long runs of white space go to our own,
    as they exceed the library's limits for its pattern. Strings of ``special`` tokens are
    their ids, whatever stands around them."""
    key = path, pattern, special
    if key not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        _encoders[key] = fast, regex.compile(r"\s{2000}"), dict(special)
    fast, gap, ids_of = _encoders[key]
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(ids_of, key=len, reverse=True))) + ")") if ids_of else None

    def ids(text: str) -> np.ndarray:
        if not gap.search(text):
            return np.array(fast.encode(text, allowed_special="all", disallowed_special=()), "<u4")
        parts = cut.split(text) if cut else [text]
        own = Ranks.load(path, pattern)
        out = [np.array([ids_of[p]], "<u4") if p in ids_of else np.frombuffer(own.encode([p])[0], "<u4") for p in parts if p]
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    return ids


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a ``tokenizers`` file adds to its vocabulary, for ``special``. Only tokens
    that match as they stand, anywhere, are taken; others are refused."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens with conditions are not supported")
    return {t["content"]: t["id"] for t in added}


def pieces(
    docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, end_id: int, length: int,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """(uid, doc_id, start, length, ids_crc32, doc_tokens): pieces of at most ``length`` ids.

    ``path`` is a rank file of byte-level BPE. Every row, also with a null or empty text,
    has at least the end id. Strings of ``special`` tokens become their ids. ``uid`` tells pieces apart, also of repeated rows.
    """

    marks = tuple(sorted((special or {}).items()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = _encoder(path, pattern, marks), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.array(end_id, "<u4")).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    out.append((uid, key, start, len(piece), zlib.crc32(piece), len(ids)))
                    uid += 1
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            names = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(cols, names) if out else pa.RecordBatch.from_arrays(
                [pa.array([], pa.int64())] * 6, names
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, _PIECES)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size; equal sizes keep their order.

    The tree holds the largest free room below each node, so the first bin with room is
    found by going left wherever it fits.
    """
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(cut: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """``cut`` (with uid and length) plus sequence_id and offset.

    Groups are drawn by a hash of ``uid``; their number follows the number of tails.
    A piece longer than ``length`` is an error of the caller. An empty table stays empty.
    """
    full = cut.where(F.col("length") == length).select(
        "*", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    tails = cut.where(F.col("length") < length)
    groups = max(1, -(-tails.count() // group))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        pdf["sequence_id"] = ((pdf["_group"].to_numpy() << 32) | bins) * 2 + 1
        pdf["offset"] = offsets
        return pdf.drop(columns="_group")

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cut.schema)}, sequence_id long, offset long"
    grouped = tails.withColumn("_group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return full.union(grouped.groupBy("_group").applyInPandas(fit, schema))


def pack_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, length: int = 2048, special: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of all documents with their places in sequences: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    ``special``: strings that are tokens of their own (see ``added_tokens``); without it all text
    is plain. Null and empty texts give one piece, the end id. Repeated rows are packed each. Other
    columns of ``docs`` are not read; ids are cast to long, null ids stay null. An empty
    table gives no rows.
    """
    cut = cut_lineage(pieces(docs, id_col, text_col, path, pattern, end_id, length, special), "pieces")
    return pack(cut, length).drop("uid")
