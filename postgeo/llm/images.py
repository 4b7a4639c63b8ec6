"""Cropped and edited copies among image columns, by local descriptors.

Corners are found on several scales; around each, 128 comparisons of smoothed pixels, turned
to the patch's own orientation, give a descriptor. Descriptors are joined by tables of their
two halves; shared entries are votes. A pair of images counts as copies with VOTES of them,
if enough similar descriptors agree on one shift, turn and zoom.

Images are first compared with one hub per table entry. Only entries that then still span
several components can hold further links, across these. Two images with VOTES such entries
in common also share one after each has left out its VOTES - 1 commonest ones, so an entry
that many pictures have (a logo) gives no pairs and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postgeo.session import cut_lineage

from .components import components
from .words import mix

#: A scale halves width and height. A corner is the strongest place within so many pixels of
#: its scale, so their number follows the picture's area and a crop keeps those inside it.
SCALES, APART = 2, 6
RADIUS, ANGLES = 7, 16
#: Similar descriptors: so many bits of 128 may differ. Copies: so many shared table entries
#: (each descriptor has two), then so many agreeing corners.
BITS, VOTES, AGREEING = 14, 6, 4
SHIFT = 3.0
#: Pictures, and pixels of pictures, described at a time; a larger picture stands alone.
BATCH, PIXELS = 256, 1 << 20

_rng = np.random.default_rng(20)
_OFFSETS = _rng.normal(0, RADIUS / 2.2, (128, 2, 2)).clip(-RADIUS + 1, RADIUS - 1)
_TURNED = np.stack([
    # offsets are (y, x), turned the way the patch is
    np.rint(_OFFSETS @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])).astype(np.int64)
    for a in 2 * np.pi * np.arange(ANGLES) / ANGLES
])
_disc = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
#: x, y (in pixels of the whole image), scale, angle, then two words of the descriptor.
CORNER = np.dtype([("x", "<u2"), ("y", "<u2"), ("scale", "u1"), ("angle", "u1"), ("d0", "<u8"), ("d1", "<u8")])


def parse_pgm(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM (P5, 8 bits); None for anything else."""
    if not data or not data.startswith(b"P5"):
        return None
    head = data[:64].split(None, 4)
    try:
        w, h, top = int(head[1]), int(head[2]), int(head[3])
    except (IndexError, ValueError):
        return None
    at = len(data) - w * h
    return np.frombuffer(data, np.uint8, w * h, at).reshape(h, w) if w > 0 and h > 0 and at > 0 and top == 255 else None


def _box(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over k x k windows, centred; the border repeats."""
    p = np.pad(a, ((0, 0), (k // 2, k // 2), (k // 2, k // 2)), mode="edge")
    rows = sum(p[:, i : i + a.shape[1]] for i in range(k))
    return sum(rows[:, :, i : i + a.shape[2]] for i in range(k))


def _highest(a: np.ndarray, k: int) -> np.ndarray:
    """Largest value within ``k`` rows and columns; the border repeats."""
    for axis in (1, 2):
        p = np.pad(a, [(k, k) if i == axis else (0, 0) for i in range(3)], mode="edge")
        n = a.shape[axis]
        a = np.max([np.take(p, np.arange(i, i + n), axis) for i in range(2 * k + 1)], axis=0)
    return a


def _corners(images: np.ndarray, scale: int) -> list[np.ndarray]:
    """Corners of equally large images (a stack of float grey values)."""
    n, h, w = images.shape
    edge = RADIUS + 1
    if min(h, w) <= 2 * edge:
        return [np.zeros(0, CORNER)] * n
    smooth = _box(images, 3) / 9
    gy, gx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = _box(gx * gx, 5), _box(gy * gy, 5), _box(gx * gy, 5)
    strength = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    found = (strength >= _highest(strength, APART)) & (strength > 1.0)
    who, y, x = np.nonzero(found[:, edge:-edge, edge:-edge])
    y, x = y + edge, x + edge
    patch = smooth[who[:, None], y[:, None] + _disc[:, 0], x[:, None] + _disc[:, 1]]
    patch = patch - patch.mean(1, keepdims=True)
    turn = np.arctan2(patch @ _disc[:, 0], patch @ _disc[:, 1])
    angle = np.rint(turn / (2 * np.pi) * ANGLES).astype(np.int64) % ANGLES
    pairs = _TURNED[angle]
    value = smooth[who[:, None, None], y[:, None, None] + pairs[..., 0], x[:, None, None] + pairs[..., 1]]
    bits = np.packbits(value[..., 0] < value[..., 1], axis=1).view("<u8")
    out = np.zeros(len(who), CORNER)
    out["x"], out["y"], out["scale"], out["angle"] = x * 2.0**scale, y * 2.0**scale, scale, angle
    out["d0"], out["d1"] = bits[:, 0], bits[:, 1]
    return np.split(out, np.searchsorted(who, np.arange(1, n)))


def describe(images: list[np.ndarray | None]) -> list[bytes]:
    """CORNER records of each image; none for one that is missing or too small."""
    out: list[bytes] = [b""] * len(images)
    by_shape: dict[tuple, list[int]] = {}
    for i, im in enumerate(images):
        if im is not None:
            by_shape.setdefault(im.shape, []).append(i)
    for at in by_shape.values():
        many = max(1, min(BATCH, PIXELS // max(1, images[at[0]].size)))
        for a in range(0, len(at), many):
            part = at[a : a + many]
            stack = np.stack([images[i] for i in part]).astype(np.float32)
            found = [[] for _ in part]
            for scale in range(SCALES):
                for f, c in zip(found, _corners(stack, scale)):
                    f.append(c)
                h, w = stack.shape[1] // 2 * 2, stack.shape[2] // 2 * 2
                stack = (stack[:, 0:h:2, 0:w:2] + stack[:, 1:h:2, 0:w:2] + stack[:, 0:h:2, 1:w:2] + stack[:, 1:h:2, 1:w:2]) / 4
            for i, f in zip(part, found):
                out[i] = np.concatenate(f).tobytes()
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Corners of ``a`` whose similar ones in ``b`` agree on one shift, turn and zoom."""
    if not len(a) or not len(b):
        return 0
    differ = np.bitwise_count(a["d0"][:, None] ^ b["d0"]) + np.bitwise_count(a["d1"][:, None] ^ b["d1"])
    i, j = np.nonzero(differ <= BITS)
    if len(i) < AGREEING:
        return 0
    zoom = b["scale"][j].astype(int) - a["scale"][i]
    turn = (b["angle"][j].astype(int) - a["angle"][i]) % ANGLES
    s, t = 2.0**zoom, 2 * np.pi * turn / ANGLES
    ax, ay = a["x"][i] * s, a["y"][i] * s
    dx, dy = b["x"][j] - (np.cos(t) * ax - np.sin(t) * ay), b["y"][j] - (np.sin(t) * ax + np.cos(t) * ay)
    same = (zoom[:, None] == zoom) & (turn[:, None] == turn)
    same &= (np.abs(dx[:, None] - dx) <= SHIFT) & (np.abs(dy[:, None] - dy) <= SHIFT)
    # each corner of either image counts once
    best = same[int(same.sum(1).argmax())]
    return min(len(np.unique(i[best])), len(np.unique(j[best])))


def _describe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            part = batch.slice(a, BATCH)
            made = describe([parse_pgm(x) for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["id", "corners"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, id): one row per distinct half of a descriptor."""
    for batch in batches:
        ids, keys = [], []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(data, CORNER)
            own = np.unique(mix(np.concatenate([c["d0"], ~c["d1"] ^ np.uint64(0x5BD1E995)])))
            keys.append(own.view(np.int64))
            ids += [i] * len(own)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, pa.int64())], ["entry", "id"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [
            agreeing(np.frombuffer(p, CORNER), np.frombuffer(q, CORNER))
            for p, q in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int64())], ["a", "b", "agreeing"])


def _linked(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are copies. Written."""
    joined = pairs.join(described.select(F.col("id").alias("a"), F.col("corners").alias("ca")), "a").join(
        described.select(F.col("id").alias("b"), F.col("corners").alias("cb")), "b"
    )
    judged = joined.mapInArrow(_verify, "a long, b long, agreeing long")
    return cut_lineage(judged.where(F.col("agreeing") >= AGREEING).select("a", "b"), "linked")


def copies(media: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """(id_col, n_corners, copy_group) per row; image_col: binary PGM.

    copy_group is the smallest id that links reach. Null, damaged and too small images have
    no corners and are alone. Rows of one id share a group, and what any of their pictures
    links with; a null id has group null. Images of equal corners are compared as one. An
    empty table gives no rows; other columns are not read.
    """
    found = (
        media.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image"))
        .mapInArrow(_describe_rows, "id long, corners binary").withColumn("digest", F.unhex(F.md5("corners")))
    )
    found = cut_lineage(found, "corners")
    # equal descriptions (also whole groups of plain copies) are compared as one picture
    some = found.where("id is not null and length(corners) > 0")
    same = some.groupBy("digest").agg(F.first("corners").alias("corners"), F.min("id").alias("low"))
    same = cut_lineage(same.withColumn("id", F.monotonically_increasing_id()), "distinct")
    held = some.select(F.col("id").alias("owner"), "digest").join(same.select("digest", F.col("id").alias("picture")), "digest")
    held = cut_lineage(held.select("owner", "picture").distinct(), "held")
    # pictures of one id
    least = held.groupBy("owner").agg(F.min("picture").alias("a"), F.max("picture").alias("b")).where("a <> b")
    links = held.join(least.select("owner", "a"), "owner").where("a <> picture").select("a", F.col("picture").alias("b"))
    entries = same.select("id", "corners").mapInArrow(_entries, "entry long, id long")
    hubs = entries.groupBy("entry").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last")
    around = cut_lineage(entries.join(hubs.select("entry", "hub"), "entry"), "around")
    votes = around.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    links = links.union(_linked(votes.where(F.col("n") >= VOTES).select("a", "b"), same))
    roots = components(links)
    placed = around.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "entry", "id", F.coalesce("root", "id").alias("root")
    )
    placed = cut_lineage(placed, "placed")
    spans = placed.groupBy("entry").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held")
    ).where("low <> high")
    spans = cut_lineage(spans.select("entry", "held"), "spans")
    commonest = Window.partitionBy("id").orderBy(F.desc("held"), "entry")
    rare = placed.join(spans, "entry").withColumn("place", F.row_number().over(commonest)).where(F.col("place") >= VOTES)
    rare = cut_lineage(rare.select("entry", "id", "root"), "rare")
    p, q = rare.alias("p"), rare.alias("q")
    across = (F.col("p.entry") == F.col("q.entry")) & (F.col("p.root") != F.col("q.root")) & (F.col("p.id") < F.col("q.id"))
    rest = p.join(q, across).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    links = links.union(_linked(rest, same))
    roots = components(links)
    placed = same.select("id", "low").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        F.col("id").alias("picture"), F.coalesce("root", "id").alias("root"), "low"
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("copy_group"))
    # all pictures of an id have one root
    owners = held.groupBy("owner").agg(F.min("picture").alias("picture")).join(placed, "picture").join(lowest, "root")
    rows = found.select("id", (F.length("corners") / CORNER.itemsize).cast("long").alias("n_corners"))
    grouped = rows.join(owners.select(F.col("owner").alias("id"), "copy_group"), "id", "left")
    return grouped.select(F.col("id").alias(id_col), "n_corners", F.coalesce("copy_group", "id").alias("copy_group"))


# --- pictures for tables that have none ----------------------------------------------


def _spread(k: int, size: int) -> np.ndarray:
    """Matrix that stretches k grid values to ``size`` pixels, linear between them."""
    at = np.linspace(0, k - 1, size)
    m = np.zeros((size, k))
    low = np.minimum(at.astype(int), k - 2)
    m[np.arange(size), low] = 1 - (at - low)
    m[np.arange(size), low + 1] += at - low
    return m.astype(np.float32)


def draw(scenes: np.ndarray, edits: np.ndarray, size: int = 64) -> np.ndarray:
    """Grey pictures of scenes (numbers), cropped, lit, turned by quarters, grained and stamped
    as the numbers ``edits`` say."""
    n, whole = len(scenes), size + 12
    noise = mix(np.add.outer(scenes.astype(np.uint64) * np.uint64(1000), np.arange(25 * 25 + 11 * 11, dtype=np.uint64)))
    grey = (noise >> np.uint64(40)).astype(np.float32) / (1 << 24)
    fine, coarse = grey[:, : 25 * 25].reshape(n, 25, 25), grey[:, 25 * 25 :].reshape(n, 11, 11)
    f, c = _spread(25, whole), _spread(11, whole)
    scene = 0.55 * (f @ fine @ f.T) + 0.45 * (c @ coarse @ c.T)
    e = mix(edits.astype(np.uint64) + np.uint64(77))
    plain = e % np.uint64(4) == 0
    dx, dy = ((e >> np.uint64(8)) % np.uint64(13)).astype(int), ((e >> np.uint64(16)) % np.uint64(13)).astype(int)
    gain = np.where(plain, 1.0, 0.7 + ((e >> np.uint64(24)) % np.uint64(30)).astype(float) / 100)
    lift = np.where(plain, 0.0, ((e >> np.uint64(32)) % np.uint64(40)).astype(float) / 400)
    turns = np.where(plain, 0, (e >> np.uint64(40)) % np.uint64(4)).astype(int)
    grain = np.where(plain, 0, (e >> np.uint64(44)) % np.uint64(3)).astype(int)
    out = np.empty((n, size, size), np.uint8)
    for i in range(n):
        part = scene[i, dy[i] : dy[i] + size, dx[i] : dx[i] + size] * gain[i] + lift[i]
        if not plain[i]:
            part[:10, :14] = 1.0
        part = part * 255
        if grain[i]:
            part = part + grain[i] * (_noise(e[i], size * size).reshape(size, size) - 0.5)
        out[i] = np.rot90(np.clip(part, 0, 255), turns[i])
    return out


def _noise(seed: np.uint64, n: int) -> np.ndarray:
    return (mix(seed + np.arange(n, dtype=np.uint64)) >> np.uint64(40)).astype(np.float32) / (1 << 24)


def lead_images(pages: DataFrame, page_id: str, scene: Column) -> DataFrame:
    """(page_id, image): a binary PGM per page that shows its scene, in an edit of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                ids = batch.column(0).slice(a, BATCH)
                pictures = draw(batch.column(1).slice(a, BATCH).to_numpy().view(np.uint64), ids.to_numpy())
                data = [b"P5\n64 64\n255\n" + p.tobytes() for p in pictures]
                yield pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary())], ["page_id", "image"])

    rows = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).cast("long").alias("page_id"), scene.cast("long").alias("scene"))
    return rows.mapInArrow(run, "page_id long, image binary")
