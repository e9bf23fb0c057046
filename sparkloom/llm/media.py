"""Media columns: cropped and edited copies of images, by local descriptors, Hamming tables and geometric consensus."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import small
from .common import cut

#: Least corners kept at full and at half size, and pixels for each more; radius of the patch; levels of orientation; bits of a descriptor.
CORNERS, AREA, RADIUS, ANGLES, BITS = (24, 20), 270, 9, 32, 128
#: A match: one half of the bits equal and at most so many others not. A copy: so many matches or more that agree on turn, size and
#: shift: positions within this many pixels, orientations within this many levels, sizes within a factor of 1.5 of the octaves'.
NEAR, VOTES, TOLERANCE, TURN = 12, 4, 3.0, 2
#: Rows of a key up to which they are joined with each other; common keys of an image up to which two are combined.
FEW, WIDE = 16, 128


def pattern(seed: int = 3) -> np.ndarray:
    """(ANGLES, BITS, 2 points, y and x): pairs of points near the centre, turned by each angle."""
    rng = np.random.default_rng(seed)
    base = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS / 1.45, RADIUS / 1.45)
    turn = np.arange(ANGLES) * (2 * np.pi / ANGLES)
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    y, x = base[None, ..., 0], base[None, ..., 1]
    return np.rint(np.stack([s * x + c * y, c * x - s * y], axis=-1)).astype(np.int64)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM image; None for what is not one."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m:
        return None
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    raw = np.frombuffer(data, np.uint8, offset=m.end())
    if not w or not h or len(raw) < w * h * depth:
        return None
    grey = raw[: w * h * depth].reshape(h, w, depth).astype(np.float32)
    return grey.mean(axis=2)


def encode(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.clip(grey, 0, 255).astype(np.uint8).tobytes()


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1, edges repeated; a: (images, height, width)."""
    for axis in (1, 2):
        width = [(0, 0)] * 3
        width[axis] = (r + 1, r)
        s = np.cumsum(np.pad(a, width, mode="edge"), axis=axis, dtype=np.float64)
        hi, lo = [slice(None)] * 3, [slice(None)] * 3
        hi[axis], lo[axis] = slice(2 * r + 1, None), slice(None, -(2 * r + 1))
        a = (s[tuple(hi)] - s[tuple(lo)]) / (2 * r + 1)
    return a


def describe(stack: np.ndarray, n: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x, level of orientation, bits) of up to n corners of each image of one size: Harris responses, the largest in their neighbourhood first."""
    b, h, w = stack.shape
    m = RADIUS + 1
    if h <= 2 * m + 2 or w <= 2 * m + 2:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros((0, BITS // 8), np.uint8),)
    smooth = box(stack, 1)
    gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
    gy[:, 1:-1], gx[:, :, 1:-1] = smooth[:, 2:] - smooth[:, :-2], smooth[:, :, 2:] - smooth[:, :, :-2]
    xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    score = (xx * yy - xy * xy - 0.05 * (xx + yy) ** 2)[:, m:-m, m:-m]
    peak = np.pad(score, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    top = score
    for i in range(3):
        for j in range(3):
            top = np.maximum(top, peak[:, i : i + score.shape[1], j : j + score.shape[2]])
    flat = np.where((score >= top) & (score > 1e-3), score, -np.inf).reshape(b, -1)
    k = min(n, flat.shape[1])
    at = np.argpartition(-flat, k - 1, axis=1)[:, :k]
    image = np.repeat(np.arange(b), k)
    at = at.ravel()
    good = flat[image, at] > -np.inf
    image, at = image[good], at[good]
    y, x = at // score.shape[2] + m, at % score.shape[2] + m
    r = np.arange(-7, 8)
    patch = smooth[image[:, None, None], y[:, None, None] + r[:, None], x[:, None, None] + r[None, :]]
    disc = (r[:, None] ** 2 + r[None, :] ** 2) <= 49
    angle = np.arctan2((patch * (disc * r[:, None])).sum(axis=(1, 2)), (patch * (disc * r[None, :])).sum(axis=(1, 2)))
    level = np.rint(angle * (ANGLES / (2 * np.pi))).astype(np.int64) % ANGLES
    p = pairs[level]
    soft = box(stack, 2)
    v = soft[image[:, None, None], np.clip(y[:, None, None] + p[..., 0], 0, h - 1), np.clip(x[:, None, None] + p[..., 1], 0, w - 1)]
    return image, y, x, level, np.packbits(v[..., 0] < v[..., 1], axis=1)


DESCRIPTOR = "node bigint, pos bigint, d0 bigint, d1 bigint"


def corners(stack: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(image, pos, two halves of the bits) at full and half size of images of one size; pos holds twice the place in the full size (x, y: 20
    bits each), the level of orientation (8 bits) and the octave."""
    for octave, least in enumerate(CORNERS):
        if octave:
            h, w = stack.shape[1] // 2 * 2, stack.shape[2] // 2 * 2
            stack = (stack[:, 0:h:2, 0:w:2] + stack[:, 1:h:2, 0:w:2] + stack[:, 0:h:2, 1:w:2] + stack[:, 1:h:2, 1:w:2]) / 4
        image, y, x, level, bits = describe(stack, max(least, stack.shape[1] * stack.shape[2] // AREA), pairs)
        pos = ((2 * x + 1) << octave) | ((2 * y + 1) << octave << 20) | (level << 40) | (octave << 48)
        yield image, pos, np.frombuffer(bits.tobytes(), ">i8").astype(np.int64).reshape(-1, 2)


def descriptors(images: DataFrame, block: int = 64) -> DataFrame:
    """A row for each corner of each image (node, image) at each scale; d0 and d1 hold the bits.

    Equal images within a batch are described once. No image is shuffled, and no more than a block of one size is decoded at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pattern()

        def rows(part: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            ids, stack = np.array([x[0] for x in part]), np.stack([x[1] for x in part])
            for image, pos, d in corners(stack, pairs):
                yield pa.RecordBatch.from_arrays([pa.array(ids[image], pa.int64()), pa.array(pos, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["node", "pos", "d0", "d1"])

        for b in batches:
            by_shape: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
            seen: set[int] = set()
            for i, data in zip(b.column(0).to_pylist(), b.column(1)):
                if i in seen or (g := decode(data.as_py())) is None:
                    continue
                seen.add(i)
                part = by_shape.setdefault(g.shape, [])
                part.append((i, g))
                if len(part) == block:
                    yield from rows(part)
                    part.clear()
            for part in by_shape.values():
                if part:
                    yield from rows(part)

    return images.select("node", "image").mapInArrow(run, DESCRIPTOR)


def candidates(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of images of which matches lie at VOTES or more corners of a, and few others; shared: key, other, node, pos and n, the rows of the key.

    Corners of one look are common, so pairs of images that match at a single corner grow with the square of the images; they are never
    kept, and never made of keys with over FEW rows. If two of the VOTES corners match by keys with FEW rows or fewer, joining those rows shows
    it. Otherwise three or more match by common keys, and as these are dealt to two bins, two of the three have keys in one bin: images are joined on
    two such keys at once. Combinations that the same images have are joined once. Images with over WIDE common keys would
    have too many combinations, so they are joined on each common key.
    """
    assert VOTES >= 4
    side = lambda d, c: d.select("key", F.col("other").alias(f"{c}o"), F.col("node").alias(c), F.col("pos").alias(f"{c}p"))
    small_near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ao").bitwiseXOR(F.col("bo"))) <= NEAR)
    rare, often = shared.where(F.col("n") <= FEW), cut(shared.where(F.col("n") > FEW))
    wide = small(often.groupBy("node").agg(F.count("*").alias("f")).where(F.col("f") > WIDE).select("node"))
    broad, narrow = often.join(wide, "node", "left_semi"), often.join(wide, "node", "left_anti")
    both = side(rare, "a").join(side(rare, "b"), "key").where(small_near)
    for x, y in ((broad, often), (narrow, broad)):
        both = both.unionByName(side(x, "a").join(side(y, "b"), "key").where(small_near))
    direct = both.groupBy("a", "b").agg(F.min("ap").alias("first"), F.max("ap").alias("last")).where("first < last").select("a", "b")
    part = lambda i: narrow.select("node", F.pmod(F.xxhash64("key"), F.lit(2)).alias("bin"), F.col("key").alias(f"k{i}"), F.col("pos").alias(f"p{i}"))
    sets = part(1).join(part(2), ["node", "bin"]).where("k1 < k2 OR (k1 = k2 AND p1 <= p2)")
    sets = cut(sets.groupBy("node", F.xxhash64("k1", "k2").alias("key")).agg(F.max(F.expr("p1 <> p2")).alias("two")))
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node", "two")).alias(f"s{seed}")
    held = sets.groupBy("key").agg(F.min(F.when(F.col("two"), F.col("node"))).alias("hub"), F.max("node").alias("end"), F.count("*").alias("n"), mark(1), mark(2)).where("hub < end")
    once = cut(sets.join(held.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key"), "key"))
    pair = once.where("two").select("key", F.col("node").alias("a")).join(once.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    return cut(direct.unionByName(pair).distinct())


def matches(found: DataFrame, hot: int | None = None) -> DataFrame:
    """(a, b, ap, bp), a < b: corners of different images, of any scale and orientation, that share a half of their descriptors, and nearly the other.

    Each half is the key of one Hamming table; an equality join finds the matches and the bit count of the other half
    verifies them. Halves of 64 bits keep chance collisions rare: four quarters gave 6,000 times as many candidates. Matches
    are made for the `candidates` only, for these all of them, so that pairs of images that cannot have VOTES corners in common make no rows here. With `hot`,
    all matches are made, but a descriptor that more images share is matched in a star only, which loses links; no query does that.
    """
    other_table = F.lit(0x5BF03635D1B54A33)
    tables = F.array(F.struct(F.col("d0").alias("key"), F.col("d1").alias("other")), F.struct(F.col("d1").bitwiseXOR(other_table).alias("key"), F.col("d0").bitwiseXOR(other_table).alias("other")))
    rows = found.select(F.explode(tables).alias("t"), "node", "pos").select("t.key", "t.other", "node", "pos")
    rows = rows.repartition("key").distinct()  # copies from other batches; the counts and the joins need no other shuffle
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.max("node").alias("end")).where("hub < end")
    shared = cut(rows.join(sizes, "key"))
    less = F.col("a") < F.col("b")
    near = lambda d: d.where(F.bit_count(F.col("ao").bitwiseXOR(F.col("bo"))) <= NEAR).select("a", "b", "ap", "bp")
    side = lambda d, c: d.select("key", F.col("other").alias(f"{c}o"), F.col("node").alias(c), F.col("pos").alias(f"{c}p"))
    if hot is None:
        return near(side(shared, "a").join(small(candidates(shared)), "a").join(side(shared, "b"), ["key", "b"]))
    few, many = shared.where(F.col("n") <= hot), shared.where(F.col("n") > hot)
    pairs = side(few, "a").join(side(few, "b"), "key").where(less).select("a", "ao", "ap", "b", "bo", "bp")
    star = side(many.where("node = hub OR node = end"), "a").join(side(many, "b"), "key").where("a <> b")
    turned = [F.when(less, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("ao", "bo"), ("ap", "bp"), ("b", "a"), ("bo", "ao"), ("bp", "ap"))]
    return near(pairs.unionByName(star.select(*turned)))


def agree(ap: np.ndarray, bp: np.ndarray) -> bool:
    """Whether VOTES or more matches, at different places, follow one turn, change of size and shift: each two of them propose one."""
    ap, bp = np.unique(np.stack([ap, bp], axis=1), axis=0).T
    place = lambda p: ((p & 0xFFFFF) + 1j * (p >> 20 & 0xFFFFF)) / 2
    za, zb = place(ap), place(bp)
    size = 2.0 ** ((bp >> 48) - (ap >> 48))
    turn = ((bp >> 40 & 0xFF) - (ap >> 40 & 0xFF)) * (2 * np.pi / ANGLES)
    for i in range(len(za) - VOTES + 1):
        with np.errstate(all="ignore"):
            z = (zb - zb[i]) / (za - za[i])  # one proposal a row: turn and size as one complex number
        z = z[np.isfinite(z) & (np.abs(za - za[i]) > 4)]
        z = z[(np.abs(np.log(np.abs(z) + 1e-9) - np.log(size[i])) < np.log(1.5)) & (np.abs(np.angle(z * np.exp(-1j * turn[i]))) < TURN * 2 * np.pi / ANGLES)]
        for w in z:
            fits = (np.abs(zb[i] + w * (za - za[i]) - zb) <= TOLERANCE * max(1.0, abs(w))) & (np.abs(np.angle(w * np.exp(-1j * turn))) < TURN * 2 * np.pi / ANGLES) & (np.abs(np.log(np.abs(w)) - np.log(size)) < np.log(1.5))
            if len(np.unique(np.round(za[fits]))) >= VOTES:
                return True
    return False


def consensus(m: DataFrame) -> DataFrame:
    """Pairs of images whose matches agree; at most the product of their corners is gathered for a pair, only where VOTES or more matched."""
    lists = m.groupBy("a", "b").agg(F.collect_list("ap").alias("ap"), F.collect_list("bp").alias("bp")).where(F.size("ap") >= VOTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array([agree(np.array(x), np.array(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_()))

    return lists.mapInArrow(run, "a bigint, b bigint")


def image_copies(images: DataFrame) -> DataFrame:
    """(image_id, class_id, n_links) of each row of images (image_id, image): PGM or PPM bytes.

    Images of equal bytes (by 60 bits of their digest) are one node before any join; class_id is the least id that can be reached over links and equal
    bytes, n_links the number of other, not equal, images linked to these bytes. Null, undecodable, tiny and flat images have no
    corners: only equal bytes bring them together, and nulls stay alone. Repeated rows are kept. Rows without
    image_id get the class of equal bytes, or null if there is no id in it. An empty table gives an empty result; other
    columns of images are not read.
    """
    node = F.coalesce(F.conv(F.substring(F.sha2("image", 256), 1, 15), 16, 10).cast("bigint"), -1 - F.abs(F.xxhash64("image_id")))
    base = images.select(F.col("image_id").cast("bigint").alias("image_id"), "image").withColumn("node", node)
    marked = cut(base.select("image_id", "node"))
    reps = cut(marked.groupBy("node").agg(F.min("image_id").alias("rep")))
    known = reps.where("rep IS NOT NULL")
    found = consensus(matches(descriptors(base.where("image IS NOT NULL"))))
    of = lambda c: known.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"))
    links = cut(found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("rep")).agg(F.count_distinct("b").alias("n_links"))
    comp = connected_components(links).withColumnRenamed("node", "rep")
    named = reps.join(comp, "rep", "left").join(degree, "rep", "left")
    return marked.join(named, "node").select("image_id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


SIDE = 80


def draw(values: bytes) -> np.ndarray:
    """A picture of blocks and discs over smooth noise, all from a hash of the values."""
    rng = np.random.default_rng(zlib.crc32(values) + (zlib.adler32(values) << 32))
    g = np.kron(rng.uniform(40, 200, (SIDE // 5, SIDE // 5)), np.ones((5, 5))) + rng.normal(0, 6, (SIDE, SIDE))
    for y, x, h, w, v in zip(*(rng.integers(0, m, 14) for m in (SIDE, SIDE, 22, 22, 256))):
        g[y : y + h, x : x + w] = 0.3 * g[y : y + h, x : x + w] + 0.7 * v
    return box(np.clip(g, 0, 255)[None], 1)[0]


def edit(g: np.ndarray, values: bytes) -> np.ndarray:
    """A crop, a change of brightness, a caption, a crop that is brighter, half the size, a quarter turn, or noise, as a hash of the values says."""
    rng = np.random.default_rng(zlib.crc32(values[::-1]))
    kind, y, x = rng.integers(0, 7), *rng.integers(0, 13, 2)
    if kind in (0, 3):
        g = g[y : y + SIDE - 14, x : x + SIDE - 14]
    if kind in (1, 3):
        g = g * 0.85 + 20
    if kind == 2:
        g = g.copy()
        g[-12:] = 235
    if kind == 4:
        g = (g[::2, ::2] + g[1::2, ::2] + g[::2, 1::2] + g[1::2, 1::2]) / 4
    if kind == 5:
        g = np.rot90(g)
    if kind == 6:
        g = g + rng.normal(0, 6, g.shape)
    return g


def pictures(embeddings: DataFrame) -> DataFrame:
    """(image_id, image): for each vector a picture drawn from it (id 2v) and an edited copy of that (id 2v + 1); null for null vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, images = [], []
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = None if v is None else np.array([0.0 if x is None else x for x in v], np.float32).tobytes()
                    g = None if raw is None else draw(raw)
                    ids += [None, None] if i is None else [2 * i, 2 * i + 1]
                    images += [None, None] if g is None else [encode(g), encode(edit(g, raw))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["image_id", "image"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "image_id bigint, image binary")


def op10_media(embeddings: DataFrame) -> DataFrame:
    """image_copies, which states the rules, of the pictures drawn from every vector and their edited copies."""
    return image_copies(pictures(embeddings))
