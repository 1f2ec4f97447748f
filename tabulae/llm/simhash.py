"""SimHash near-duplicate groups by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulae.session import reuse

from .common import annotate
from .components import components, local_forest

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
# Most fingerprints in a tile. A pair of tiles holds two tiles (4 MB).
TILE_ROWS = 1 << 18
# Distances computed at once: 64-bit words of a temporary array.
BLOCK_CELLS = 1 << 20


def text_fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text's word shingles, repeats included."""
    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D part words
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[:len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_hash, fp): one row per input row; ``fp`` is the fingerprint as a
    signed 64-bit number. Null and empty texts have fingerprint zero."""
    def make():
        return lambda texts: [pa.array(np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return annotate(rows, "text", [("fp", T.LongType())], make).select("id", "text_hash", "fp")


def _words_pop(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words of each fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (index in a, index in len(a) + b) at
    ``radius`` or fewer differing bits. Rows of ``a`` with equal population
    counts per 16-bit word form a sub-tile; rows of ``b`` whose counts differ
    by more than the radius in sum cannot be near and are skipped."""
    kinds, of_a = np.unique(_words_pop(a), axis=0, return_inverse=True)
    kinds_b, of_b = np.unique(_words_pop(b), axis=0, return_inverse=True)
    order_b = np.argsort(of_b.ravel(), kind="stable")
    order_a = np.argsort(of_a.ravel(), kind="stable")
    cut_a = np.searchsorted(of_a.ravel()[order_a], np.arange(len(kinds) + 1))
    sizes_b = np.bincount(of_b.ravel(), minlength=len(kinds_b))
    n = len(a) + len(b)
    left, right, held = [], [], 0

    def reduce() -> None:
        nonlocal left, right, held
        root = local_forest(np.concatenate(left), np.concatenate(right), n)
        node = np.flatnonzero(root != np.arange(n))
        left, right, held = [node], [root[node]], len(node)

    for k in range(len(kinds)):
        fits = np.abs(kinds_b - kinds[k]).sum(axis=1) <= radius
        cand = order_b[np.repeat(fits, sizes_b)]
        if not len(cand):
            continue
        rows, other = order_a[cut_a[k]:cut_a[k + 1]], b[cand]
        step = max(1, BLOCK_CELLS // len(cand))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            x, y = np.nonzero(np.bitwise_count(a[part][:, None] ^ other[None, :]) <= radius)
            left.append(part[x])
            right.append(cand[y] + len(a))
            held += len(x)
            if held > 4 * n + BLOCK_CELLS:
                reduce()
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reduce()
    return left[0], right[0]


def _links(radius: int):
    def run(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        fps = [v.values.to_numpy().view(np.uint64) for v in cell.column("fps")]
        a = np.concatenate([f for f, s in zip(fps, side, strict=True) if s != 1] or [np.zeros(0, np.uint64)])
        b = np.concatenate([f for f, s in zip(fps, side, strict=True) if s != 0] or [np.zeros(0, np.uint64)])
        i, j = _near(a, b, radius)
        both = np.concatenate([a, b]).view(np.int64)
        return pa.table({"a": both[i], "b": both[j]})
    return run


def near_fingerprints(classes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that span every pair of distinct fingerprints (column
    ``fp``) at ``radius`` or fewer differing bits.

    A tile holds fingerprints of one population count. Tiles whose counts
    differ beyond the radius are never paired; every other pair of tiles is
    one group of rows, compared exactly in numpy. A pair returns a spanning
    forest of its links, never all of them."""
    sized = classes.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    tiles = {r["pop"]: -(-r["count"] // tile_rows) for r in sized.groupBy("pop").count().collect()}  # 65 rows at most
    n_tiles = F.create_map(*[F.lit(x) for p, n in sorted(tiles.items()) for x in (p, n)]) if tiles else None
    if n_tiles is None:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    blocks = (sized.withColumn("tile", F.pmod(F.xxhash64("fp"), n_tiles[F.col("pop")]).cast("int"))
              .groupBy("pop", "tile").agg(F.collect_list("fp").alias("fps")))

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                p, t = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                cells, sides = [], []
                for q in range(max(0, p - radius), min(64, p + radius) + 1):
                    for u in range(tiles.get(q, 0)):
                        first, last = sorted(((p, t), (q, u)))
                        cells.append("{}.{}-{}.{}".format(*first, *last))
                        sides.append(2 if first == last else int((p, t) == last))
                fps = batch.column(2).slice(i, 1)
                for c, s in zip(cells, sides, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([s], pa.int32()), fps],
                                                     ["cell", "side", "fps"])

    cells = blocks.mapInArrow(deal, "cell string, side int, fps array<long>")
    return cells.groupBy("cell").applyInArrow(_links(radius), "a long, b long")


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
                          tile_rows: int = TILE_ROWS, root: bool = False) -> DataFrame:
    """(id_col, fingerprint, component_id, text_hash), one row per input row;
    ``text_hash`` is Spark's xxhash64 of the text. With ``root`` also the
    component's root, a fingerprint that tells components apart without ids.

    Equal fingerprints are one class before any comparison, so groups of
    copies cost one row. ``component_id`` is the smallest id reachable over
    links of at most ``radius`` differing bits. Null and empty texts share
    the zero fingerprint and are linked like any other; repeated rows keep
    their own output row; a null id is returned as it is and never chosen as
    a component's id unless all its members are null; extra columns are
    ignored; an empty table gives no rows."""
    rows = reuse(fingerprints(df, id_col, text_col, shingle))
    classes = reuse(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(near_fingerprints(classes, radius, tile_rows))
    rooted = reuse(classes.join(found, classes.fp == found.node, "left")
                   .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Written before the join, so that adaptive execution can split a hot root.
    ids = reuse(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    member = rooted.join(ids, "root").select("fp", "component_id", "root")
    return (rows.join(member, "fp")
            .select(F.col("id").alias(id_col),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash",
                    *(["root"] if root else [])))
