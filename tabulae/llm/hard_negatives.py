"""Hard negatives of anchor rows by inner product, searched along spanning trees
of the anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulae.session import discard, reuse

# Anchors of a block (one spanning tree), candidates of a chunk; blocks and chunks
# that meet in one task, on average.
BLOCK, CHUNK = 512, 4096
BLOCKS, CHUNKS = 4, 16
# Bits of the random projections whose signs put similar rows side by side.
SIDE_BITS, SEED = 24, 5
# Vectors up to this norm have exact inner products in doubles; those of longer
# ones are taken with whole numbers, and end at +-2^53.
EXACT_NORM, MOST = 2.0 ** 26, 1 << 53


def _vectors(scale: float):
    """(id, label, anchor, v: floor(scale * x) as doubles, norm, side), without
    rows whose vector is null or holds a null or non-finite component."""
    def run(batches: Iterator[pa.RecordBatch]):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            kept, out, norm, side = [], [], [], []
            for i, v in enumerate(batch.column(3).to_pylist()):
                if v is None or None in v:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(np.array(v, np.float64) * scale) + 0.0
                if not np.isfinite(x).all():
                    continue
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((len(x), SIDE_BITS))
                size = float(np.abs(x).max(initial=0)) or 1.0
                kept.append(i)
                out.append(x.tobytes())
                norm.append(size * float(np.linalg.norm(x / size)) * (1 + 1e-9))
                side.append(int((x / size @ planes[len(x)] > 0) @ (1 << np.arange(SIDE_BITS))))
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(out, pa.binary()), pa.array(norm, pa.float64()), pa.array(side, pa.int32())],
                ["id", "label", "anchor", "v", "norm", "side"])
    return run


def _packs(size: int):
    """Runs of up to ``size`` rows of one label, one row each: ids, vectors, norms."""
    names = ["pack", "label", "ids", "sizes", "vectors", "norms"]

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        pack = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def emit():
            nonlocal held, pack
            row = [pack, held[0]["label"], [r["id"] for r in held], [len(r["v"]) // 8 for r in held],
                   b"".join(r["v"] for r in held), np.array([r["norm"] for r in held]).tobytes()]
            pack, held = pack + 1, []
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int64(), label_type, pa.list_(pa.int64()), pa.list_(pa.int32()),
                                                        pa.binary(), pa.binary()), strict=True)], names)

        label_type = None
        for batch in batches:
            label_type = batch.schema.field("label").type
            for r in batch.to_pylist():
                if held and (len(held) == size or held[0]["label"] != r["label"]):
                    yield emit()
                held.append(r)
        if held:
            yield emit()
    return run


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Packs of rows of one label whose projections fall on the same sides. Ids
    are the last sort key, so equal vectors spread over packs and tasks."""
    label = rows.schema["label"].dataType.simpleString()
    order = ["label", "side", "id"]
    dealt = rows.repartitionByRange(max(1, rows.rdd.getNumPartitions()), *order).sortWithinPartitions(*order)
    return reuse(dealt.select("id", "label", "v", "norm").mapInArrow(
        _packs(size), f"pack long, label {label}, ids array<bigint>, sizes array<int>, vectors binary, norms binary"))


class Rows:
    """Rows of packs: vectors (filled up with zeros to one width), norms, ids;
    sorted by id, nulls last, so that the first of equal scores wins."""

    def __init__(self, packs: list[dict], keep_order: bool = False):
        ids = [i for p in packs for i in p["ids"]]
        sizes = np.array([n for p in packs for n in p["sizes"]], np.int64)
        flat = np.frombuffer(b"".join(p["vectors"] for p in packs), np.float64)
        x = np.zeros((len(ids), int(sizes.max(initial=0))))
        x[np.arange(x.shape[1]) < sizes[:, None]] = flat
        norm = np.frombuffer(b"".join(p["norms"] for p in packs), np.float64)
        label = [p["label"] for p in packs for _ in p["ids"]]
        null = np.array([i is None for i in ids], bool)
        number = np.array([0 if i is None else i for i in ids], np.int64)
        order = np.arange(len(ids)) if keep_order else np.lexsort([number, null])
        self.x, self.norm, self.ids, self.null = x[order], norm[order], number[order], null[order]
        self.label = np.array([label[i] for i in order], object)


def scores(a: np.ndarray, norm: float, rows: Rows, at: np.ndarray) -> np.ndarray:
    """Inner products of the integer vector ``a`` with the rows ``at``."""
    width = min(len(a), rows.x.shape[1])
    x = rows.x[at, :width] if len(at) < len(rows.x) else rows.x[:, :width]
    if norm <= EXACT_NORM and rows.norm[at].max(initial=0) <= EXACT_NORM:
        return x @ a[:width]
    whole = [int(v) for v in a[:width]]
    exact = [sum(p * int(v) for p, v in zip(whole, row, strict=True)) for row in x]
    return np.array([max(-MOST, min(MOST, s)) for s in exact], np.float64)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, distance to it) of each row in a minimum spanning tree by
    Euclidean distance; row 0 is the root."""
    n = len(x)
    parent, gap = np.zeros(n, np.int64), np.full(n, np.inf)
    left = np.ones(n, bool)
    k = 0
    for _ in range(n - 1):
        left[k] = False
        with np.errstate(over="ignore"):
            d = x - x[k]
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
        near = left & (d < gap)
        gap[near], parent[near] = d[near], k
        k = int(np.argmin(np.where(left, gap, np.inf)))
    parent[0], gap[0] = -1, np.inf
    return parent, gap


def _walk(parent: np.ndarray) -> Iterator[tuple[int, bool, bool]]:
    """(row, is it its parent's last child, has it children), parents first and
    the largest subtree last: with rows forgotten once their last child is taken,
    about log2(n) rows are open at a time."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            children[p].append(k)
    order, stack = [], [0]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += children[k]
    size = np.ones(n, np.int64)
    for k in reversed(order[1:]):
        size[parent[k]] += size[k]
    visits = [(0, True)]
    while visits:
        k, last = visits.pop()
        yield k, last, bool(children[k])
        kids = sorted(children[k], key=lambda c: -size[c])  # popped from the end: smallest first
        visits += [(c, i == 0) for i, c in enumerate(kids)]


def search(anchors: Rows, rows: Rows, windows: np.ndarray, k: int) -> tuple[list[list[tuple[np.ndarray, np.ndarray]]], int]:
    """For each anchor and each of its windows (``windows[anchor, w]`` = lowest
    and highest score; NaN: none) the first ``k`` rows whose score is in it,
    highest first, ties in the rows' order: (rows, scores). Also how many scores
    were computed.

    Anchors are visited along their spanning tree. A parent's score, or bounds
    of it, plus and minus the length of the edge times a row's norm bound the
    child's score; only rows whose bounds overlap one of its windows (from the
    k-th best score known so far up) are scored."""
    n, found, scored = len(rows.x), [], 0
    found = [[] for _ in anchors.ids]
    if not n or not len(anchors.ids):
        return [[(np.zeros(0, np.int64), np.zeros(0)) for _ in range(windows.shape[1])] for _ in anchors.ids], 0
    parent, gap = spanning_tree(anchors.x)
    everything, wide = np.arange(n), rows.norm > EXACT_NORM
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a, last, goes_on in _walk(parent):
        p, wanted = int(parent[a]), windows[a][~np.isnan(windows[a]).any(axis=1)]
        if p < 0 or max(anchors.norm[a], anchors.norm[p]) > EXACT_NORM:
            low, high = np.full(n, -np.inf), np.full(n, np.inf)
        else:
            low, high = bounds.pop(p) if last else (x.copy() for x in bounds[p])
            if gap[a] > 0:  # equal anchors have equal scores
                slack = rows.norm * (gap[a] * (1 + 1e-9)) + 1e-6
                low -= slack
                high += slack
                low[wide], high[wide] = -np.inf, np.inf
        todo = np.zeros(n, bool)
        if len(wanted):
            # What the parent found is likely good: its scores raise the least one that counts.
            seed = np.unique(np.concatenate([at for at, _ in found[p]])) if p >= 0 else everything[:0]
            known = scores(anchors.x[a], anchors.norm[a], rows, seed) if len(seed) else np.zeros(0)
            scored += len(seed)
            for lowest, highest in wanted:
                inside = known[(known >= lowest) & (known <= highest)]
                least = np.sort(inside)[-k] if len(inside) >= k else lowest
                todo |= (high >= least) & (low <= highest)
            todo[seed] = True
        exact = low == high
        at = np.flatnonzero(todo & ~exact)
        if len(at) > n // 2:
            at = everything
        if len(at):
            low[at] = high[at] = scores(anchors.x[a], anchors.norm[a], rows, at)
            scored += len(at)
        for window in windows[a]:
            if np.isnan(window).any():
                found[a].append((everything[:0], np.zeros(0)))
                continue
            inside = np.flatnonzero((low == high) & (low >= window[0]) & (low <= window[1]))
            found[a].append(_first(inside, low[inside], k))
        if goes_on:
            bounds[a] = (low, high)
    return found, scored


def _first(at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, of equal ones the first."""
    if len(at) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        pick = np.concatenate([above, np.flatnonzero(score == least)[:k - len(above)]])
        at, score = at[pick], score[pick]
    order = np.lexsort([at, -score])
    return at[order], score[order]


def _cells(blocks: DataFrame, chunks: DataFrame, keys: list[str]):
    """Both sides dealt to the cells (keys, b, s) of a grid in which every block
    meets every chunk of equal keys once: about ``BLOCKS`` blocks and ``CHUNKS``
    chunks a cell, by hash, so no label's rows meet in one task. What is
    shuffled are packs, not pairs of rows."""
    def count(packs: DataFrame, name: str, size: int) -> DataFrame:
        return packs.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count("*") / size)).alias(name))

    on = keys or ["all"]
    blocks, chunks = ((blocks, chunks) if keys else (x.withColumn("all", F.lit(0)) for x in (blocks, chunks)))
    parts = [count(blocks, "nb", BLOCKS), count(chunks, "nc", CHUNKS)]
    if not keys:
        parts = [x.withColumn("all", F.lit(0)) for x in parts]
    grid = reuse(parts[0].join(parts[1], on))  # one row a label

    def mine(n: str) -> Column:
        return F.pmod(F.xxhash64("pack", F.lit(11)), F.col(n))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = blocks.join(grid, on).withColumn("b", mine("nb")).withColumn("s", each("nc")).drop("nb", "nc")
    right = chunks.join(grid, on).withColumn("s", mine("nc")).withColumn("b", each("nb")).drop("nb", "nc")
    by = [*on, "b", "s"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)), grid


def _meet(windows_of, same_label: bool, k: int):
    """A cell: each block's anchors searched among the chunks' rows of its label,
    or of all others. (pack, pos, window, anchor_id, own, id, score): ``own`` marks
    the anchor's own row or a copy of it."""
    names = ["pack", "pos", "window", "anchor_id", "own", "id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks, out = right.to_pylist(), {n: [] for n in names}
        for block in left.to_pylist():
            anchors = Rows([block], keep_order=True)
            rows = Rows([c for c in chunks if (c["label"] == block["label"]) == same_label])
            found, _ = search(anchors, rows, windows_of(block), k)
            for pos, per in enumerate(found):
                of_self = scores(anchors.x[pos], anchors.norm[pos], anchors, np.array([pos]))[0]
                for w, (at, score) in enumerate(per):
                    anchor = None if anchors.null[pos] else int(anchors.ids[pos])
                    out["own"] += ((rows.ids[at] == anchor) & ~rows.null[at] & (score == of_self)).tolist() if same_label and anchor is not None \
                        else [False] * len(at)
                    out["id"] += [None if rows.null[i] else int(rows.ids[i]) for i in at]
                    out["score"] += [int(x) for x in score]
                    for name, x in (("pack", block["pack"]), ("pos", pos), ("window", w), ("anchor_id", anchor)):
                        out[name] += [x] * len(at)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.table([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)
    return run


_FOUND = "pack long, pos int, window int, anchor_id long, own boolean, id long, score long"


def _windows(low: int, n_positives: int):
    """Windows of a block: low % of each positive's score to that score."""
    def of(block: dict) -> np.ndarray:
        out = np.full((len(block["ids"]), n_positives, 2), np.nan)
        for w in block["windows"]:
            out[w["pos"], w["window"]] = -(-low * w["score"] // 100), w["score"]
        return out
    return of


def mine_hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding", scale: float = 256, n_positives: int = 5, n_negatives: int = 5,
                        low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row for which ``anchor`` holds and each of its first
    ``n_positives`` other rows of the same label, the first ``n_negatives`` rows of
    other labels whose score is from ``low`` % of the positive's up to the
    positive's. A score is the inner product of the floors of ``scale`` times the
    vectors, in double precision; higher ones come first, ties by smaller id.

    Anchors are packed into blocks of one label and alike projections, all rows
    into chunks. Blocks meet chunks in a grid of cells, once for the positives (equal
    labels only) and once for the negatives; a cell searches along the block's
    spanning tree (``search``) and returns a few rows an anchor, which are ranked
    across cells.

    Rows with a null label, a null vector, or null or non-finite components take
    no part. Repeated rows are rows of their own: an anchor that is there twice
    has its copy as a positive and is mined twice. Rows with a null id may be
    found (after all ids of the same score) and are anchors if ``anchor`` says so.
    Vectors of different length are compared as if the shorter went on with
    zeros. Scores beyond 2^53 end there. Extra columns are ignored; an empty
    table gives no rows.
    """
    known = df.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    label = known.schema["label"].dataType.simpleString()
    rows = reuse(known.mapInArrow(_vectors(scale), f"id long, label {label}, anchor boolean, v binary, norm double, side int"))
    blocks, chunks = _pack(rows.where("anchor"), BLOCK), _pack(rows, CHUNK)
    discard(rows)

    first = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    met, grid = _cells(blocks, chunks, ["label"])
    same = met.applyInArrow(_meet(lambda b: np.tile([[[-np.inf, np.inf]]], (len(b["ids"]), 1, 1)), True, n_positives + 1), _FOUND)
    ranked = Window.partitionBy("pack", "pos").orderBy(*first, "own")
    so_far = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    selves = F.sum(F.col("own").cast("int")).over(so_far)
    positives = reuse(
        same.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n_positives + 1)
        .withColumn("selves", selves).where(~(F.col("own") & (F.col("selves") == 1)))
        .withColumn("window", (F.col("rank") - F.least(F.lit(1), "selves") - 1).cast("int")).where(F.col("window") < n_positives)
        .select("pack", "pos", "window", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    discard(grid)
    wanted = positives.groupBy("pack").agg(F.collect_list(F.struct("pos", "window", F.col("positive_score").alias("score"))).alias("windows"))
    met, _ = _cells(reuse(blocks.join(wanted, "pack")), chunks, [])
    other = met.applyInArrow(_meet(_windows(low, n_positives), False, n_negatives), _FOUND)
    by = Window.partitionBy("pack", "pos", "window").orderBy(*first)
    negatives = other.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n_negatives)
    return (negatives.select("pack", "pos", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(positives, ["pack", "pos", "window"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
