"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.session import reuse

from .components import components, local_forest

MIN_COSINE = 0.93
# Hash bits that an ordering concatenates, and neighbours compared at least.
BITS, NEIGHBOURS = 32, 24
# Chance that no pass puts a pair at the least cosine in one run: it sets a label's passes.
MISS = 1e-4
# What sorting a row costs, in comparisons; and rows of a run that one task compares.
ROW_COST, MAX_RUN = 2048, 8192
SEED = 3
# Vectors of a component or run that are compared with each other at once, and
# rows of a block inside a sorted partition.
TILE, BLOCK = 1024, 256
# Links after which a task keeps a spanning forest of them only.
MAX_LINKS = 1 << 20


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _valid(batches: Iterator[pa.RecordBatch]):
    """Vectors as bytes of doubles; null ones, zero ones and those with null or
    non-finite components become null."""
    for batch in batches:
        out = []
        for v in batch.column(2).to_pylist():
            ok = v is not None and None not in v
            x = np.array(v, np.float64) if ok else None
            with np.errstate(over="ignore"):
                ok = ok and len(x) > 0 and np.isfinite(x).all() and np.isfinite(x @ x) and x @ x > 0
            out.append((x + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "v"])


def _moments(batches: Iterator[pa.RecordBatch]):
    """Count and sum of the unit vectors of each label and width, per batch."""
    for batch in batches:
        label, width = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            x = _unit(_matrix(batch.column(2).take(pa.array(at))))
            order = np.argsort(label[at], kind="stable")
            found, first, n = np.unique(label[at][order], return_index=True, return_counts=True)
            total = np.add.reduceat(x[order], first, axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(np.full(len(found), w, np.int32)), pa.array(n, pa.int64()),
                 pa.array([t.tobytes() for t in total], pa.binary())], ["label", "width", "n", "sum"])


def plan(n: int, spread: float, min_cosine: float = MIN_COSINE, miss: float = MISS, bits: int = BITS) -> tuple[int, int]:
    """(passes, depth) of a label with ``n`` vectors whose mean cosine with each
    other is ``spread``: rows that agree in the first ``depth`` bits of a pass
    are a run, compared as a whole. There are as many passes as leave a pair at
    ``min_cosine`` the chance ``miss`` to share no run, and the depth is the
    cheapest; few vectors get one pass with a single run."""
    centred = (min_cosine - spread) / max(1e-9, 1 - spread)
    agree = 1 - np.arccos(np.clip(centred, 0, 1)) / np.pi
    depth = np.arange(bits + 1)
    with np.errstate(divide="ignore"):
        passes = np.maximum(1, np.ceil(np.log(miss) / np.log1p(-agree ** depth)))
    run = n / 2.0 ** depth
    rows = np.where(run > MAX_RUN, 1 + run / TILE, 1)  # a longer run is dealt to pairs of tiles
    best = int(np.argmin(passes * (ROW_COST * rows + run)))
    return int(passes[best]), best


def _plans(min_cosine: float, miss: float, bits: int):
    """One label's centre and plan, from its ``_moments``."""
    def run(rows: pa.Table) -> pa.Table:
        n = int(rows.column("n").to_numpy().sum())
        centre = _matrix(rows.column("sum").combine_chunks()).sum(axis=0) / n
        passes, depth = plan(n, float(centre @ centre), min_cosine, miss, bits)
        return pa.table({"label": rows.column("label")[:1], "width": rows.column("width")[:1], "passes": pa.array([passes], pa.int32()),
                         "depth": pa.array([depth], pa.int32()), "centre": pa.array([centre.tobytes()], pa.binary())})
    return run


def _orderings(bits: int, vectors: bool = True):
    """Each vector once per pass of its label, with its sort key: the signs of
    ``bits`` random projections of the vector less its label's centre,
    concatenated. Equal first ``depth`` bits are a run."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            size = batch.column(2).to_numpy()
            for width in np.unique(size):
                rows = batch.take(pa.array(np.flatnonzero(size == width)))
                x = _unit(_matrix(rows.column(3))) - _matrix(rows.column(6))
                passes, depth = rows.column(4).to_numpy(), rows.column(5).to_numpy().astype(np.int64)
                for p in range(passes.max()):
                    at = np.flatnonzero(passes > p)
                    rng = np.random.default_rng([SEED, int(width), p])
                    sign = (x[at] @ rng.standard_normal((x.shape[1], bits)) > 0).astype(np.int64)
                    key = sign @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    part = rows.take(pa.array(at))
                    out = [pa.array(np.full(len(at), p, np.int32)), part.column(1), part.column(2), pa.array(key >> (bits - depth[at]))]
                    names = ["pass", "label", "width", "run"]
                    if vectors:
                        out, names = out + [pa.array(key), part.column(0), part.column(3)], [*names, "key", "c", "v"]
                    yield pa.RecordBatch.from_arrays(out, names)
    return run


class _Forest:
    """A spanning forest of links among ``n`` indexes, added part by part."""

    def __init__(self, n: int):
        self.n, self.parts, self.held = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.held += len(a)
        if self.held > MAX_LINKS:
            self.parts = [self.links()]
            self.held = 0

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not sum(len(a) for a, _ in self.parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        root = local_forest(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.n)
        a = np.flatnonzero(root != np.arange(self.n))
        return a, root[a]


def _compare(min_cosine: float, neighbours: int):
    """A spanning forest of the links between a row and the rows before it in
    its run, ``neighbours`` rows at least, in the same pass, label and width.
    Rows come sorted; the last run is carried over from batch to batch."""
    def run(batches: Iterator[pa.RecordBatch]):
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            had = 0 if tail is None else tail.num_rows
            group = np.stack([table.column(n).to_numpy() for n in ("pass", "label", "width")], axis=1)
            ids, runs = table.column("c").to_numpy(), table.column("run").to_numpy()
            found = _Forest(len(ids))
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                x = _unit(_matrix(table.column("v").slice(lo, hi - lo).combine_chunks()))
                begin = np.searchsorted(runs[lo:hi], runs[lo:hi])
                begin = np.maximum(0, np.minimum(begin, np.arange(hi - lo) - neighbours))
                for s in range(max(0, had - lo), hi - lo, BLOCK):
                    e, first = min(s + BLOCK, hi - lo), begin[s]
                    i, j = np.nonzero(x[s:e] @ x[first:e].T >= min_cosine)
                    i, j = i + s, j + first
                    found.add(i[j < i] + lo, j[j < i] + lo)
            a, b = found.links()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])
            keep = lo + min(int(begin[-1]), max(0, hi - lo - neighbours))
            tail = table.slice(keep).combine_chunks().to_batches()[0]
    return run


def _tile_links(min_cosine: float):
    """A spanning forest of the links of a pair of tiles."""
    def run(rows: pa.Table) -> pa.Table:
        side, ids = rows.column("side").to_numpy(), rows.column("c").to_numpy()
        left, right = (np.flatnonzero(side != s) for s in (1, 0))
        x = _unit(_matrix(rows.column("v").combine_chunks()))
        found = _Forest(len(ids))
        i, j = np.nonzero(x[left] @ x[right].T >= min_cosine)
        i, j = left[i], right[j]
        found.add(i[i != j], j[i != j])
        a, b = found.links()
        return pa.table({"a": ids[a], "b": ids[b]})
    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (``c``, ``tiles``) dealt to ``tiles`` tiles, each once per pair
    (``lo``, ``hi``) that its tile is in; ``side`` 2 is a tile with itself."""
    return (rows.withColumn("t", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
            .withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumns({"lo": F.least("t", "u"), "hi": F.greatest("t", "u"),
                          "side": F.when(F.col("t") == F.col("u"), 2).otherwise((F.col("t") > F.col("u")).cast("int"))}))


def neighbour_links(classes: DataFrame, min_cosine: float = MIN_COSINE, bits: int = BITS, neighbours: int = NEIGHBOURS,
                    miss: float = MISS, max_run: int = MAX_RUN) -> DataFrame:
    """Links (a, b) that span what is found among vectors (columns ``c`` long,
    ``label``, ``v`` bytes of doubles): all passes are sorted together, label by
    label, and each vector is compared with its whole run and its neighbours in
    each pass. Passes and depth follow each label's count (``plan``). Range
    partitions do not split a run; one of more than ``max_run`` rows is compared
    as pairs of tiles."""
    sized = classes.select("c", "label", F.length("v").alias("width"), "v")
    plans = reuse(sized.select("label", "width", "v").mapInArrow(_moments, "label int, width int, n long, sum binary")
                  .groupBy("label", "width")
                  .applyInArrow(_plans(min_cosine, miss, bits), "label int, width int, passes int, depth int, centre binary"))
    planned = sized.join(plans, ["label", "width"]).select("c", "label", "width", "v", "passes", "depth", "centre")
    run = ["pass", "label", "width", "run"]
    kinds = "pass int, label int, width int, run long"
    large = reuse(planned.mapInArrow(_orderings(bits, False), kinds).groupBy(*run).agg(F.count("*").alias("size"))
                  .where(F.col("size") > max_run).select(*run, F.ceil(F.col("size") / TILE).cast("int").alias("tiles")))
    rows = planned.mapInArrow(_orderings(bits), f"{kinds}, key long, c long, v binary")
    dense = not large.isEmpty()
    light = (rows.join(large, run, "left_anti") if dense else rows).withColumn("tie", F.xxhash64("pass", "c"))
    links = (light.repartitionByRange(*run).sortWithinPartitions(*run, "key", "tie").drop("key", "tie")
             .mapInArrow(_compare(min_cosine, neighbours), "a long, b long"))
    if dense:
        links = links.unionByName(_dealt(rows.join(large, run)).select(*run, "lo", "hi", "side", "c", "v")
                                  .groupBy(*run, "lo", "hi").applyInArrow(_tile_links(min_cosine), "a long, b long"))
    return links


def _pairs_counted(min_cosine: float):
    """Per vector of a pair of tiles, the copies that its links there stand for."""
    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        ids, n = rows.column("c").to_numpy(), rows.column("n").to_numpy()
        width = np.array([len(v) for v in rows.column("v").to_pylist()])
        out_id, out_n = [], []
        for w in np.unique(width):
            left, right = (np.flatnonzero((width == w) & (side != s)) for s in (1, 0))
            if not len(left) or not len(right):
                continue
            x, y = (_unit(_matrix(rows.column("v").take(pa.array(k)).combine_chunks())) for k in (left, right))
            near = x @ y.T >= min_cosine
            near &= ids[left][:, None] != ids[right][None, :]
            out_id += [ids[left]] if side[left[0]] == 2 else [ids[left], ids[right]]
            out_n += [near @ n[right]] if side[left[0]] == 2 else [near @ n[right], n[left] @ near]
        if not out_id:
            return pa.table({"c": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        return pa.table({"c": np.concatenate(out_id), "links": np.concatenate(out_n).astype(np.int64)})
    return run


def count_links(members: DataFrame, min_cosine: float = MIN_COSINE, tile: int = TILE) -> DataFrame:
    """(c, links): how many vectors of its own component each vector links with
    (columns ``c``, ``n`` copies, ``v``, ``root``), exactly: a component's
    vectors are dealt to tiles, and every two tiles of one are one group."""
    sizes = (members.groupBy("root").agg(F.count("*").alias("size"))
             .select("root", F.ceil(F.col("size") / tile).cast("int").alias("tiles")))
    return (_dealt(members.join(sizes, "root")).select("root", "lo", "hi", "side", "c", "n", "v").groupBy("root", "lo", "hi")
            .applyInArrow(_pairs_counted(min_cosine), "c long, links long")
            .groupBy("c").agg(F.sum("links").alias("links")))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           min_cosine: float = MIN_COSINE, bits: int = BITS, neighbours: int = NEIGHBOURS,
                           miss: float = MISS, max_run: int = MAX_RUN) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    Vectors with one label link at cosine ``min_cosine`` or more, in double
    precision. Equal vectors of a label are one class first. Links are looked
    for in orderings by concatenated random hashes, as many as the label's count
    asks for (``plan``): in each, whole runs of equal first bits are compared,
    and ``neighbours`` neighbours at least. The verified links are united over
    all passes; so a component may miss a link, but has no false one. Inside the
    components all links are then counted exactly, whatever their size.

    Rows with a null label, or a vector that is null, empty, zero or holds null
    or non-finite components, link with nothing: they are their own component.
    Vectors of different lengths never link. Rows that repeat an id count as
    separate vectors with one id; a row with a null id stays unlinked.
    ``kept`` says that a row's id is its component's. Extra columns are
    ignored; an empty table gives no rows.
    """
    rows = reuse(df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"),
                           F.col(vector_col).alias("v"))
                 .mapInArrow(_valid, "id long, label int, v binary"))
    able = rows.where("id is not null and label is not null and v is not null")
    classes = reuse(able.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
                    .withColumn("c", F.xxhash64("label", "v")))
    found = components(neighbour_links(classes, min_cosine, bits, neighbours, miss, max_run))
    rooted = reuse(classes.join(found, classes.c == found.node, "left")
                   .select("c", "label", "v", "least", "n", F.coalesce("root", "c").alias("root")))
    linked = rooted.join(found.select("root").distinct(), "root", "left_semi")
    links = count_links(linked, min_cosine)
    # Written before the join, so that adaptive execution can split a hot root.
    least = reuse(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    figures = (rooted.join(least, "root").join(links, "c", "left")
               .select("label", "v", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    own = rows.where("id is null or label is null or v is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = able.join(figures, ["label", "v"]).select("id", "n_links", "component_id").unionByName(own)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
