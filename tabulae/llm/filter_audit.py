"""How a chain of filters shares its work: counts of every filter order, read
off count-weighted decision diagrams."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulae.session import reuse

# Filters of which all orders are walked at most (8! = 40 320 orders a part).
MAX_ALL_ORDERS = 8
# ASCII white space, and the characters of the filters C and D.
SPACES, CAPITALS, SYMBOLS = "\t\n\x0b\x0c\r ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[#$%&*|]"


class Diagram:
    """Decision diagram of failure masks. The nodes of level k test the filter
    ``order[k]``; every path tests all filters, and equal nodes of a level are
    one. A node weighs the counts of all masks below it (the last level's
    children are leaves: the counts of one mask)."""

    def __init__(self, n_filters: int, counts: Mapping[int, Sequence[int]], width: int):
        self.order = list(range(n_filters))
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(n_filters)]
        self.weight: dict[int, tuple[int, ...]] = {}
        self._ids = itertools.count()
        self._leaves: dict[tuple[int, ...], int] = {}
        self._unique: list[dict[tuple[int, int], int]] = [{} for _ in range(n_filters)]
        self.root = self._build(0, {m: tuple(c) for m, c in counts.items()}, (0,) * width)

    def _build(self, level: int, counts: dict[int, tuple[int, ...]], zero: tuple[int, ...]) -> int:
        if level == len(self.order):
            total = tuple(map(sum, zip(*counts.values(), strict=True))) if counts else zero
            if total not in self._leaves:
                self._leaves[total] = next(self._ids)
                self.weight[self._leaves[total]] = total
            return self._leaves[total]
        passed = {m: c for m, c in counts.items() if not m >> level & 1}
        failed = {m: c for m, c in counts.items() if m >> level & 1}
        return self._node(level, self._build(level + 1, passed, zero), self._build(level + 1, failed, zero))

    def _node(self, level: int, passed: int, failed: int) -> int:
        known = self._unique[level]
        if (passed, failed) not in known:
            node = known[passed, failed] = next(self._ids)
            self.levels[level][node] = (passed, failed)
            self.weight[node] = tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed], strict=True))
        return known[passed, failed]

    def swap(self, level: int) -> None:
        """Exchange the filters of two neighbouring levels. Only their nodes
        change: the upper ones keep their place and weight, the lower ones are
        made anew."""
        upper, lower = self.levels[level], self.levels[level + 1]
        for node in lower:
            del self.weight[node]
        self.levels[level + 1], self._unique[level + 1] = {}, {}
        for node, (passed, failed) in upper.items():
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            upper[node] = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
        self._unique[level] = {children: node for node, children in upper.items()}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def reorder(self, order: Sequence[int]) -> None:
        """Bring the filters into ``order`` by swaps of neighbours."""
        for k, x in enumerate(order):
            for level in range(self.order.index(x) - 1, k - 1, -1):
                self.swap(level)

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts that pass it, counts that fail it) at each node of
        the path on which everything passes."""
        node = self.root
        for level, x in enumerate(self.order):
            passed, failed = self.levels[level][node]
            yield x, self.weight[passed], self.weight[failed]
            node = passed


def plain_changes(n: int) -> Iterator[int]:
    """Levels whose swaps, one after the other, visit all n! orders."""
    place, way, at = list(range(n)), [-1] * n, list(range(n))
    while True:
        moving = -1
        for x in range(n - 1, -1, -1):
            to = at[x] + way[x]
            if 0 <= to < n and place[to] < x:
                moving = x
                break
        if moving < 0:
            return
        level = min(at[moving], at[moving] + way[moving])
        a, b = place[level], place[level + 1]
        place[level], place[level + 1], at[a], at[b] = b, a, level + 1, level
        for x in range(moving + 1, n):
            way[x] = -way[x]
        yield level


def _walk(diagram: Diagram, orders: Sequence[Sequence[int]] | None) -> Iterator[None]:
    """The diagram in each of the orders (None: in all)."""
    if orders is None:
        yield
        for level in plain_changes(len(diagram.order)):
            diagram.swap(level)
            yield
    else:
        for order in orders:
            diagram.reorder(order)
            yield


def audit(counts: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), part_col: str = "part",
          orders: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(part_col, filter_order, step, filter, kept, removed, redundant,
    unique_fails, <mark>_lost for each mark, shapley): one row per part, order
    and step.

    ``counts`` holds one row per part and failure mask: (part_col, mask, n and
    one count for each mark), as ``mask_counts`` gives it; bit k of a mask is
    set if ``filters[k]`` fails. ``orders`` are those asked for (null: all, of
    ``MAX_ALL_ORDERS`` filters at most); ``shapley`` is a filter's ``removed``
    summed over them.

    A part's masks are 2^len(filters) rows at most, whatever it holds, so one
    task builds its diagram, brings it from order to order by swaps of
    neighbouring levels, and reads the steps off the path on which everything
    passes. Null parts are a part of their own; no rows give no rows.
    """
    names = list(filters)
    if orders is None and len(names) > MAX_ALL_ORDERS:
        raise ValueError(f"{len(names)} filters have {math.factorial(len(names))} orders; state the orders to audit")
    wanted = None if orders is None else [[names.index(x) for x in order] for order in orders]
    if wanted and any(sorted(order) != list(range(len(names))) for order in wanted):
        raise ValueError("an order holds every filter once")
    counted = ["n", *marks]
    lost = [f"{m}_lost" for m in marks]
    part_type = counts.schema[part_col].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        found = {m: c for m, *c in zip(*(rows.column(x).to_pylist() for x in ["mask", *counted]), strict=True)}
        n = len(names)
        diagram = Diagram(n, found, len(counted))
        failing, unique, removed = [0] * n, [0] * n, [0] * n
        for x in range(n):
            rest = [y for y in range(n) if y != x]
            diagram.reorder([x, *rest])
            failing[x] = next(diagram.steps())[2][0]
            diagram.reorder([*rest, x])
            unique[x] = list(diagram.steps())[-1][2][0]
        out = []
        for _ in _walk(diagram, wanted):
            order = "".join(names[x] for x in diagram.order)
            for k, (x, kept, gone) in enumerate(diagram.steps()):
                removed[x] += gone[0]
                out.append((order, k + 1, x, kept[0], gone[0], failing[x] - gone[0], unique[x], *gone[1:]))
        order, step, x, *numbers = zip(*out, strict=True)
        return pa.table(
            [pa.array([part] * len(out), rows.schema.field("part").type), pa.array(order), pa.array(step, pa.int32()),
             pa.array([names[i] for i in x]), *[pa.array(v, pa.int64()) for v in numbers],
             pa.array([removed[i] for i in x], pa.int64())],
            ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"])

    schema = (f"part {part_type}, filter_order string, step int, filter string, kept long, removed long, redundant long, "
              f"unique_fails long, {''.join(f'{x} long, ' for x in lost)}shapley long")
    return (counts.select(F.col(part_col).alias("part"), "mask", *counted).groupBy("part").applyInArrow(run, schema)
            .withColumnRenamed("part", part_col))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by itself: few words (A), repeated words
    (B), many capitals (C), a symbol (D)."""
    words = words_of(text)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals > 2 * F.length(text), "D": text.rlike(SYMBOLS)}


def document_mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters
    A to E that they fail (bits 0 to 4), and how many of them ``labels`` calls
    good (quality 1) and toxic (toxic 1).

    E fails for a document whose text a smaller doc_id has too, anywhere in
    the table; texts are compared by SHA-256. A null text is empty, a null
    source the empty string; rows with a null doc_id never fail E, make no other
    row fail it, and have no labels; rows that share id and text fail it
    together. Repeated labels of a document count once. Extra columns are
    ignored; empty tables give no rows.

    One small row a document is shuffled (no text). Copies are counted per
    source before they meet, so a text that a third of all rows hold is one row
    per source there.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    rows = seen.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), mask.alias("mask"))
    one = rows.groupBy("doc_id", "key", "part").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    marked = (labels.where("doc_id is not null").groupBy("doc_id")
              .agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(x) for c, x in (("quality", "good"), ("toxic", "toxic"))]))
    # Rows without an id are dealt by their text, or they would all meet in one task.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("key", "part"))
    judged = (one.withColumn("salt", F.coalesce(salt, F.lit(0)))
              .join(marked.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
              .withColumns({x: F.col("n") * F.coalesce(x, F.lit(0)) for x in ("good", "toxic")}))
    counted = ["n", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *counted))).alias("first")
    per = reuse(judged.groupBy("key", "part").agg(
        F.first("mask").alias("mask"), first, *[F.sum(x).alias(x) for x in counted],
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(x)).otherwise(0)).alias(f"{x}_free") for x in counted]))
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    split = per.withColumn("least", least)
    passing = {x: F.col(f"{x}_free") + F.when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{x}")).otherwise(0)
               for x in counted}
    sides = F.array(F.struct(F.col("mask").alias("mask"), *[passing[x].alias(x) for x in counted]),
                    F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(x) - passing[x]).alias(x) for x in counted]))
    return (split.select("part", F.explode_outer(sides).alias("s")).where("s.n > 0")
            .groupBy("part", F.col("s.mask").alias("mask")).agg(*[F.sum(f"s.{x}").alias(x) for x in counted]))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the filters A to E over ``documents``, per source."""
    return audit(document_mask_counts(docs, labels), "ABCDE", ["good", "toxic"])
