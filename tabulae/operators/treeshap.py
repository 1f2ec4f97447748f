"""Exact path-dependent Shapley values of tree ensembles.

A fitted ensemble is saved to the shared checkpoint folder and its node table
(``treeID``, ``nodeData`` with children, split and ``rawCount`` cover) is read
back -- bounded by the model size, not the data -- and turned into a table of
leaf paths: per leaf and per feature on its path the interval (or categories)
that leads there and the share of cover that does. For a row, a leaf with
value v is a game of its path's features alone: feature j multiplies by o_j (1
if the row meets the condition, else 0) when it is known and by the share r_j
when not. The Shapley value of j in that game is

    v (o_j - r_j) * integral over t in [0, 1] of prod_{k != j} (r_k (1 - t) + o_k t),

a polynomial in t of degree below the path's length, which Gauss-Legendre nodes
integrate exactly. The cost is rows x leaves x (path length)^2 / 2, whatever the
number of features. Rows are explained in ``mapInArrow`` batches.

Values of Spark's boosted trees are in log-odds units: the probability is
sigmoid(2 * margin), so sum(phi) + base = logit(p).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Cells (rows x leaves x path slots) that a task computes at once, and values (rows x
# features) that it hands to Spark at once: what a Python worker holds does not grow
# with the table, and stays a few MB beyond the Arrow batch it was given.
MAX_CELLS = 1 << 18
MAX_VALUES = 1 << 16


def tree_tables(spark: SparkSession, gbt_model) -> list[dict]:
    """Per tree: topological node order, children, split feature/threshold or
    left categories, cover and leaf values, plus the tree weight."""
    path = f"{ensure_checkpoint_dir(spark)}/gbt-{uuid.uuid4().hex}"
    gbt_model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.rawCount", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").collect()
    weights = list(gbt_model.treeWeights)
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for tid in sorted(trees):
        nodes = trees[tid]
        child_ids = {n["leftChild"] for n in nodes.values()} | {n["rightChild"] for n in nodes.values()}
        root = next(i for i in nodes if i not in child_ids)
        order, stack = [], [root]
        while stack:
            k = stack.pop()
            order.append(k)
            n = nodes[k]
            if n["leftChild"] >= 0:
                stack += [n["rightChild"], n["leftChild"]]
        out.append({"weight": weights[tid], "order": order, "nodes": {k: (
            n["prediction"], n["leftChild"], n["rightChild"], float(n["rawCount"]), n["featureIndex"],
            list(n["leftCategoriesOrThreshold"] or []), n["numCategories"]) for k, n in nodes.items()}})
    return out


@dataclass
class LeafPaths:
    """One row per leaf, one slot per feature of its path; leaves with shorter
    paths have slots that any row meets (share 1, feature -1)."""

    value: np.ndarray       # leaf value x tree weight
    feature: np.ndarray     # (leaves, slots)
    above: np.ndarray       # the row's value is above this ...
    upto: np.ndarray        # ... and at most this
    share: np.ndarray       # cover share of the slot's conditions
    categories: list[tuple[int, int, frozenset]]  # (leaf, slot, categories that lead there)


def leaf_paths(trees: Sequence[dict]) -> LeafPaths:
    """Leaf paths of ``tree_tables``: conditions on one feature are merged."""
    leaves: list[tuple[float, dict]] = []
    for tree in trees:
        nodes = tree["nodes"]
        stack = [(tree["order"][0], {})]
        while stack:
            k, path = stack.pop()
            value, left, right, _, feature, split, n_categories = nodes[k]
            if left < 0:
                leaves.append((tree["weight"] * value, path))
                continue
            cover = [nodes[left][3], nodes[right][3]]
            total = sum(cover) or 1.0
            for child, part, goes_left in ((left, cover[0], True), (right, cover[1], False)):
                above, upto, share, allowed = path.get(feature, (-np.inf, np.inf, 1.0, None))
                share *= part / total
                if n_categories >= 0:
                    here = frozenset(split) if goes_left else frozenset(map(float, range(n_categories))) - frozenset(split)
                    allowed = here if allowed is None else allowed & here
                elif goes_left:
                    upto = min(upto, split[0])
                else:
                    above = max(above, split[0])
                stack.append((child, {**path, feature: (above, upto, share, allowed)}))
    slots = max([1, *[len(p) for _, p in leaves]])
    shape = (len(leaves), slots)
    out = LeafPaths(np.array([v for v, _ in leaves]), np.full(shape, -1), np.full(shape, -np.inf), np.full(shape, np.inf),
                    np.ones(shape), [])
    for i, (_, path) in enumerate(leaves):
        for j, (feature, (above, upto, share, allowed)) in enumerate(path.items()):
            out.feature[i, j], out.above[i, j], out.upto[i, j], out.share[i, j] = feature, above, upto, share
            if allowed is not None:
                out.categories.append((i, j, allowed))
    return out


def explain_batch(paths: LeafPaths, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(phi per row and feature, base, margin per row). A missing value goes
    right at every split, as the model sends it."""
    n, d = x.shape
    leaves, slots = paths.feature.shape
    nodes, weights = np.polynomial.legendre.leggauss((slots + 1) // 2)
    nodes, weights = (nodes + 1) / 2, weights / 2
    used = paths.feature >= 0
    base = float((paths.value * paths.share.prod(axis=1)).sum())
    phi, margin = np.zeros((n, d)), np.zeros(n)
    # Slots of one feature, for the sums over leaves.
    order = np.argsort(paths.feature[used], kind="stable")
    features, first = np.unique(paths.feature[used][order], return_index=True)
    step = max(1, MAX_CELLS // max(1, leaves * slots))
    allowed_at: dict[int, list] = {}
    for i, j, allowed in paths.categories:
        allowed_at.setdefault(j, []).append((i, list(allowed)))
    share = paths.share.T[:, None, :]
    for lo in range(0, n, step):
        part = x[lo:lo + step]
        o = np.empty((slots, len(part), leaves))
        for j in range(slots):
            v = part[:, np.maximum(paths.feature[:, j], 0)]
            met = ~(v <= paths.above[:, j]) & ((v <= paths.upto[:, j]) | (paths.upto[:, j] == np.inf))
            for i, allowed in allowed_at.get(j, ()):
                met[:, i] = np.isin(v[:, i], allowed)
            o[j] = met | ~used[:, j]
        margin[lo:lo + step] = o.prod(axis=0) @ paths.value
        rest = np.zeros_like(o)
        a, others = np.empty_like(o), np.empty_like(o)
        for t, w in zip(nodes, weights, strict=True):
            np.multiply(o, t, out=a)
            a += share * (1 - t)
            before, after = np.full(o.shape[1:], w), np.ones(o.shape[1:])
            for j in range(slots):
                others[j] = before
                before *= a[j]
            for j in reversed(range(slots)):
                others[j] *= after
                after *= a[j]
            rest += others
        rest *= o - share
        rest *= paths.value
        # Leaf by leaf, slot by slot, as ``order`` counts them.
        per = rest.transpose(1, 2, 0)[:, used][:, order]
        if len(features):
            phi[lo:lo + step, features] = np.add.reduceat(per, first, axis=1)
    return phi, base, margin


def explain_trees(df: DataFrame, trees: Sequence[dict], features: Sequence[str], key_cols: Sequence[str],
                  scale: float = 1.0) -> DataFrame:
    """Long (keys, feature, phi, base, fx) of an ensemble given as
    ``tree_tables``, for any number of features; all values times ``scale``.
    No shuffle; what is broadcast is the model's leaf table."""
    d, feats, keys = len(features), list(features), list(key_cols)
    shared = df.sparkSession.sparkContext.broadcast(leaf_paths(trees))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "feature string, phi double, base double, fx double"])

    at_once = max(1, MAX_VALUES // max(1, d))

    def explain(batches):
        for part in (batch.slice(lo, at_once) for batch in batches for lo in range(0, batch.num_rows, at_once)):
            n = part.num_rows
            x = np.column_stack([part.column(f).to_numpy(zero_copy_only=False) for f in feats])
            phi, base, margin = explain_batch(shared.value, x)
            rows = pa.array(np.repeat(np.arange(n), d))
            names = pa.array(feats, pa.string()).take(pa.array(np.tile(np.arange(d), n)))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k).take(rows) for k in keys], names, pa.array(scale * phi.reshape(-1)),
                 pa.array(np.full(n * d, scale * base)), pa.array(np.repeat(scale * margin, d))],
                names=[*keys, "feature", "phi", "base", "fx"])

    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in feats]).mapInArrow(explain, schema)


def stump(feature: int, threshold: float, left: float, right: float, n_left: float, n_right: float) -> dict:
    """A tree of one split, in the form of ``tree_tables``."""
    return {"weight": 1.0, "order": [0, 1, 2],
            "nodes": {0: (0.0, 1, 2, n_left + n_right, feature, [threshold], -1), 1: (left, -1, -1, n_left, -1, [], -1),
                      2: (right, -1, -1, n_right, -1, [], -1)}}


def tree_shap(pipeline_model, df: DataFrame, features: Sequence[str], key_cols: Sequence[str]) -> DataFrame:
    """Long (keys, feature, phi, base, fx) in log-odds units for a binary
    GBT pipeline (assembler + GBTClassificationModel)."""
    trees = tree_tables(df.sparkSession, pipeline_model.stages[-1])
    return explain_trees(df, trees, features, key_cols, scale=2.0)
