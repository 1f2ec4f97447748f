import pytest
from pyspark.sql import functions as F

from tabulae.operators import split as S


def _table(spark, n=1000):
    return spark.createDataFrame([(i, int(i % 10 < 3)) for i in range(n)], "id long, label int")


def test_stratified_split_exact_class_counts(spark):
    out = S.stratified_split(_table(spark), "label", ["id"], 0.2, 42)
    c = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert c[(1, "test")] == 60 and c[(0, "test")] == 140
    assert c[(1, "train")] == 240 and c[(0, "train")] == 560


def test_split_partition_invariance(spark):
    df = _table(spark)
    a = {r.id: r.split for r in S.stratified_split(df, "label", ["id"], 0.2, 42).collect()}
    b = {r.id: r.split for r in S.stratified_split(df.repartition(16), "label", ["id"], 0.2, 42).collect()}
    assert a == b


def test_kfold_balanced(spark):
    out = S.stratified_kfold(_table(spark), "label", ["id"], 5, 1)
    sizes = out.groupBy("fold", "label").count().toPandas()
    assert set(sizes["count"]) == {60, 140}


def test_repeated_splits_differ_between_runs(spark):
    out = S.repeated_splits(_table(spark, 200), "label", ["id"], 3, 0.2, 42)
    per_run = out.where("split = 'test'").groupBy("run").agg(F.collect_set("id").alias("ids")).collect()
    sets = [frozenset(r.ids) for r in per_run]
    assert len(sets) == 3 and len(set(sets)) == 3


def test_hash_split_validation(spark):
    df = spark.createDataFrame([(i, "a") for i in range(12)], "k long, s string")
    with pytest.raises(ValueError):
        S.hash_split(df, ["k", "s"], 0.5, validate=True)
    with pytest.raises(ValueError):
        S.hash_split(df, ["missing"], 0.5)


def test_holdout_size(spark):
    out = S.random_holdout(_table(spark, 101), ["id"], 0.2)
    assert out.where("holdout").count() == 20


def test_per_fold_scale_uses_other_folds(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0), (1, 14.0)], "fold int, x double")
    out = sorted((r.fold, r.x) for r in S.per_fold_scale(df, "fold", ["x"]).collect())
    # fold 0 scaled with fold-1 stats (mean 12, std 2); fold 1 with fold-0 stats (mean 2, std 1)
    assert out == [(0, -5.5), (0, -4.5), (1, 8.0), (1, 12.0)]


def test_null_labels_and_groups_keep_every_row(spark):
    rows = [(i, None if i % 10 == 0 else i % 2, None if i % 7 == 0 else "g") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y int, g string")
    from tabulae.operators.split import stratified_split
    assert stratified_split(df, "y", ["id"]).count() == 100
    assert stratified_split(df, "y", ["id"], groups=["g"]).count() == 100


def test_per_fold_scale_with_a_large_offset(spark):
    from tabulae.operators.split import per_fold_scale
    rows = [(i % 3 if i % 5 else None, 1e9 + (i * 7919 % 101) / 101.0) for i in range(300)]
    out = per_fold_scale(spark.createDataFrame(rows, "fold int, x double"), "fold", ["x"]).collect()
    xs = [r.x for r in out]
    assert len(out) == 300
    mean = sum(xs) / len(xs)
    assert abs((sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5 - 1) < 0.02


def _by_rank(rows, wanted):
    """Ids of the first rows of each class in hash order."""
    import hashlib
    from collections import defaultdict
    classes = defaultdict(list)
    for key, label in rows:
        text = f"42:{'None' if key is None else key}"
        classes[label].append((int(hashlib.md5(text.encode()).hexdigest()[:15], 16), key))
    return {k for label, order in classes.items() for _, k in sorted(order)[:wanted(len(order))]}


def test_cuts_equal_positions_and_shuffle_no_full_rows(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(700)]
    df = spark.createDataFrame([(k, y, "wide" * 9) for k, y in rows], "id long, label int, text string")
    out = S.stratified_split(df, "label", ["id"], 0.25, 42)
    got = out.where("split = 'test'").collect()
    assert {r.id for r in got} == _by_rank(rows, lambda n: n // 4) and len(got) == 175
    assert out.columns == ["id", "label", "text", "split"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    held = S.random_holdout(df, ["id"], 0.1).where("holdout").collect()
    assert {r.id for r in held} == _by_rank([(k, 0) for k, _ in rows], lambda n: 70)


def test_cuts_of_small_and_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, label int")
    assert S.stratified_split(empty, "label", ["id"]).count() == 0
    assert S.random_holdout(empty, ["id"], 0.5).count() == 0
    one = spark.createDataFrame([(None, 1)], "id long, label int")
    assert [r.split for r in S.stratified_split(one, "label", ["id"], 0.2).collect()] == ["test"]
    assert [r.holdout for r in S.random_holdout(one, ["id"], 0.5).collect()] == [False]
    twice = spark.createDataFrame([(1, 0)] * 4 + [(2, 0)] * 4, "id long, label int")
    sides = S.stratified_split(twice, "label", ["id"], 0.3).select("id", "split").distinct().collect()
    assert len(sides) == 2  # rows alike are never on both sides
