import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tabulae.llm import simhash
from tabulae.llm.common import table

from ..conftest import SF001


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    v = np.array([f for _, f in fp], np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    members = {}
    for k, (i, _) in enumerate(fp):
        members.setdefault(find(k), []).append(i)
    return sorted((i, f"{f:016x}", min(members[find(k)])) for k, (i, f) in enumerate(fp))


@pytest.mark.parametrize("tile_rows", [1 << 18, 3])
def test_matches_brute_force_on_documents(spark, tile_rows):
    docs = table(spark, SF001, "documents")
    got = sorted(tuple(r)[:3] for r in simhash.near_duplicate_groups(docs, tile_rows=tile_rows).collect())
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_are_joined_and_far_texts_are_not():
    base = np.uint64(0x0F0F0F0F0F0F0F0F)
    chain = np.array([base, base ^ np.uint64(0b1111), base ^ np.uint64(0xFF), ~base], np.uint64)
    i, j = simhash._near(chain, chain, 4)
    root = simhash.local_forest(i, j, 8)
    assert root[2] == root[4 + 0] and root[3] != root[0]


def test_defined_results_for_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n", "z"), (4, "a b", "q"), (4, "a b", "q"), (None, "A  B", "r"),
            (6, "w " * 50_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicate_groups(df).collect()}
    assert simhash.near_duplicate_groups(df).count() == 7
    zero = "0" * 16
    assert got[(1, zero)] == got[(2, zero)] == got[(3, zero)] == 1
    ab = f"{brute_fingerprint('a b'):016x}"
    assert got[(4, ab)] == got[(None, ab)] == 4
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0


def test_pipeline_keeps_one_of_a_group_without_ids(spark):
    words = [f"word{i}" for i in range(400)]
    near = [" ".join(words), " ".join([*words[:-1], "other"])]
    assert (brute_fingerprint(near[0]) ^ brute_fingerprint(near[1])).bit_count() <= simhash.RADIUS
    rows = [(None, near[0]), (None, near[1]), (None, near[1]), (5, "far away text of its own"), (None, "one more text without an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert len(got) == 3 and sum(t in near for _, t in got) == 1
