"""Substring, line and vector dedup against brute force, and odd rows."""
import collections
import random

import numpy as np
import pytest

from tabulae.llm import bloom, embed_dedup, line_dedup, recompress

WINDOW = 35


def brute_repeats(rows):
    words = [(t or "").encode().split() for _, t in rows]
    n = collections.Counter(tuple(w[i:i + WINDOW]) for w in words for i in range(len(w) - WINDOW + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - WINDOW + 1):
            if n[tuple(w[i:i + WINDOW])] > 1:
                gone[i:i + WINDOW] = True
        out.append((d, " ".join(x.decode() for x, g in zip(w, gone) if not g), len(w), int(gone.sum())))
    return sorted(out)


@pytest.mark.parametrize("letters", [1, 3, 500])
def test_repeats_match_brute_force(spark, letters):
    rng = random.Random(letters)
    voc = [f"w{i}" for i in range(letters)]
    base = [rng.choice(voc) for _ in range(300)]
    rows = []
    for i in range(40):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 80))]
        k, s = rng.randint(0, len(w)), rng.randint(0, 250)
        w[k:k] = base[s:s + rng.choice([34, 35, 36, 45])]
        rows.append((i, " ".join(w + ["x", "y"] * (20 if i % 7 == 0 else 0))))
    rows += [(5, rows[5][1]), (90, None), (91, ""), (92, "one\ttwo\x0bthree"), (93, "z " * 5000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, row string").repartition(3)
    assert sorted(tuple(r) for r in recompress.remove_repeats(df).collect()) == brute_repeats(rows)
    assert recompress.remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_hold_an_equal_anchor():
    rng = random.Random(2)
    for _ in range(200):
        voc = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 20]))]
        shared = [rng.choice(voc) for _ in range(WINDOW)]
        texts = [b" ".join([rng.choice(voc) for _ in range(rng.randint(0, 30))] + shared + [rng.choice(voc) for _ in range(20)])
                 for _ in range(2)]
        runs = [recompress.Run([t], recompress.TokenNames(), WINDOW) for t in texts]
        assert set(runs[0].name.tolist()) & set(runs[1].name.tolist())


def test_words_are_cut_and_named_by_their_bytes():
    """The words of ``bytes.split``, without a Python object for each; one name for each word."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc \t\n\x0b\x0c\r\x1c\x85\x00\xff") for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(60)]
    texts += [b"x" * n + b" " + b"x" * (n - 1) + b"\x00" for n in (7, 8, 9, 16, 255, 256, 257, 5000)]
    names, seen = recompress.TokenNames(), {}
    for i in range(0, len(texts), 4):
        data = names.data(texts[i:i + 4])
        n, start, stop = names.bounds(data, texts[i:i + 4])
        words = [t.split() for t in texts[i:i + 4]]
        assert n.tolist() == [len(w) for w in words]
        assert [data[a:b] for a, b in zip(start, stop)] == sum(words, [])
        for word, name in zip(sum(words, []), names.names(data, start, stop).tolist()):
            assert seen.setdefault(word, name) == name
    assert len(set(seen.values())) == len(seen) > 100


def test_lines_and_odd_rows(spark):
    long = "A line of some forty characters, or a few more than that"
    rows = [(i, f"{long}\nown {i}") for i in range(1, 6)] + [(6, f"  {long.upper()}\t\n{long}\nx"), (7, None), (8, ""), (None, long)]
    rows.append((1, f"{long}\nown 1"))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int")
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(df).collect()), key=str)
    want = [(i, f"own {i}", 2, 1) for i in (1, 1, 2, 3, 4, 5)]
    want += [(6, rows[5][1], 3, 0), (7, "", 1, 0), (8, "", 1, 0), (None, long, 1, 0)]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_short_and_rare_lines_stay(spark):
    rows = [(i, "short line\n" + "é" * 39 + "\n" + "rare line " * 5) for i in range(4)]
    rows += [(i, "short line\n" + "é" * 39) for i in range(4, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.count() and all(r.n_dropped == 0 for r in line_dedup.dedup_lines(df).collect())


def test_filters_never_lose_a_repeat(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) as k").repartition(4)
    both = keys.unionByName(keys.where("k % 3 = 0"))
    bits = bloom.filter_bits(3000)

    def of(batches):
        for b in batches:
            yield b.column(0).to_numpy().view(np.uint64)
    seen = np.frombuffer(bloom.twice_seen(both, of, bits), np.uint8)
    k = np.array([r.k for r in keys.collect()], np.int64)
    hit = bloom.contains(seen, bits, k.view(np.uint64))
    assert hit[k % 3 == 0].all() and hit.mean() < 0.5


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 16))
    rows = []
    for i in range(240):
        v = base[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.3])
        rows.append((i, [float(x) for x in v], i % 3 if i % 50 else None))
    rows += [(300, rows[1][1], 1), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [1.0, None], 1),
             (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (None, rows[1][1], 1), (307, [], 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicate_vectors(df).collect()}
    ok = [(i, np.array(v), lab) for i, v, lab in rows
          if None not in (i, v, lab) and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.defaultdict(set)
    for i, v, a in ok:
        for j, w, b in ok:
            if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
    assert len(got) == len(rows)
    found = sum(got[i][0] for i, _, _ in rows if i is not None)
    assert 0.9 * sum(map(len, links.values())) <= found <= sum(map(len, links.values()))
    for i, (n, comp, kept) in got.items():
        assert n <= len(links[i]) and kept == (comp == i)
        assert comp == i or n > 0
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_plan_follows_count_and_spread():
    assert embed_dedup.plan(2000, 0.0) == (1, 0)  # one run: every pair
    sizes = [embed_dedup.plan(10 ** k, 0.0) for k in (4, 5, 6, 7)]
    assert sizes == sorted(sizes) and sizes[-1][0] > 2 * 24
    assert embed_dedup.plan(10 ** 6, 0.8)[0] > embed_dedup.plan(10 ** 6, 0.0)[0]


@pytest.mark.parametrize("max_run", [embed_dedup.MAX_RUN, 600])
def test_off_centre_pairs_of_a_large_label_are_found(spark, max_run):
    """Isolated pairs in one label whose vectors lie far off centre, against
    brute force for the ids divisible by 50."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12_000, 64)) / 8
    x[:, 0] += 1.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[::50].copy()
    away = rng.standard_normal(y.shape)
    away -= (away * y).sum(axis=1, keepdims=True) * y
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x = np.concatenate([x, 0.935 * y + (1 - 0.935 ** 2) ** 0.5 * away])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicate_vectors(df, max_run=max_run).where("vec_id % 50 = 0").collect()}
    asked = np.arange(0, len(x), 50)
    true = (x[asked] @ x.T >= 0.93).sum(axis=1) - 1
    assert sum(got.values()) >= 0.995 * true.sum() and true.sum() >= 240
