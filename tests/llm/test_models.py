"""Classifiers, filters, mixing, sharding and decontamination."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.llm import decontaminate, mixing, quality, sharding, toxicity, url_filter
from tabulae.llm.common import in_train, table

from ..conftest import SF01


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, shard string")


ODD = [(1, None, "a", "b"), (2, "", "a", "b"), (2, "", "a", "b"), (None, " \n\t", "a", "b"), (4, "word " * 30_000, "a", "b")]


def _rank_quality(scored, labels, col):
    rows = scored.join(labels, "doc_id").where(~in_train(scored["doc_id"])).select("score", col).collect()
    one, zero = ([r[0] for r in rows if r[1] == y] for y in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])


def test_held_out_ranks(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    good = quality.score_quality(docs, quality.train(docs, labels))
    assert _rank_quality(good, labels, "quality") > 0.9
    bad = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    assert _rank_quality(bad, labels, "toxic") > 0.9


def test_scores_of_odd_rows_and_empty_labels(spark):
    df, none = _docs(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        got = score(df, module.train(df, none)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert score(df.limit(0), module.train(df.limit(0), none)).count() == 0


def test_subwords_reach_unseen_misspellings():
    rng = random.Random(1)

    def text(*extra):
        w = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40)]
        for x in extra:
            w[rng.randrange(40)] = x
        return " ".join(w).encode()
    y = [int(i % 4 == 0) for i in range(2400)]
    texts = [text(*(rng.choices(["stinkerly", "stinkery", "mystinker"], k=2) + ["stinkerous"] if t else [])) for t in y]
    m = toxicity.fit(texts, np.array(y), 0.25)
    cache = toxicity._Cache(m.word, 1000)
    clean = m.scores([text() for _ in range(40)], cache)
    odd = m.scores([text("stinkerist", "stinkerz", "stinkerz") for _ in range(40)], cache)
    assert (odd > 0.5).mean() > 0.9 and (clean < 0.5).mean() > 0.9


def test_rules_follow_the_contract(spark):
    urls = ["http://a.com/x", "http://example.com/en/1", "http://WWW.example.com/en/1", "http://x.www.example.com/en/1",
            "http://b.net/es/1", "http://net/fr/2", "http://com", "http://acom/x", None, "no url", "http://a.org/?q=://b.com/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == [
        "com/", "example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(6)] == ["allow", "block", "allow", "allow", "block", "block"]
    assert all(r.verdict in ("allow", "block") for r in got.values()) and len(got) == len(urls)
    assert (got[8].host, got[8].path, got[9].host, got[2].host) == ("", "", "", "www.example.com")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_gram_scores_match_a_plain_model(spark):
    known = [("ab", True), ("abc", True), ("xb", False), ("xyb", False)]
    df = spark.createDataFrame(known, "url string, accepted boolean")
    order = 2
    asked = spark.createDataFrame([("abx",)], "url string")
    got = {r.gram: r.gain for r in url_filter.gram_scores(df, url_filter._grams(asked, "url", order + 1), order).collect()}

    def prob(texts, gram):
        p = 1 / 256
        for n in range(1, order + 2):
            ctx, ch = gram[len(gram) - n:-1], gram[-1]
            ends = [("\x02" * order + t + "\x03")[i - n + 1:i + 1] for t in texts for i in range(order, order + len(t) + 1)]
            near = [e for e in ends if e[:-1] == ctx]
            if near:
                kinds = len(set(near))
                p = (sum(e[-1] == ch for e in near) + kinds * p) / (len(near) + kinds)
        return p
    for gram, gain in got.items():
        want = np.log(prob([u for u, a in known if a], gram)) - np.log(prob([u for u, a in known if not a], gram))
        assert gain == pytest.approx(want)


def test_no_table_of_urls_or_grams_is_broadcast(spark):
    """Spark refuses any broadcast here, however small the table."""
    urls = [f"http://{h}/{p}/{i}" for i in range(20) for h in ("a.com", "b.net", "example.org") for p in ("en", "es")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        rows = url_filter.filter_urls(df).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    assert all((r.score is None) == (r.rule is not None) and r.verdict in ("allow", "block") for r in rows)


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mixture_meets_its_targets(spark, floor):
    docs = table(spark, SF01, "documents")
    weights = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
    model = mixing.train(docs, table(spark, SF01, "labels"), sorted(weights))
    rows = mixing.mix(docs, model, weights, floor=floor).select("lang", "n_tokens", "posteriors", "rate", "copies").collect()
    r, n, p = np.array([x.rate for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.posteriors for x in rows])
    share = (r * n) @ p / ((r * n) @ p).sum()
    assert r.min() >= floor and np.abs(share - [0.2, 0.4, 0.2, 0.2]).max() < 1e-3
    assert np.mean([sorted(weights)[x.argmax()] == y.lang for x, y in zip(p, rows)]) > 0.95
    assert all(int(x.rate) <= x.copies <= int(x.rate) + 1 for x in rows)


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mixing_reaches_the_least_gap(floor):
    """A domain with 94 % of the rows and soft posteriors: no round stops early."""
    rng = np.random.default_rng(2)
    z = rng.standard_normal((30_000, 4))
    z[np.arange(30_000), rng.choice(4, 30_000, p=[0.94, 0.02, 0.02, 0.02])] += 4
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    n, target = rng.integers(1, 500, 30_000).astype(float), np.array([0.55, 0.15, 0.15, 0.15])
    passes = []

    def figures(price):
        passes.append(price)
        return mixing._figures(n, p, price, floor)

    start = n @ p
    goal = target * (start.sum() if floor == 0 else (start / target).max())
    gram = (p * n[:, None]).T @ p
    price, now = mixing.newton(figures, gram, goal)
    r = mixing.rates(p, price, floor)
    slope = p @ np.linalg.solve(gram, now - goal)  # of each rate's gap
    assert np.allclose((r * n) @ p, now) and len(passes) <= 40 and r.max() < 100
    assert np.allclose(r, np.maximum(floor, 1 - slope / mixing.EPSILONS[-1]), rtol=1e-2)
    assert np.abs(now / now.sum() - target).max() < (1e-6, 1e-3)[int(floor)]


def test_mixing_odd_rows(spark):
    df = _docs(spark, ODD).withColumnRenamed("score", "rate")
    model = mixing.fit([], np.array([], int), ["a", "b"])
    assert mixing.mix(df, model, {"a": 1.0}).count() == len(ODD)
    assert mixing.mix(df.limit(0), model, {"a": 1.0}).count() == 0


def test_leaks_equal_every_passage_against_every_item():
    """Answer words first loses nothing: all passages and items, one by one."""
    rng = random.Random(9)
    voc = [f"w{i}".encode() for i in range(150)]
    items = [rng.choices(voc, k=rng.randint(1, 60)) for _ in range(25)]
    terms = {w: k for k, w in enumerate(sorted({w for x in items for w in x}))}
    idf = np.array([1 + rng.random() for _ in terms])
    space = np.linalg.qr(np.random.default_rng(1).standard_normal((len(terms), 40)))[0]
    index = decontaminate.Index(list(range(25)), items, terms, idf, space)
    texts = [b"", b"!?", b" ".join(voc * 3)]
    for i in range(40):
        x = rng.choices(voc + [b"unknown"], k=rng.randint(0, 120))
        x[5:5] = [w for w in items[i % 25] if rng.random() < 0.8]
        texts.append(b" ".join(x))
    size, want = decontaminate.BLOCK, {}
    for d, t in enumerate(texts):
        w = decontaminate.words_of(t)
        for k, item in enumerate(items):
            n = int(index.blocks[k])
            for s in range(0, len(w), size):
                x = sum((index.space[terms[v]] for v in w[s:s + (n + 1) * size] if v in terms), np.zeros(40, np.float32))
                part = w[max(0, s - size):s + (n + 2) * size]
                common = decontaminate.common_subsequence(item, part) / len(item)
                answer = len(index.answers[k] & set(part)) / len(index.answers[k])
                if (np.linalg.norm(x) and x @ index.items[k] >= decontaminate.MIN_COSINE * np.linalg.norm(x)
                        and common >= decontaminate.MIN_COMMON and answer >= decontaminate.MIN_ANSWER):
                    want[d, k] = max(want.get((d, k), (0, 0)), (common, answer))
    for uses in (decontaminate.MAX_USES, 7):
        held, decontaminate.MAX_USES = decontaminate.MAX_USES, uses
        try:
            assert {(d, k): (c, a) for d, k, c, a in index.matches(texts)} == want
        finally:
            decontaminate.MAX_USES = held
    assert len(want) > 25


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, "copy" * 20, "a", "b") for i in range(150)] + [(i, "t" * (i % 90), "a", "b") for i in range(150, 400)] + ODD[:4]
    got = sharding.shard(_docs(spark, rows), 8).collect()
    assert len(got) == len(rows)
    sizes = np.bincount([r.shard for r in got], [r["size"] for r in got], 8)
    assert sizes.max() - sizes.min() <= 2 * max(r["size"] for r in got)
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.text == "copy" * 20}) <= 6
    assert sharding.shard(_docs(spark, []), 8).count() == 0


def test_paraphrased_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(voc, k=30))) for i in range(12)]
    rows = []
    for i in range(120):
        w = rng.choices(voc, k=200)
        if i < 24:
            leak = items[i % 12][1].split()
            if i >= 12:  # changed, dropped and added words
                leak[3], leak[11], leak[20] = "novel", "other", "words"
                del leak[15]
                leak.insert(8, "more")
            k = rng.randrange(150)
            w[k:k] = leak
        rows.append((i, " ".join(w), "a", "b"))
    rows += ODD
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    got = decontaminate.find_leaks(_docs(spark, rows), bench).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["items"] == ([r.doc_id % 12] if r.doc_id is not None and r.doc_id < 24 and r.n_items else [])
    assert {r.doc_id for r in got if r.contaminated} == set(range(24)) | set()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.find_leaks(_docs(spark, ODD), empty).collect())


def test_longest_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]
    rng = random.Random(0)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


def test_quality_sample_and_scale(spark, monkeypatch):
    """A repeated id takes one place of the sample; centre and scale see all rows."""
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda p, u, prior, center, scale: seen.update(u=u, center=center))
    rows = [(i, "word " * (i + 1), "a", "b") for i in range(40)] * 3
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    quality.train(_docs(spark, rows), labels, max_unlabelled=20)
    assert len({u.tobytes() for u in seen["u"]}) > 15
    ids = [r.doc_id for r in _docs(spark, rows).where(in_train(F.col("doc_id"))).collect()]
    full = quality.features([b"word " * (i + 1) for i in ids]).mean(axis=0)
    assert np.allclose(seen["center"], full, atol=1e-5)


def test_matches_are_all_that_the_cosine_and_both_checks_accept():
    """A passage whose other words point away from the item: a small projection,
    but the cosine and both checks accept it."""
    item = [f"w{i}".encode() for i in range(10)]
    terms = {w: k for k, w in enumerate(item)}
    space = np.zeros((10, 2))
    space[:, 0] = 1.0
    space[6:, 0] = 12.0  # w6 to w9 are not in the passage
    index = decontaminate.Index([7], [item], terms, np.ones(10), space)
    index.answers = [set(item[:2])]
    found = list(index.matches([b" ".join(item[:6])]))
    assert found == [(0, 0, 0.6, 1.0)]


def test_rank_grows_with_the_items():
    assert decontaminate.space_rank(200, 3000) == decontaminate.RANK
    assert decontaminate.space_rank(5000, 30_000) > 4 * decontaminate.RANK
    assert decontaminate.space_rank(100_000, 1 << 17) * (1 << 17) <= decontaminate.MAX_SPACE


def test_fits_take_one_row_of_a_repeated_id(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda p, u, *rest: seen.update(p=len(p), u=len(u)))
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, prior: seen.update(texts=texts))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:20]
    docs = _docs(spark, [(i, f"b {i}", "a", "b") for i in ids] + [(ids[0], f"a {k}", "a", "b") for k in range(500)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    quality.train(docs, labels)
    toxicity.train(docs, labels)
    assert (seen["p"], seen["u"], len(seen["texts"])) == (20, 20, 20)
    assert b"a 0" in seen["texts"]
