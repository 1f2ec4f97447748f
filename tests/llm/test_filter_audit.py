"""Filter interaction audit against counting row by row, and odd rows."""
import itertools
import random
import re

import pytest

from tabulae.llm import filter_audit as fa


def brute(rows, names, marks):
    """rows: (part, failed filters, marks); the operator's rows by counting."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations(names):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), k + 1] = (
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                    *[sum(r[2][m] for r in gone) for m in range(marks)])
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def failures(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
           "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
    return {k for k, v in bad.items() if v}


def result(df, extra):
    cols = ["kept", "removed", "redundant", "unique_fails", *extra, "shapley"]
    got = [((r["part"], r["filter_order"], r["step"]), tuple(r[c] for c in cols)) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def test_documents_match_counting(spark):
    rng = random.Random(3)
    def prose(n):
        return " ".join(f"w{rng.randrange(1000)}" for _ in range(n))

    texts = [prose(n) for n in (0, 1, 199, 200, 260, 400)] + [
        "a b\tc " * 100, "X " * 250, prose(300) + " #", "é " + prose(240), "", "\x0b \n", None, prose(30000), "ABC" * 40 + prose(200)]
    rows, ids = [], itertools.count(1)
    for t in texts:
        for _ in range(rng.randint(1, 4)):
            rows.append((next(ids), t, rng.choice(["a", "b", None, ""])))
    rows += [(None, texts[4], "a"), (None, texts[4], "b"), (3, texts[5], "a"), rows[0], rows[0], (500, "one", "only")]
    rows += [(1000 + i, texts[3], "hot") for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(1, 60)] + [(None, 1, 1), (2, 1, 0), (2, 0, 1)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, n long, mask string").repartition(5)
    lab = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, part int")

    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    flat = [(s or "", failures(t or "", d is not None and d > least[t or ""]), (int(d in good), int(d in toxic))) for d, t, s in rows]
    got = result(fa.audit_documents(docs, lab), ["good_lost", "toxic_lost"])
    assert got == brute(flat, "ABCDE", 2)
    assert len(got) == 600 * len({p for p, _, _ in flat})
    assert fa.audit_documents(docs.limit(0), lab).count() == 0
    assert result(fa.audit_documents(docs, lab.limit(0)), ["good_lost"])["only", "ABCDE", 1][:2] == (0, 1)


def test_diagram_after_any_swaps():
    rng = random.Random(1)
    counts = {m: (rng.randrange(4), rng.randrange(3)) for m in range(16) if rng.random() < 0.6}
    d = fa.Diagram(4, counts, 2)
    for _ in range(200):
        d.swap(rng.randrange(3))
        seen = set()
        for x, passed, failed in d.steps():
            ok = {m: c for m, c in counts.items() if not any(m >> y & 1 for y in seen)}
            for side, bit in ((passed, 0), (failed, 1)):
                assert side == tuple(sum(c[i] for m, c in ok.items() if m >> x & 1 == bit) for i in range(2))
            seen.add(x)
        for level in d.levels:  # equal nodes of a level are one
            assert len(set(level.values())) == len(level)
            assert len(level) <= 16
    assert sorted(d.weight) == sorted({*itertools.chain(*d.levels), *d._leaves.values()})


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_plain_changes_visits_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for level in fa.plain_changes(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == len(list(itertools.permutations(range(n))))


def test_stated_orders_and_null_parts(spark):
    counts = spark.createDataFrame([(None, 0, 5), (None, 3, 2), (1, 4, 7), (1, 1 << 8, 1)], "source int, mask long, n long")
    names = list("abcdefghi")
    with pytest.raises(ValueError, match="orders"):
        fa.audit(counts, names, part_col="source")
    with pytest.raises(ValueError, match="once"):
        fa.audit(counts, names, part_col="source", orders=[["a", "b"]])
    rows = fa.audit(counts, names, part_col="source", orders=["abcdefghi", "ihgfedcba"]).collect()
    assert len(rows) == 36
    at = {(r["source"], r["filter_order"], r["filter"]): r for r in rows}
    assert at[None, "abcdefghi", "a"]["removed"] == 2 and at[None, "abcdefghi", "b"]["redundant"] == 2
    assert at[None, "ihgfedcba", "b"]["removed"] == 2 and at[None, "ihgfedcba", "a"]["shapley"] == 2
    assert at[1, "abcdefghi", "i"]["unique_fails"] == 1 and at[1, "ihgfedcba", "i"]["kept"] == 7
