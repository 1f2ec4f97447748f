"""URL filter: rules first, then a ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulae.session import reuse

# (verdict, host, path) of the rules; a rule's string is host + path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 5
SALTS = 16
CALIBRATION_BINS = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_by_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null where no rule fits), from
    columns ``host`` and ``path``. Rules are few and given: one literal each."""
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _merged(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join by sorting. The tables joined here grow with the input and
    shrink much when compressed, so Spark would take some for small and gather
    them on the driver to broadcast them."""
    return left.join(right.hint("merge"), on)


def _grams(df: DataFrame, text: str, size: int, *keep: str) -> DataFrame:
    """One row per character of ``text``: the ``size`` characters that end with
    it; the text is framed by start signs and an end sign."""
    framed = F.concat(F.lit("\x02" * (size - 1)), F.col(text), F.lit("\x03"))
    ends = F.sequence(F.lit(1), F.char_length(F.col(text)) + 1)
    return (df.select(*keep, framed.alias("__t"), F.explode(ends).alias("__i"))
            .select(*keep, F.substring(F.col("__t"), F.col("__i"), F.lit(size)).alias("gram")))


def gram_scores(known: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, gain): log P(last | others before it) under the accepted model,
    less that under the rejected one, for the distinct grams of ``wanted``.

    ``known`` has columns ``url`` and ``accepted``. Both models back off from
    ``order`` characters of context to none by Witten-Bell weights: a context
    seen n times with t different followers leaves t / (n + t) to the next
    shorter one, and the last falls back to a uniform byte."""
    size = order + 1
    full = (_grams(known, "url", size, "accepted").groupBy("gram")
            .agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")))
    full = reuse(full)
    asked = reuse(wanted.select("gram").distinct())
    none = F.lit(0).cast("long")
    for n in range(1, size + 1):  # the chain of joins is as long as the order
        tail = F.substring("gram", size - n + 1, n).alias("g")
        rows = (full.select(tail, "a", "r", F.lit(False).alias("asked"))
                .unionByName(asked.select(tail, none.alias("a"), none.alias("r"), F.lit(True).alias("asked")))
                .groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.max("asked").alias("asked")))
        context = Window.partitionBy(F.substring("g", 1, n - 1))  # as many rows as characters follow it
        rows = rows.withColumns({f"n{x}": F.sum(x).over(context) for x in "ar"}
                                | {f"t{x}": F.count(F.when(F.col(x) > 0, 1)).over(context) for x in "ar"}).where("asked")
        if n == 1:
            rows = rows.withColumns({"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)})
        else:  # a shorter gram ends as many longer ones as characters come before it
            rows = _merged(rows.withColumn("s", F.substring("g", 2, n - 1)), out.withColumnRenamed("g", "s"), "s")
        for x in "ar":
            mixed = (F.col(x) + F.col(f"t{x}") * F.col(f"p{x}")) / F.nullif(F.col(f"n{x}") + F.col(f"t{x}"), F.lit(0))
            rows = rows.withColumn(f"p{x}", F.coalesce(mixed, F.col(f"p{x}")))
        out = rows.select("g", "pa", "pr")
        if n % 2 == 0:
            out = reuse(out)
    return out.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("gain"))


def url_scores(urls: DataFrame, gains: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score): mean gain per character of each distinct ``url``. Grams
    that many URLs share are salted, so no task gets all rows of one."""
    salted = gains.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = _grams(urls.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")), "url", order + 1, "url", "salt")
    return _merged(rows, salted, ["gram", "salt"]).groupBy("url").agg(F.avg("gain").alias("score"))


def threshold(scored: DataFrame) -> float:
    """The cut that separates accepted from rejected URLs best (mean of both
    classes' hit rates) on the rows of (score, accepted), counted in
    ``CALIBRATION_BINS`` bins; 0 without rows of both classes."""
    lo, hi = scored.agg(F.min("score"), F.max("score")).first()
    if lo is None or lo == hi:
        return 0.0
    width = (hi - lo) / CALIBRATION_BINS
    bins = (scored.groupBy(F.floor((F.col("score") - lo) / width).alias("b"))
            .agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
            .orderBy("b").collect())
    all_a, all_r = sum(r["a"] for r in bins), sum(r["r"] for r in bins)
    if not all_a or not all_r:
        return 0.0
    best, cut, below_a, below_r, end = -1.0, 0.0, 0, 0, lo
    for r in bins:
        start = lo + r["b"] * width
        if (fair := (1 - below_a / all_a) + below_r / all_r) > best:
            best, cut = fair, (start + end) / 2  # amid the gap to the bin before
        below_a, below_r, end = below_a + r["a"], below_r + r["r"], start + width
    return cut


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """(id_col, host, path, rule, verdict, score), one row per input row.

    URLs that a rule fits get its verdict, and they are the models' examples:
    the allowed ones accepted, the blocked ones rejected. The others are judged
    by the mean log-likelihood ratio per character of host + path under the two
    models. The cut is calibrated on a fifth of the rule-judged texts (by hash)
    that models of the other four fifths have not seen; the models that judge
    count all of them.

    Null URLs and those without ``://`` have empty host and path; an empty host
    + path is judged by its end sign alone. ``score`` is null where a rule
    decides. Repeated rows and null ids pass through; extra columns are
    ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    pages = reuse(judge_by_rules(pages, rules).withColumn("url", F.concat("host", "path")))
    known = pages.where("rule is not null").select("url", (F.col("rule_verdict") == "allow").alias("accepted")).distinct()
    fold = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(5)) == 0
    test = known.where(fold)
    asked = pages.where("rule is null").select("url").distinct()
    held = gram_scores(known.where(~fold), _grams(test, "url", order + 1), order)
    cut = threshold(_merged(url_scores(test.select("url"), held, order), test, "url"))
    gains = gram_scores(known, _grams(asked, "url", order + 1), order)
    scores = reuse(url_scores(asked, gains, order))
    verdict = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    judged = _merged(pages.where("rule is null"), scores, "url").withColumn("verdict", verdict)
    ruled = pages.where("rule is not null").withColumns({"score": F.lit(None).cast("double"), "verdict": F.col("rule_verdict")})
    columns = [F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score"]
    return judged.select(*columns).unionByName(ruled.select(*columns))
