"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio (native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import drawn, words
from cuewise.llm.registry import query, table
from cuewise.operators.barrier import once

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _count(text: Column, characters: str) -> Column:
    """Occurrences of some one-byte characters."""
    return sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in characters).cast("long")


def _item(values: Column, i: Column) -> Column:
    return F.get(values, i)


def _repeat_words(wins: Column) -> Column:
    """Words under three-word windows (given as hashes) that occur twice or more. Windows are sorted
    with their places only if any two are equal."""
    pairs = F.array_sort(F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    same = lambda s, i, d: F.coalesce(_item(s, i + d)["w"] == _item(s, i)["w"], F.lit(False))
    # the sorted pairs are bound to a name once, through a one-element array
    places = F.flatten(F.transform(F.array(pairs), lambda s: F.array_sort(F.transform(
        F.filter(s, lambda x, i: F.when(i > 0, same(s, i, -1)).otherwise(F.lit(False)) | same(s, i, 1)), lambda x: x["i"]))))
    covered = F.flatten(F.transform(F.array(places), lambda p: F.transform(
        p, lambda x, i: F.least(F.lit(3), F.coalesce(_item(p, i + 1) - x, F.lit(3))))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(total)


def text_counts(docs: DataFrame, text: str = "text", **more: Column) -> DataFrame:
    """`more` columns and `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`, and `grams`: one hash
    per word and one per pair of neighbours. Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(*[c.alias(k) for k, c in more.items()], t.alias("_t"))
    # each step behind a barrier: the next ones use it many times
    a = once(a, _h=F.transform(words(F.col("_t")), lambda w: F.xxhash64(w)))
    n = F.size("_h")
    a = once(a, _b=F.zip_with(F.slice("_h", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("_h", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
    a = once(a, _3=F.zip_with(F.slice("_b", F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice("_h", F.lit(3), F.greatest(n - 2, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(F.translate(x, BLANKS[1:], " " * 5)) != "")
    bound = F.flatten(F.transform(F.array(lines), lambda x: F.array(F.size(x) - F.size(F.array_distinct(x)))))
    return once(
        a,
        n_words=n.cast("long"),
        word_chars=(F.char_length("_t") - _count(F.col("_t"), BLANKS)).cast("long"),
        n_symbols=_count(F.col("_t"), SYMBOLS),
        n_dup_lines=F.when(F.contains("_t", F.lit("\n")), bound[0]).otherwise(0).cast("long"),
        n_repeat_words=_repeat_words(F.col("_3")),
        grams=F.concat("_h", "_b"),
    ).drop("_t", "_h", "_b", "_3")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smooth: float, id_col: str = "doc_id", text: str = "text") -> list[float]:
    """log p(bucket | trusted) - log p(bucket | all documents), one value per hash bucket.

    `trusted` holds ids, few enough to be broadcast (its caller bounds it). Counts cover every n-gram
    of every document and are summed per bucket before they are shuffled; `buckets` values reach the driver.
    """
    flag = F.broadcast(trusted.select(F.col(id_col).alias("_id"), F.lit(1).alias("_trusted")).distinct())
    h = F.transform(words(F.col("_t")), lambda w: F.xxhash64(w))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).join(flag, "_id", "left")
    base = base.select("_trusted", h.alias("_h"))
    n = F.greatest(F.size("_h") - 1, F.lit(0))
    grams = F.concat("_h", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(2), n), lambda x, y: F.xxhash64(x, y)))
    hits = base.select("_trusted", F.explode(grams).alias("_g")).groupBy(F.pmod("_g", F.lit(buckets)).cast("int").alias("k")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("_trusted", F.lit(0))).alias("m"))
    counts = {r["k"]: (r["n"], r["m"]) for r in hits.collect()}
    total, target = (sum(v[i] for v in counts.values()) for i in (0, 1))
    if not target:
        return [0.0] * buckets
    def ratio(n, m):
        # both sides are drawn towards the uniform share by the same number of n-grams a bucket
        return math.log((m + smooth * target / total) / (target + smooth * buckets * target / total)) - math.log((n + smooth) / (total + smooth * buckets))
    return [round(ratio(*counts.get(k, (0, 0))), 3) for k in range(buckets)]


def scored(docs: DataFrame, trusted: DataFrame, *, buckets: int = 1 << 15, smooth: float = 60.0, least: float = -0.06, id_col: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """One row per row of `docs`: `more`, the counts, `base_failed`, `llr` (mean log ratio of the n-grams) and `kept`.

    A text is kept if it doesn't fail the base rules and its mean log-likelihood ratio reaches `least`;
    no draw is involved. Null and empty texts have no words and fail. Equal rows get equal results, rows
    without id too; without trusted documents or words, the ratio is 0. Nothing is shuffled but the
    bucket counts, and no row is held beside another. Extra columns are ignored unless given in `more`.
    """
    table_text = ",".join(map(str, log_ratios(docs, trusted, buckets, smooth, id_col, text)))
    ratios = F.split(F.lit(table_text), ",").cast("array<double>")
    a = text_counts(docs, text, **more)
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get(ratios, F.pmod(g, F.lit(buckets)).cast("int")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    b = once(a, llr=F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(total / F.size("grams"))).drop("grams")
    return b.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= least))


def trusted_ids(labels: DataFrame, most: int = 50_000) -> DataFrame:
    """Ids of documents labelled good, about `most` of them by hash; the bound lets them be broadcast."""
    return drawn(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", most)


@query("op3_quality_rules")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trusted_ids(table(spark, sf_dir, "labels")), doc_id=F.col("doc_id"))
