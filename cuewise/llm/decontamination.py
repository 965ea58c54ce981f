"""Benchmark decontamination: positional inverted index, lists intersected from the rarest terms (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import folded_words, saved
from cuewise.llm.registry import query, table

#: Terms of the tests that one pass over the documents looks for; their table is broadcast.
TERMS = 200_000


def windows(items: DataFrame, length: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """`(win, terms, items)`: the distinct windows of `length` consecutive words, with the items they stand in.
    A text of fewer words, but not none, is one window."""
    w = items.select(F.col(item).alias("item"), folded_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    wins = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(length)))).alias("terms"))
    return wins.groupBy("terms").agg(F.collect_set("item").alias("items")).select(F.xxhash64(F.array_join("terms", " ")).alias("win"), "terms", "items")


def postings(docs: DataFrame, terms: DataFrame, doc: list[str]) -> DataFrame:
    """Positional inverted index `(doc..., term, pos)` over the given `(term)` table, whole texts.

    `terms` must be small enough to be broadcast: its callers bound each table by `TERMS` rows.
    """
    one = docs.select(*doc, F.posexplode("w").alias("pos", "term"))
    return one.join(F.broadcast(terms), "term")


def _parts(terms: DataFrame, most: int) -> list[DataFrame]:
    """`terms` in parts of about `most` rows at most, by a hash of the term: a longer test list takes more passes."""
    n = terms.count()
    if n <= most:
        return [terms]
    parts = -(-n * 5 // (most * 4))
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i) for i in range(parts)]


def _all(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for x in rest:
        first = first.union(x)
    return first


def phrase_matches(docs: DataFrame, wins: DataFrame, *, doc: list[str], lists: int = 2, most: int = TERMS) -> DataFrame:
    """Exact occurrences `(doc..., start, win, n)` of the windows in `docs` rows `(doc..., w)`.

    Terms are ranked by how often the documents use them. For the `lists` rarest terms of each window,
    postings less the term's offset are lists of possible starts; a start that all of these lists hold is
    a candidate, and the words that stand there are then compared with the whole window. The words of a
    candidate travel with its rarest term's posting, so no text is shuffled.
    """
    spots = saved(wins.select("win", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term")))
    known = spots.select("term").distinct()
    uses = saved(_all([docs.select(F.explode("w").alias("term")).join(F.broadcast(p), "term").groupBy("term").agg(F.count("*").alias("uses")) for p in _parts(saved(known), most)]))
    order = Window.partitionBy("win").orderBy(F.coalesce("uses", F.lit(0)), "off")
    rare = spots.join(uses, "term", "left").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lists)
    need = F.least("n", F.lit(lists)).alias("need")
    by_term = saved(rare.groupBy("term").agg(F.collect_list(F.struct("win", "off", "n", need, "rank")).alias("spots")))
    found = []
    for part in _parts(by_term, most):
        at = docs.select(*doc, "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(part), "term")
        spot = at.select(*doc, "w", "pos", F.explode("spots").alias("x")).withColumn("start", F.col("pos") - F.col("x.off"))
        fits = spot.where((F.col("start") >= 0) & (F.col("start") + F.col("x.n") <= F.size("w")))
        here = F.when(F.col("x.rank") == 1, F.xxhash64(F.array_join(F.slice("w", F.col("start") + 1, F.col("x.n")), " ")))
        found.append(fits.select(*doc, "start", "x.win", "x.n", "x.need", here.alias("here")))
    hit = _all(found).groupBy(*doc, "start", "win", "n", "need").agg(F.count("*").alias("got"), F.max("here").alias("here"))
    return hit.where((F.col("got") >= F.col("need")) & (F.col("here") == F.col("win"))).select(*doc, "start", "win", "n")


def near_matches(docs: DataFrame, items: DataFrame, *, doc: list[str], within: int = 20, share: float = 0.8, rare: int = 5, item: str = "item_id", text: str = "text", most: int = TERMS) -> DataFrame:
    """Proximity matches `(doc..., item, bin, terms)`: stretches of documents in which at least `share` of an
    item's `rare` rarest terms stand within `within` words, in any order. Stretches are half-overlapping bins
    of twice that many words, so no such stretch is missed."""
    terms = saved(items.select(F.col(item).alias("item"), F.explode(F.array_distinct(folded_words(F.col(text)))).alias("term")))
    uses = saved(_all([docs.select(F.explode("w").alias("term")).join(F.broadcast(p), "term").groupBy("term").agg(F.count("*").alias("uses")) for p in _parts(saved(terms.select("term").distinct()), most)]))
    order = Window.partitionBy("item").orderBy(F.coalesce("uses", F.lit(0)), "term")
    kept = terms.join(uses, "term", "left").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rare)
    kept = kept.withColumn("of", F.count("*").over(Window.partitionBy("item")))
    by_term = saved(kept.groupBy("term").agg(F.collect_list(F.struct("item", "of")).alias("items")))
    spots = _all([postings(docs, p, doc) for p in _parts(by_term, most)]).select(*doc, "pos", "term", F.explode("items").alias("x"))
    bins = spots.select(*doc, "x.item", "x.of", "term", F.explode(F.array(F.floor(F.col("pos") / within), F.floor(F.col("pos") / within) - 1)).alias("bin"))
    return bins.groupBy(*doc, "item", "of", "bin").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") >= F.ceil(F.col("of") * share)).drop("of")


def contaminated(docs: DataFrame, items: DataFrame, *, length: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`(_id, _key)`, id and hash of the text, of the documents that hold a window of an item."""
    base = docs.select(F.col(doc).alias("_id"), F.xxhash64(text).alias("_key"), folded_words(F.col(text)).alias("w"))
    return phrase_matches(base, saved(windows(items, length, item, item_text)), doc=["_id", "_key"]).select("_id", "_key").distinct()


def overlap(docs: DataFrame, items: DataFrame, *, length: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", lists: int = 2, most: int = TERMS) -> DataFrame:
    """Per row of `docs`: its id, `n_words, n_hit, n_items, items_sha256, contaminated`.

    Null texts have no words and no hits; rows with equal id and text get equal results, as do rows
    without id; items without words match nothing. Hit words are counted once however many windows
    cover them. An empty benchmark or table gives no hits or no rows.
    """
    key = ["_id", "_key"]
    base = docs.select(F.col(doc).alias("_id"), F.xxhash64(text).alias("_key"), folded_words(F.col(text)).alias("w"))
    wins = saved(windows(items, length, item, item_text))
    hits = saved(phrase_matches(base, wins, doc=key, lists=lists, most=most))
    end = F.col("start") + F.col("n")
    line = Window.partitionBy(*key).orderBy("start")
    spans = hits.groupBy(*key, "start").agg(F.max(end).alias("end"))
    past = F.coalesce(F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("_past", past).groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_past"))).cast("long").alias("n_hit"))
    named = hits.select(*key, "win").distinct().join(wins.select("win", F.explode("items").alias("item")), "win").groupBy(*key).agg(F.collect_set(F.col("item").cast("string")).alias("_items"))
    both = covered.join(named.withColumnsRenamed({k: k + "2" for k in key}), F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_key").eqNullSafe(F.col("_key2")), "left").select(
        F.col("_id").alias("_i"), F.col("_key").alias("_k"), "n_hit", "_items")
    rows = base.select("_id", "_key", F.size("w").cast("long").alias("n_words"))
    out = rows.join(both, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(doc), "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


_FOLD = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS w FROM documents),
b AS (SELECT item_id, {_FOLD} AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(m, 10) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, win.n FROM dw JOIN win ON dw.p = win.p AND dw.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op7_decontamination", SQL)
def op7(spark, sf_dir):
    return overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
