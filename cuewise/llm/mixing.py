"""Mixing sources to target weights: blocks of words, drawn slots, pseudorandom index permutations (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import saved, words
from cuewise.llm.registry import query, table

#: Steps of the index permutation, and documents or slots that one row is opened into at most.
STEPS, PART = 24, 20_000


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """A pseudorandom bijection of 0..n-1 for any n: at each step an index and its mirror image at a
    pivot change places or not, by one bit that both share."""

    def step(at: Column, k: Column) -> Column:
        other = F.pmod((seed % 1000003) * 7919 + k * 104729 * (seed % 997 + 1) - at, n)
        top = F.greatest(at, other)
        bit = ((top % 1000003) * 7919 + F.floor(top / 1000003) * 31337 + k * 15485863 + seed * 613) % 65521 % 2
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(STEPS).cast("long")), x.cast("long"), step)


def sized(docs: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`(src, doc, size)`. Rows of one source that repeat an id are one document of their summed size."""
    one = docs.select(F.col(source).cast("string").alias("src"), F.col(doc).alias("doc"), F.size(words(F.col(text))).cast("long").alias("size"))
    return one.groupBy("src", "doc").agg(F.sum("size").alias("size"), F.count("*").alias("copies"))


def targets(docs: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source of `sized` rows: `src, s` (rank by code point, null last), `source_size, docs, target`.

    Weights repeat over the ranks. Sources whose share would exceed `most` times their size stop there and
    the rest is reshared: with sources in the order of `most * size / weight`, the first k stop, for the
    least k at which no further source is above. Windows run over one row per source.
    """
    by = docs.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = by.withColumn("s", (F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1).cast("long"))
    w = F.get(F.array(*[F.lit(int(x)) for x in weights]), F.pmod("s", F.lit(len(weights))).cast("int")).cast("long")
    one = ranked.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "s")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = one.withColumn("level", level).withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    stop = F.first("fits", ignorenulls=True).over(everything)
    return levels.select("src", "s", "source_size", "docs", F.least(F.col("cap").cast("double"), stop * F.col("w")).alias("target"))


def pieces(docs: DataFrame, goal: DataFrame, block: int) -> DataFrame:
    """`(s, block, doc, skip, n)`: the words of each document in each fixed-length block of its source.

    A source is the chain of its documents in the order of a hash. Running sums go over parts of about
    `PART` documents, and over the parts' sums, so a large source is never one window.
    """
    of = docs.join(goal.select(F.col("src").alias("_src"), "s", "docs"), F.col("src").eqNullSafe(F.col("_src"))).where("size > 0")
    key = F.md5(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary"))
    of = of.select("s", "doc", "size", key.alias("key"), F.conv(F.substring(key, 1, 7), 16, 10).cast("long").alias("h"), F.ceil(F.col("docs") / PART).cast("long").alias("parts"))
    of = of.withColumn("part", F.floor(F.col("h") * F.col("parts") / (1 << 28)).cast("long"))
    sums = of.groupBy("s", "part").agg(F.sum("size").alias("_n"))
    sums = sums.select("s", "part", (F.sum("_n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("s", "part").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    of = of.withColumn("inner", inner).join(sums, ["s", "part"]).withColumn("at", F.col("base") + F.col("inner"))
    end = F.col("at") + F.col("size")
    cut = of.select("s", "doc", "at", end.alias("end"), F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("block"))
    first = F.greatest("at", F.col("block") * block)
    return cut.select("s", "block", "doc", (first - F.col("block") * block).alias("skip"), (F.least("end", (F.col("block") + 1) * block) - first).alias("n"), (first - F.col("at")).alias("start"))


def slots(goal: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """One row per output slot: `shard, place, s, block, words`.

    A source gives `round(target)` words: its whole chain some times over, then the first blocks of one
    more permutation, the last of them cut. The slots of all sources are one pool; a permutation deals the
    pool over the shards, so the source counts of a shard are a multinomial draw without replacement, and
    the totals are met exactly.
    """
    need = F.round("target").cast("long")
    g = goal.where("source_size > 0").select("s", F.col("source_size").alias("size"), need.alias("need"), F.ceil(F.col("source_size") / block).cast("long").alias("blocks"))
    g = g.withColumn("turns", F.floor(F.col("need") / F.col("size"))).withColumn("rest", F.col("need") % F.col("size"))
    g = g.withColumn("slots", F.col("turns") * F.col("blocks") + F.ceil(F.col("rest") / block))
    before = F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots")
    g = g.withColumn("before", before).withColumn("pool", F.sum("slots").over(Window.partitionBy(F.lit(1))))
    part = g.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / PART))).alias("part"))
    # few small rows that each open into many: a stated number of tasks, which is not merged by size
    part = part.repartition(int(goal.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s", "part")
    one = part.select("*", F.explode(F.sequence(F.col("part") * PART, F.least((F.col("part") + 1) * PART, "slots") - 1)).alias("r"))
    turn, i, full = F.floor(F.col("r") / F.col("blocks")), F.col("r") % F.col("blocks"), F.floor(F.col("size") / block)
    one = one.select("*", permuted(F.col("before") + F.col("r"), F.col("pool"), F.lit(seed).cast("long")).alias("j"), turn.alias("turn"), i.alias("i"), full.alias("full"))
    # whole blocks are permuted; a short last block stays last, so the cut falls where it should
    index = F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.greatest("full", F.lit(1).cast("long")), F.col("s") * 131 + F.col("turn") * 17 + seed)).otherwise(F.col("i"))
    given = F.when(F.col("turn") == F.col("turns"), F.least(F.lit(block).cast("long"), F.col("rest") - F.col("i") * block)).otherwise(F.lit(block).cast("long"))
    return one.select(F.floor(F.col("j") / shard).alias("shard"), (F.col("j") % shard).alias("place"), "s", index.alias("block"), given.alias("words"))


def mixture(docs: DataFrame, goal: DataFrame, *, block: int = 256, shard: int = 1024, seed: int = 7) -> DataFrame:
    """The mix: per slot, the stretches of documents in its block: `shard, place, s, block, doc, start, words`."""
    # both sides grow with the words; the planner can't see that from the one row per source the slots come from
    hit = slots(goal, block, shard, seed).hint("merge").join(pieces(docs, goal, block), ["s", "block"])
    n = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("words") - F.col("skip")))
    return hit.select("shard", "place", "s", "block", "doc", "start", n.alias("words")).where("words > 0")


def taken(docs: DataFrame, *, weights: tuple = (5, 2, 1), most: int = 3, doc: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """Per document `(doc, source, size, source_size, target, taken)`.

    Null texts and texts without words have size 0 and give nothing; a null source is a source of its own,
    the last; a null id is one document per source, and rows of one source that repeat an id are one
    document. No document gives more than `most` times its size. Empty tables give no rows.
    """
    rows = saved(sized(docs, doc, source, text))
    goal = saved(targets(rows, weights, most))
    use = mixture(rows, goal, **how).select("s", "doc", F.col("words").alias("taken"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("own"))
    named = rows.join(goal.select(F.col("src").alias("_src"), "s"), F.col("src").eqNullSafe(F.col("_src"))).select("s", "doc", F.lit(0).cast("long").alias("taken"), "size", F.lit(1).alias("own"))
    both = use.union(named.select(use.columns)).groupBy("s", "doc").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    return both.join(goal, "s").select(F.col("doc"), F.col("src").alias("source"), "size", "source_size", "target", "taken")


def _perm_sql(x: str, n: str, seed: str) -> str:
    other = f"((((({seed}) % 1000003) * 7919 + k * 104729 * (({seed}) % 997 + 1) - y) % ({n}) + ({n})) % ({n}))"
    top = f"greatest(y, {other})"
    bit = f"((({top} % 1000003) * 7919 + ({top} // 1000003) * 31337 + k * 15485863 + ({seed}) * 613) % 65521 % 2)"
    return f"list_reduce(list_concat([({x})::BIGINT], range(1, {STEPS + 1})), lambda y, k: CASE WHEN {bit} = 1 THEN {other} ELSE y END)"


SQL = f"""
WITH sz AS (
  SELECT source AS src, doc_id AS doc, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')))::BIGINT AS size
  FROM documents GROUP BY 1, 2),
src AS (
  SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS s FROM sz GROUP BY src),
w AS (SELECT *, CASE s % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM src),
lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
g AS (
  SELECT src, s, source_size, least(cap::DOUBLE, (SELECT arg_min(level, (cap / w, s)) FROM lv WHERE level * w <= cap) * w) AS target FROM lv),
n AS (
  SELECT *, (source_size + 255) // 256 AS blocks, round(target)::BIGINT // source_size AS turns, round(target)::BIGINT % source_size AS rest FROM g WHERE source_size > 0),
n2 AS (SELECT *, turns * blocks + (rest + 255) // 256 AS slots FROM n),
one AS (SELECT *, unnest(range(0, slots)) AS r FROM n2),
two AS (SELECT *, r // blocks AS turn, r % blocks AS i, source_size // 256 AS full_ FROM one),
slot AS (
  SELECT s, CASE WHEN i < full_ THEN {_perm_sql("i", "greatest(full_, 1)", "s * 131 + turn * 17 + 7")} ELSE i END AS block,
         CASE WHEN turn = turns THEN least(256, rest - i * 256) ELSE 256 END AS words FROM two),
pos AS (
  SELECT s, doc, size, sum(size) OVER (PARTITION BY s ORDER BY md5(coalesce(doc::VARCHAR, '')), doc ROWS UNBOUNDED PRECEDING)::BIGINT - size AS p
  FROM sz JOIN src ON sz.src IS NOT DISTINCT FROM src.src WHERE size > 0),
pc AS (SELECT s, doc, p, p + size AS fin, unnest(range(p // 256, (p + size - 1) // 256 + 1)) AS block FROM pos),
used AS (
  SELECT s, doc, sum(greatest(0, least(least(fin, (block + 1) * 256) - greatest(p, block * 256), words - (greatest(p, block * 256) - block * 256))))::BIGINT AS taken
  FROM pc JOIN slot USING (s, block) GROUP BY 1, 2)
SELECT sz.doc AS doc_id, sz.src AS source, sz.size, g.source_size, g.target, coalesce(used.taken, 0)::BIGINT AS taken
FROM sz JOIN g ON sz.src IS NOT DISTINCT FROM g.src LEFT JOIN used ON used.s = g.s AND used.doc IS NOT DISTINCT FROM sz.doc
"""


@query("op2_mixing", SQL)
def op2(spark, sf_dir):
    return taken(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
