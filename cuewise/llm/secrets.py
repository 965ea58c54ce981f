"""Secret scans: candidates by shape, false positives removed by a random forest (native)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import drawn, lower_ascii, saved, words
from cuewise.llm.registry import query, table

#: A candidate is any such run of a word; an equals sign is part of it only as padding at its end.
SHAPE = r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
KEYWORD = r"(?i)(?<![a-z])(token|secret|passw|pwd|credential|auth|api|key)"
HARMLESS = r"(?i)(?<![a-z])(examples?|samples?|dummy|placeholder|tests?|fixtures?|sha|md5|commit|checksum|uuid)(?![a-z])"
FEATURES = ["length", "digits", "uppers", "changes", "variety", "coverage", "path_words", "path_bin", "keyword", "assigned", "quoted", "harmless"]


def dictionary(docs: DataFrame, text: str = "text", least: float = 2e-5) -> DataFrame:
    """`(piece)`: three-letter pieces that make up at least `least` of all pieces of the words in all
    documents, so at most 1 / `least` rows. Words are runs of letters."""
    each = docs.select(F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    runs = each.select(F.regexp_extract(lower_ascii(F.col("w")), r"^\p{L}{3,}", 0).alias("w"), "n").where(F.length("w") >= 3)
    pieces = runs.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("piece"))
    counts = saved(pieces.groupBy("piece").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") >= max(1.0, least * total)).select("piece")


def findings(docs: DataFrame, known: DataFrame, *, text: str = "text", path: str = "source", **more: Column) -> DataFrame:
    """One row per candidate: `more`, `word` (its place), `run` (its number in the word), `value` and the FEATURES.

    A word may hold many candidates (JSON, CSV, query strings, assignments); key words and assignment are looked
    for just before each of them: in the word from the candidate before on, and in the words before only where the
    word has no key of its own. `known` is the dictionary. Only the candidates become rows, with the words beside them; no text is
    shuffled. Null texts have none; a null path is an empty one.
    """
    base = docs.where(F.col(text).rlike(SHAPE)).select(*[c.alias(k) for k, c in more.items()], F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"), words(F.col(text)).alias("_w"))
    placed = F.transform("_w", lambda w, i: F.when(F.length(w) >= 16, F.struct(i.alias("word"), w.alias("x"))))
    shaped = F.filter(placed, lambda c: F.when(c.isNotNull(), c["x"].rlike(SHAPE)).otherwise(F.lit(False)))
    one = base.select("*", F.explode(shaped).alias("_c")).select("*", F.col("_c.word").alias("word"), F.col("_c.x").alias("_x"))
    near = lambda d: F.coalesce(F.get("_w", F.col("word") + d), F.lit(""))
    # all runs of a word, and the text between them: what is no run, cut at the places of the runs
    runs, mark = F.regexp_extract_all("_x", F.lit(SHAPE), 0), "\x00"
    gaps = F.split(F.regexp_replace("_x", SHAPE, mark), mark)
    each = one.withColumn("_gaps", gaps).select("*", F.posexplode(runs).alias("run", "value"))
    one = each.select(
        *more, "word", "run", "_path", "value", F.get("_gaps", F.col("run")).alias("_gap"), F.when(F.col("run") > 0, F.get(runs, F.col("run") - 1)).otherwise(F.lit("")).alias("_last"),
        F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("_left"), F.concat_ws(" ", near(1), near(2)).alias("_right"))
    n = F.length("value")
    flag = lambda c: c.cast("double")
    # a run right before `=` or `:` is the name of this one; a name in the gap is the last between separators
    assigning = r"[=:][^A-Za-z0-9]*$"
    named = F.col("_gap").rlike(r"^[^A-Za-z0-9]*[=:][^A-Za-z0-9]*$")
    own = F.regexp_extract("_gap", r"[^,;&?{}]*$", 0)
    prefix = F.when(named, F.concat("_last", "_gap")).otherwise(own)
    alone = (F.col("run") == 0) & ~own.rlike("[A-Za-z0-9]") & (F.length(own) == F.length("_gap"))
    before = F.when(alone, F.concat_ws(" ", "_left", prefix)).otherwise(prefix)
    change = sum(F.regexp_count("value", F.lit(p)) for p in ("[0-9](?=[A-Za-z])", "[A-Za-z](?=[0-9])", "[a-z](?=[A-Z])", "[A-Z](?=[a-z])"))
    rows = one.select(
        *more, "word", "run", "value",
        n.cast("double").alias("length"), (F.regexp_count("value", F.lit("[0-9]")) / n).alias("digits"), (F.regexp_count("value", F.lit("[A-Z]")) / n).alias("uppers"),
        (change / n).alias("changes"), (F.size(F.array_distinct(F.split("value", ""))) / n).alias("variety"),
        flag(F.col("_path").rlike(HARMLESS)).alias("path_words"), F.pmod(F.xxhash64("_path"), F.lit(32)).cast("double").alias("path_bin"),
        flag(before.rlike(KEYWORD)).alias("keyword"), flag(before.rlike(assigning)).alias("assigned"),
        flag(prefix.rlike("[\"'`]$")).alias("quoted"), flag(F.concat_ws(" ", "_left", "_right").rlike(HARMLESS)).alias("harmless"))
    pieces = rows.withColumn("_p", F.transform(F.sequence(F.lit(1), F.col("length").cast("int") - 2), lambda i: F.substring(F.lower("value"), i, F.lit(3))))
    keys = [c for c in rows.columns]
    hit = pieces.select(*keys, F.explode("_p").alias("piece")).join(F.broadcast(known.withColumn("_in", F.lit(1))), "piece", "left")
    return hit.groupBy(*keys).agg((F.count("_in") / F.count("*")).alias("coverage"))


def by_rule(rows: DataFrame) -> DataFrame:
    """Findings with `label`, where no labels were given: a value that mixes letters and digits, is no
    dictionary text and is assigned to a key word is a secret, anything else is a false positive."""
    sure = (F.col("digits") > 0.1) & (F.col("digits") < 1) & (F.col("coverage") < 0.6) & (F.col("keyword") == 1) & (F.col("assigned") == 1) & (F.col("harmless") == 0)
    return rows.withColumn("label", sure.cast("double"))


def forest(labelled: DataFrame, *, trees: int = 15, depth: int = 5, seed: int = 11) -> Column:
    """Share of the trees of a random forest, trained on findings with `label` 0/1, that vote for a secret.

    The trees are read into one column expression, so scoring is part of the plan like any other column.
    With one label only, that label is the score; without findings it is 0.
    """
    seen = [r[0] for r in labelled.select("label").distinct().collect()]
    if len(seen) < 2:
        return F.lit(float(seen[0]) if seen else 0.0)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="_f").transform(labelled).select("_f", "label")
    model = RandomForestClassifier(featuresCol="_f", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)

    def read(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= split.threshold(), read(node.leftChild())).otherwise(read(node.rightChild()))

    return sum((read(t._java_obj.rootNode()) for t in model.trees), F.lit(0.0)) / len(model.trees)


def scan(docs: DataFrame, labels: DataFrame | None = None, *, most: int = 20_000, least: float = 0.5, text: str = "text", path: str = "source", **more: Column) -> DataFrame:
    """One row per finding: `more`, `word, run, value`, the features, `score` (0 to 1) and `secret` (score >= `least`).

    `labels` are labelled findings (`FEATURES`, `label`); without, the findings themselves are labelled by
    `by_rule`. The forest learns from about `most` of them, by hash; candidates, dictionary and scores
    cover all documents. A finding that stands twice in a text is two rows; equal rows of `docs` with equal
    `more` give their findings once. An empty table has no findings.
    """
    found = saved(findings(docs, dictionary(docs, text), text=text, path=path, **more))
    train = by_rule(found) if labels is None else labels
    train = drawn(train.withColumn("_key", F.xxhash64("value", "word", "run") if labels is None else F.xxhash64(*FEATURES)), "_key", most)
    # a fixed order, so that the forest's draws repeat
    ready = saved(train.select(*FEATURES, "label", "_key").repartitionByRange(4, "_key").sortWithinPartitions("_key", *FEATURES).drop("_key"))
    return found.withColumn("score", forest(ready)).withColumn("secret", F.col("score") >= least)


@query("op6_secret_scan")
def op6(spark, sf_dir):
    """Findings with a fingerprint in place of the value."""
    rows = scan(table(spark, sf_dir, "documents"), doc_id=F.col("doc_id"))
    return rows.select("doc_id", F.col("word").cast("long").alias("word"), F.col("run").cast("long").alias("run"), F.col("length").cast("long").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "coverage", "score", "secret")
