"""Operators on text rows: first occurrences, keyword vectors, line samples and joined streams."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.operators.folds import grouped
from cuewise.operators.keywords import WORDS5, single, top_words, words
from cuewise.operators.ordered import BLOCK, density_blocks, fixed_blocks, scan
from cuewise.operators.windows import top_rows


def first_occurrences(lines: DataFrame, denylist: list[str] = tx.LINE_DENYLIST) -> DataFrame:
    """Distinct lines of a video at their first place, without short ones and screen furniture.

    An aggregate per (video, line): repeated lines are combined before the shuffle.
    """
    t = tx.strip(F.col("text"))
    rows = lines.select("video_id", "line_no", t.alias("text")).where((F.length("text") >= 2) & ~F.lower("text").isin(denylist))
    return rows.groupBy("video_id", "text").agg(F.min("line_no").alias("line_no"))


def limit_tokens(df: DataFrame, key: str, text: str, cap: int = 5) -> DataFrame:
    """At most `cap` occurrences of each token, order kept; one text is one cell.

    A text whose key stands on no other row is cut where it is; the tokens of texts that share a key count together.
    """
    one, more = single(df.select(key, F.col(text).alias("_text")), [key])

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def short(toks) -> str:
            seen: Counter = Counter()
            out = []
            for tok in toks:
                seen[tok] += 1
                if seen[tok] <= cap:
                    out.append(tok)
            return " ".join(out)

        return texts.map(short)

    toks = tx.tokens(F.col("_text"))
    first = one.select(key, toks.alias("_toks")).where(F.size("_toks") > 0).select(key, cut("_toks").alias("text"))
    rows = more.select(key, F.posexplode(toks).alias("pos", "tok"))
    n = F.row_number().over(Window.partitionBy(key, "tok").orderBy("pos"))
    kept = rows.withColumn("_n", n).where(F.col("_n") <= cap)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "tok")))
    return first.unionByName(kept.groupBy(key).agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["tok"])).alias("text")))


# Fixed value: lines that are nothing but a speaker label.
SPEAKER_LINE = "^(新竹小幫手|老師|助教)$"


def informative_sample(lines: DataFrame, most: int) -> DataFrame:
    """Informative blocks (40 characters, no stop phrase), all when none is; every step-th, `most` at most."""
    t = tx.strip(F.col("text"))
    rows = lines.withColumn("_good", (F.length(t) >= 40) & ~t.rlike(SPEAKER_LINE))
    n = rows.groupBy("video_id").agg(F.count_if("_good").alias("_g"), F.count(F.lit(1)).alias("_a"))
    rows = rows.join(n, "video_id").where(F.col("_good") | (F.col("_g") == 0))
    rows = scan(fixed_blocks(rows, "line_no"), ["video_id"], ["line_no"], number="_r").drop(BLOCK)
    total = F.when(F.col("_g") > 0, F.col("_g")).otherwise(F.col("_a"))
    step = F.when(total > most, F.floor(total / most)).otherwise(F.lit(1).cast("long"))
    pick = ((F.col("_r") - 1) % step == 0) & (F.floor((F.col("_r") - 1) / step) < most)
    return rows.where(pick | (total <= most)).drop("_good", "_g", "_a", "_r")


def relevance_filter(blocks: DataFrame, floor: float = 0.12, refill: int = 0, least: int = 3, drop_admin: bool = False) -> DataFrame:
    """Blocks `(video_id, pos, text, score, is_admin, size)` at or above the floor; when fewer than
    `refill` pass, the best others are added; when fewer than `least` remain, all are kept. With
    `drop_admin`, blocks marked `is_admin` neither pass nor refill."""
    out = F.coalesce("is_admin", F.lit(False)) if drop_admin else F.lit(False)
    passed = blocks.withColumn("_out", out).withColumn("_ok", (F.col("score") >= floor) & ~F.col("_out"))
    n = passed.groupBy("video_id").agg(F.count_if("_ok").alias("_k"), F.count_if(~F.col("_out")).alias("_all"))
    others = top_rows(passed.where("NOT _ok AND NOT _out").select("video_id", "pos", "score", "size"), ["video_id"], [F.desc("score"), F.desc("size"), F.asc("pos")], max(refill, 1))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), F.desc("size"), F.asc("pos")))
    extra = others.select("video_id", "pos", rank.alias("_rank"))
    rows = passed.join(n, "video_id").join(extra, ["video_id", "pos"], "left")
    added = ~F.col("_ok") & (F.coalesce("_rank", F.lit(1 << 30)) <= F.lit(refill) - F.col("_k"))
    after = F.greatest(F.col("_k"), F.least(F.lit(refill), F.col("_all")))
    return rows.where(F.col("_ok") | added | (after < least)).drop("_ok", "_out", "_k", "_all", "_rank")


# Topics that fill up a short list.
PAD_TOPICS = ["chart", "graph", "diagram", "code editor", "terminal", "equation", "table"]


def topic_seeds(lines: DataFrame, speech: DataFrame, k: int = 12) -> DataFrame:
    """Three top words of each line, then the k top longer words of the speech, distinct in order,
    padded with fixed topics and cut to max(8, k)."""
    from_lines = top_words(lines, ["video_id", "line_no"], "text", 3).select("video_id", F.lit(0).alias("src"), F.col("line_no").cast("long").alias("a"), F.col("rank").cast("long").alias("b"), "word")
    spoken = speech.select("video_id", F.col("seg_idx").alias("seg"), F.posexplode(words(F.lower("text"), WORDS5)).alias("p", "word"))
    counts = spoken.groupBy("video_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seg", "p")).alias("at"))
    best = top_rows(counts, ["video_id"], [F.desc("n"), F.asc("at")], k)
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("n"), F.asc("at")))
    from_speech = best.select("video_id", F.lit(1).alias("src"), rank.cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "word")
    firsts = from_lines.unionByName(from_speech).groupBy("video_id", "word").agg(F.min(F.struct("src", "a", "b")).alias("at"))
    few = top_rows(firsts, ["video_id"], [F.asc("at")], max(8, k))
    pads = lines.select("video_id").distinct().select("video_id", F.posexplode(F.array(*[F.lit(p) for p in PAD_TOPICS])).alias("a", "word"))
    both = few.unionByName(pads.select("video_id", "word", F.struct(F.lit(2).alias("src"), F.col("a").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at")))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("at"))
    return both.withColumn("place", place).where(F.col("place") <= max(8, k)).select("video_id", F.col("place").cast("long").alias("place"), "word")


# Fixed value: token pattern of the keyword vectors.
TFIDF_TOKEN = r"(?U)\b[\x{4e00}-\x{9fff}]{2,}|[a-zA-Z0-9_]{3,}\b"


def weighted(rows: list[tuple]) -> dict[int, dict[str, float]]:
    """Unit weights `{line_no: {word: weight}}` of one text's lines `(line_no, words)`: raw counts, idf
    ln((1+n)/(1+df))+1, unit length. Lines without words have none."""
    lines: dict[int, Counter] = {}
    for no, text in rows:
        if text:
            lines.setdefault(no, Counter()).update(text.split(" "))
    df = Counter(w for tf in lines.values() for w in tf)
    idf = {w: math.log((1 + len(rows)) / (1 + d)) + 1 for w, d in df.items()}
    out = {}
    for no, tf in lines.items():
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        out[no] = {w: c * idf[w] / norm for w, c in tf.items()}
    return out


def per_text(lines: DataFrame, fn, out: str) -> DataFrame:
    """`fn` on the lines `(line_no, words)` of each text in turn; their words, one cell a line, are shuffled once."""
    rows = lines.select("video_id", "line_no", F.array_join(words(F.lower("text"), TFIDF_TOKEN), " ").alias("_words")).where("video_id IS NOT NULL")
    return grouped(rows, ["video_id"], ["line_no"], ["line_no", "_words"], fn, out)


def tfidf(lines: DataFrame) -> DataFrame:
    """Word weights per line within its video: raw counts, idf ln((1+n)/(1+df))+1, unit length."""

    def weights(rows: list[tuple]) -> list[tuple]:
        return [(no, w, x) for no, line in weighted(rows).items() for w, x in line.items()]

    return per_text(lines, weights, f"line_no {dict(lines.dtypes)['line_no']}, word string, weight double")


#: Characters of a part that is collected as it is.
WHOLE = 1 << 16


def capped_corpus(slides: DataFrame, speech: DataFrame, cap: int, whole: int = WHOLE) -> DataFrame:
    """One text per video, slides first, cleaned of chatter and cut to `cap` characters.

    Rows `(video_id, pos, text)`. A part of at most `WHOLE` characters is collected and cleaned once, as it is. In a
    longer one each line is cleaned and scrubbed by itself first; lines of which
    nothing is left count as blank, and the others leave at least their length less one word, which a
    line before may take. Only rows that this running length lets reach the first `cap` characters of
    their part are collected, so the cell is bounded; blank rows are kept once per run because they turn
    the line break into a space.
    """

    def joined(rows: DataFrame) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
        return rows.groupBy("video_id").agg(F.concat_ws("\n", F.transform(ordered, lambda x: x["text"])).alias("t"))

    def part(rows: DataFrame, clean) -> DataFrame:
        rows = rows.where("text IS NOT NULL")
        large = rows.groupBy("video_id").agg(F.sum(F.length("text") + 1).alias("_n")).where(F.col("_n") > whole).select("video_id")
        known = rows.where("video_id IS NOT NULL")
        short = known.join(large, "video_id", "left_anti").withColumn("text", tx.strip(F.col("text")))
        rest = known.join(large, "video_id", "left_semi").unionByName(rows.where("video_id IS NULL"))
        return joined(short).unionByName(joined(reaching(rest, clean)))

    def reaching(rows: DataFrame, clean) -> DataFrame:
        body = rows.withColumn("text", tx.strip(F.col("text"))).withColumn("_left", tx.scrub_admin(clean(F.col("text"))))
        body = body.withColumn("text", F.when((F.col("_left") == "") & ~F.col("text").rlike("[℃°]$"), "").otherwise(F.col("text")))  # a last degree sign takes a word of the next line
        body = body.withColumn("_least", F.length("_left") - F.length(F.regexp_extract("_left", r"^\S*", 0))).drop("_left")
        r = scan(fixed_blocks(body, "pos"), ["video_id"], ["pos"], total={"_run": F.col("_least")}, lag={"_prev": "text"}).drop(BLOCK)
        need = (F.col("_run") - F.col("_least") < cap) & ~((F.col("text") == "") & (F.col("_prev") == ""))
        return r.where(need)

    a = part(slides, lambda c: tx.clean_slide_text(c, watermarks=True)).withColumnRenamed("t", "a")
    b = part(speech, tx.clean_speech_text).withColumnRenamed("t", "b")
    both = F.concat(F.lit("【Slides(OCR)】\n"), tx.clean_slide_text(F.coalesce("a", F.lit("")), watermarks=True),
                    F.lit("\n\n【Audio(ASR)】\n"), tx.clean_speech_text(F.coalesce("b", F.lit(""))))
    return a.join(b, "video_id", "full").select("video_id", F.substring(tx.scrub_admin(both), 1, cap).alias("text"))


def interleave(streams: list[tuple[str, DataFrame]], drop_image_frames: bool = False) -> DataFrame:
    """Timed lines `(video_id, sec, pos, text)` of several streams in time order, prefixed by stream.

    Equal times follow the order of the list. One output row per line, with its position.
    """
    rows = None
    for rank, (prefix, df) in enumerate(streams):
        body = F.concat(F.lit(prefix), F.format_string("%02d:%02d:%02d", F.floor(F.col("sec") / 3600), F.floor(F.col("sec") % 3600 / 60), F.col("sec") % 60), F.lit(": "), F.col("text"))
        part = df.select("video_id", "sec", F.lit(rank).alias("rank"), "pos", body.alias("line"))
        if drop_image_frames and prefix.startswith("Frame"):
            part = part.where(~F.col("line").contains("image"))
        rows = part if rows is None else rows.unionByName(part)
    return scan(density_blocks(rows, ["video_id"], "sec", tie="rank"), ["video_id"], ["sec", "rank", "pos"], number="place").drop(BLOCK)


def stacked(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """Text blocks under each other as rows `(video_id, section, pos, line)`; a header row has pos -1.

    A video without the first section gets the other one bare, without header.
    """
    (h1, first), (h2, second) = sections
    has = first.select("video_id").distinct().withColumn("_has", F.lit(True))
    body2 = second.join(has, "video_id", "left")
    a = first.select("video_id", F.lit(0).alias("section"), "pos", F.col("text").alias("line"))
    b = body2.select("video_id", F.lit(1).alias("section"), "pos", F.col("text").alias("line"))
    heads = has.select("video_id", F.lit(0).alias("section"), F.lit(-1).cast("long").alias("pos"), F.lit(h1).alias("line"))
    heads2 = second.select("video_id").distinct().join(has, "video_id", "left_semi").select("video_id", F.lit(1).alias("section"), F.lit(-1).cast("long").alias("pos"), F.lit(h2).alias("line"))
    return a.unionByName(b).unionByName(heads).unionByName(heads2)


def folded_distinct(rows: DataFrame, key: Column, cap: int) -> DataFrame:
    """First row per case-folded key and video, in order, `cap` at most, numbered T01, T02 …"""
    firsts = rows.withColumn("_k", F.lower(key)).where("_k <> ''").groupBy("video_id", "_k").agg(F.min(F.struct("pos", "title")).alias("r"))
    few = top_rows(firsts.select("video_id", "r.pos", "r.title"), ["video_id"], [F.asc("pos")], cap)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    return few.select("video_id", F.format_string("T%02d", place).alias("topic_id"), "title")
