"""Text scores of paired captions and the sequence-alignment score of chapter lists."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.operators.barrier import let, once
from cuewise.operators.folds import grouped


def caption_tokens(text: Column) -> Column:
    """Lower-case ASCII words; other characters separate."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\x00-\x7f]", " ")), r"[^a-z0-9']+"), lambda x: x != "")


def grams(words: list[str], n: int) -> Counter:
    """Counts of the runs of `n` words."""
    return Counter(zip(*[words[k:] for k in range(n)]))


def _matches(pw: Column, rw: Column, most: int) -> Column:
    """Per order from 1 on, the n-grams of `pw` that `rw` has as well, clipped, and all of `pw`."""

    @F.pandas_udf("array<bigint>")
    def run(pw: pd.Series, rw: pd.Series) -> pd.Series:
        def one(p, r):
            p, r = ([] if x is None else list(x) for x in (p, r))
            return [x for n in range(1, most + 1) for x in ((grams(p, n) & grams(r, n)).total(), max(0, len(p) - n + 1))]

        return pd.Series([one(p, r) for p, r in zip(pw, rw)], dtype=object)

    return run(pw, rw)


def token_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with token arrays; a missing reference has no tokens, so it scores 0."""
    return once(pairs.select("tiou", "video_id", "j", F.coalesce("i", F.lit(-1).cast("long")).alias("i"), "pred_title", "ref_title"),
                pw=caption_tokens(F.col("pred_title")), rw=caption_tokens(F.coalesce("ref_title", F.lit("")))).drop("pred_title", "ref_title")


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """Corpus BLEU of a video's pairs per threshold and order: clipped counts, shortest-side penalty."""
    counted = pairs.select("tiou", "video_id", F.size("pw").alias("c"), F.size("rw").alias("r"), _matches(F.col("pw"), F.col("rw"), most).alias("m"))
    rows = counted.groupBy("tiou", "video_id").agg(F.sum("c").alias("c"), F.sum("r").alias("r"), *[F.sum(F.col("m")[k]).alias(f"m{k}") for k in range(2 * most)])
    small, tiny = 1e-9, 1e-15
    precision = lambda n: (F.col(f"m{2 * n - 2}") + tiny) / (F.col(f"m{2 * n - 1}") + small)
    ratio = (F.col("c") + tiny) / (F.col("r") + small)
    out, product = [], F.lit(1.0)
    for n in range(1, most + 1):
        product = product * precision(n)
        out.append(F.struct(F.lit(n).alias("n"), (F.pow(product, F.lit(1.0 / n)) * F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)).alias("score"), precision(n).alias("precision")))
    return rows.select("tiou", "video_id", F.explode(F.array(*out)).alias("b")).select("tiou", "video_id", "b.*")


#: Bits of a number that stand for words, so that sums of two numbers and a carry fit.
BITS = 62


def common_words(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays.

    A bit per word of `b` says whether the row of the alignment stays level there. One word of `a` moves all
    of them with an addition: among the places where it stands, each run of ones up to it moves by one. `b` takes one
    number per 62 words; the carry goes from number to number.
    """
    full = (1 << BITS) - 1
    numbers = F.greatest(F.lit(1), F.ceil(F.size(b) / BITS).cast("int"))

    def places(word: Column, k: Column) -> Column:
        part = F.transform(F.slice(b, k * BITS + 1, F.lit(BITS)), lambda y, p: F.when(y == word, F.pow(F.lit(2.0), p).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.aggregate(part, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))

    def moved(level: Column, word: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            def put(v: Column, at: Column) -> Column:
                both = v.bitwiseAND(at)
                total = v + both + acc["carry"]
                now = total.bitwiseAND(F.lit(full)).bitwiseOR(v.bitwiseAND(F.bitwise_not(both)))
                return F.struct(F.shiftright(total, BITS).alias("carry"), F.array_append(acc["out"], now).alias("out"))

            return let(put, F.get(level, k), places(word, k))

        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), numbers - 1), start, step, lambda acc: acc["out"])

    end = F.aggregate(a, F.array_repeat(F.lit(full).cast("long"), numbers), moved)
    return F.aggregate(end, F.lit(0), lambda n, v: n + BITS - F.bit_count(v).cast("int"))


def rouge_l(pairs: DataFrame, beta: float = 1.2) -> DataFrame:
    """Mean longest-common-subsequence F score of a video's pairs."""
    filled = (F.size("pw") > 0) & (F.size("rw") > 0)
    rows = once(pairs, hit=F.when(filled, common_words(F.col("pw"), F.col("rw"))).otherwise(0))
    p, r = F.col("hit") / F.size("pw"), F.col("hit") / F.size("rw")
    score = F.when(F.col("hit") > 0, (1 + beta**2) * p * r / (r + beta**2 * p)).otherwise(0.0)
    return rows.withColumn("score", score).groupBy("tiou", "video_id").agg(F.avg("score").alias("score"))


def cider(pairs: DataFrame, sigma: float = 6.0, most: int = 4) -> DataFrame:
    """Mean CIDEr-D of a video's pairs: n-gram TF-IDF cosine with clipping and a length penalty, times 10.
    Document frequencies are taken over the video's own references. The pairs of a video, at most a few per chapter, are
    scored in one pass; no n-gram is shuffled."""

    def mean(rows: list[tuple]) -> list[tuple]:
        words = lambda x: [] if x is None else list(x)
        found = [[(grams(words(p), n), grams(words(r), n)) for n in range(1, most + 1)] for _, _, p, r in rows]
        df = [Counter(g for per in found for g in per[n][1]) for n in range(most)]
        total = 0.0
        for (_, _, p, r), per in zip(rows, found):
            if p is None or r is None:
                continue
            score = 0.0
            for n, (hyp, ref) in enumerate(per):
                idf = {g: math.log(len(rows)) - math.log(max(df[n][g], 1)) for g in hyp | ref}
                dot = sum(min(c, ref[g]) * ref[g] * idf[g] ** 2 for g, c in hyp.items())
                nh, nr = (math.sqrt(sum((c * idf[g]) ** 2 for g, c in x.items())) for x in (hyp, ref))
                score += dot / (nh * nr) if nh > 0 and nr > 0 else dot
            total += score * math.exp(-((len(p) - len(r)) ** 2) / (2 * sigma**2)) / most * 10.0
        return [(total / len(rows),)]

    return grouped(pairs, ["tiou", "video_id"], ["j", "i"], ["j", "i", "pw", "rw"], mean, "score double")


def mean_over_videos(scores: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Mean over videos per threshold, then over thresholds, in percent."""
    extra = extra or []
    return scores.groupBy("tiou", *extra).agg((F.avg("score") * 100).alias("s")).groupBy(*extra).agg(F.bround(F.avg("s"), 2).alias("score"))


def _climb(cells: dict[int, list[tuple[int, float]]], n_pred: int) -> tuple[float, list[tuple[int, int]]]:
    """Best sum over a monotone path through a table of mostly zeros, and the cells the path takes.

    The table keeps one row of `n_pred` sums, and per row the columns where a step through the cell beats both
    neighbours; only cells above 0 can, and the first one always counts. Going back, a row gives its last such
    column that is not behind the one taken before.
    """
    before, takes = np.zeros(n_pred), {0: [0]}
    for i in sorted(cells):
        row = before.copy()
        through = [(j, (before[j - 1] if j else 0.0) + s) for j, s in cells[i]]
        for j, s in through:
            row[j] = max(row[j], s)
        row = np.maximum.accumulate(row)
        takes.setdefault(i, []).extend(j for j, s in through if s > before[j] and (j == 0 or s > row[j - 1]) and (i or j))
        before = row
    path, most = [], n_pred - 1
    for i in sorted(takes, reverse=True):
        found = [j for j in takes[i] if j <= most]
        if found:
            path.append((i, max(found)))
            most = max(found) - 1
        if most < 0:
            break
    return float(before[-1]), path


def alignment(pairs: DataFrame, counts: DataFrame, thresholds=(0.0,)) -> DataFrame:
    """Scores of the best monotone alignment of references and predictions per video, threshold and variant:
    `variant, threshold, p, r, f1` with P = score / n_pred, R = score / n_ref.

    Variants: `d` sums the overlaps of the alignment by overlap, `c` the products of the alignment by overlap
    times text score, `a` and `b` the text scores of the cells on the path of the alignment by overlap.

    `pairs`: video_id, i, j, iou, text. Overlaps under a threshold count 0. Only overlapping pairs are passed in,
    at most n_ref + n_pred of a video, and the first of both sides, which is always on the path. A video
    without predictions scores 0.
    """
    ts = [float(t) for t in thresholds]

    def best(rows: list[tuple]) -> list[tuple]:
        n_ref, n_pred = rows[0][0], rows[0][1]
        out = []
        for t in ts:
            over, both, texts = {}, {}, {}
            for _, _, i, j, overlap, text in rows:
                if i is None or i != i:
                    continue
                i, j, text = int(i), int(j), 0.0 if text is None or text != text else text
                texts[i, j] = text
                if overlap >= t and overlap > 0:
                    over.setdefault(i, []).append((j, overlap))
                    if text > 0:
                        both.setdefault(i, []).append((j, overlap * text))
            top, path = _climb(over, n_pred) if n_pred else (0.0, [])
            along = sum(texts.get(cell, 0.0) for cell in path)
            for variant, score in (("a", along), ("b", along), ("c", _climb(both, n_pred)[0] if n_pred else 0.0), ("d", top)):
                p, r = (score / n_pred, score / n_ref) if n_pred and n_ref else (0.0, 0.0)
                out.append((variant, t, p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0))
        return out

    rows = counts.join(pairs, "video_id", "left").select("video_id", "n_ref", "n_pred", "i", "j", "iou", "text")
    return grouped(rows, ["video_id"], ["i", "j"], ["n_ref", "n_pred", "i", "j", "iou", "text"], best, "variant string, threshold double, p double, r double, f1 double")
