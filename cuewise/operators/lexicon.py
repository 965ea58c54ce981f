"""Misread words and the terms they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions.blocks import block_ratio
from cuewise.session import checkpointed


def snap(words: DataFrame, terms: list[str], cutoff: float = 0.82, letters: float = 0.7) -> DataFrame:
    """`(w, snapped)` for distinct words `(w)`: the term of the highest block ratio from `cutoff` on, else the word.

    Of equally close terms the last in code point order is taken. Words with a share of Latin letters below
    `letters` stay. A word meets each term once, and a pair is compared only if its edit distance allows the
    ratio: matching blocks are a common subsequence, so at most (1 - cutoff) of both lengths are edits.
    The best term is an aggregate; words without a near term never leave the JVM.
    """
    words = checkpointed(words)
    latin = words.where(tx.ascii_letter_ratio(F.col("w")) >= letters)
    pairs = latin.select("w", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(len(t)).alias("n")) for t in terms])).alias("t")).select("w", "t.*")
    both, most = F.char_length("w") + F.col("n"), int((1 - cutoff) * 2 / cutoff * max(map(len, terms))) + 1
    edits = F.levenshtein("w", "term", most)
    close = (2 * F.least(F.char_length("w"), F.col("n")) >= cutoff * both - 1e-9) & (edits >= 0) & (edits <= (1 - cutoff) * both + 1e-9)
    rated = pairs.where(close).select("w", "term", block_ratio(F.col("term"), F.col("w"), cutoff).alias("ratio")).where("ratio IS NOT NULL")
    best = rated.groupBy("w").agg(F.max_by("term", F.struct("ratio", "term")).alias("term"))
    return words.join(best, "w", "left").select("w", F.coalesce("term", "w").alias("snapped"))
