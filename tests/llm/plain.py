"""Plain Python versions and small tables for the tests."""

import random
import re
from collections import Counter

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType())])
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that operators use inside.
CLASH = ["n", "w", "key", "size", "label", "_id", "_key", "_t", "_w", "target", "grams", "score", "kept", "s", "a", "b"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return BLANK.findall(text or "")


def folded(text):
    return FOLDED.findall(low(text))


def speech(rng, n, stems):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


EN, DE = ["th", "er", "on", "an", "re", "he", "in", "ed"], ["ge", "sch", "ung", "ei", "zu", "ß", "ver", "äu"]


def corpus(n=60, seed=3):
    """Ordinary texts in two languages, near and exact copies, a shared passage, null, empty, blank and very long ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        de = i % 3 == 0
        rows.append([i, speech(rng, 60 + i % 50, DE if de else EN) + ".\n" + speech(rng, 30, DE if de else EN), "de" if de else "en", f"src{i % 4}" if i % 7 else None])
    base = rows[1][1].split(" ")
    for k in range(6):  # one word changed each
        copy = list(base)
        copy[5 + 9 * k] = f"changed{k}"
        rows.append([n + k, " ".join(copy), "en", "src1"])
    rows += [[n + 6 + k, rows[2][1], "en", "src2"] for k in range(4)]
    passage = speech(rng, 55, EN)
    for k in range(3):
        rows.append([n + 10 + k, speech(rng, 40 + k, EN) + " " + passage + " " + speech(rng, 40, EN), "en", "src0"])
    rows += [[n + 13, None, None, None], [n + 14, "", "en", "src0"], [n + 15, " \t\n ", "en", "src0"], [n + 16, "word", "en", "src1"], [n + 17, speech(rng, 30_000, EN), "en", "src3"]]
    rows.append(list(rows[4]))  # a repeated row
    rows += [[None, rows[5][1] + " tail", "en", None], [n + 18, "12 34 !!", "de", "é"]]
    return [tuple(r) for r in rows]


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH])


def repeat_words(w):
    c = Counter(zip(w, w[1:], w[2:]))
    return len({k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})


def shingles(text, size=4):
    w = [x for x in words(low(text))]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(rows, percent=85, size=4):
    """Smallest id that each row reaches, by comparing all pairs."""
    sets = [shingles(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    low_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low_id[top(i)] = min(low_id.get(top(i), r[0]), r[0])
    return [low_id.get(top(i)) if a else r[0] for i, (r, a) in enumerate(zip(rows, sets))]
