"""N-gram Jaccard join by T-occurrence search over inverted lists, and its connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import components, raw, saved
from cuewise.llm.registry import query, table

#: Counters of the shingle sketch and of one part of it; a list up to SMALL texts is answered by its pairs;
#: shingles of one block of a cluster of texts with long common lists.
COUNTERS, PART, SMALL, BLOCK = 1 << 20, 1 << 16, 64, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingle hashes (sorted) of a text: A-Z lower-cased, words between white space."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text) -> np.ndarray:
        words = raw(text).lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
            out ^= out >> np.uint64(31)
        return np.unique(out)


def _print(s: np.ndarray) -> int:
    """Fingerprint of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _needed(n, percent: int):
    """Least overlap of a set of `n` with any set that it may be linked with."""
    return -(-percent * n // 100)


def _extra(n):
    """How many short lists must agree (T - L); never more than half of the set."""
    return np.minimum(np.maximum(1, n // 2), 1 + n // 33)


def linked(overlap, a, b, percent: int):
    return overlap * (100 + percent) >= percent * (a + b)


def prints(docs: DataFrame, size: int, doc: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """`(doc, tk, n, fp)` per row (tk: hash of the text), and how many shingles of all texts fall on each counter of a sketch. The
    sketch of a task is a few binary parts; parts are added up as they stream past."""
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).cast("string").alias("doc"), F.xxhash64(text).alias("tk"), F.col(text).alias("text"))

    def run(batches):
        shingles, counts = Shingler(size), np.zeros(COUNTERS, np.uint32)
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            for s in sets:
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            yield pd.DataFrame({"doc": b["doc"], "tk": b["tk"], "n": [len(s) for s in sets], "fp": [_print(s) for s in sets], "part": None, "blob": None})
        if counts.any():
            parts = range(COUNTERS // PART)
            yield pd.DataFrame({"doc": None, "tk": None, "n": None, "fp": None, "part": list(parts), "blob": [counts[p * PART : (p + 1) * PART].tobytes() for p in parts]})

    both = saved(rows.mapInPandas(run, "doc string, tk long, n long, fp long, part int, blob binary"))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, blob in zip(b["part"], b["blob"]):
                sums[p] = sums.get(p, np.zeros(PART, np.uint64)) + np.frombuffer(blob, np.uint32)
        yield pd.DataFrame({"part": list(sums), "blob": [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]})

    sketch = np.zeros(COUNTERS, np.uint32)
    for r in both.where("part IS NOT NULL").select("part", "blob").repartition("part").mapInPandas(add, "part int, blob binary").collect():
        sketch[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["blob"], np.uint32)
    return both.where("part IS NULL").select(F.col("doc").cast(kind).alias("doc"), "tk", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")), sketch


def short_lists(docs: DataFrame, sketch: np.ndarray, size: int, percent: int, text: str) -> DataFrame:
    """`(shingle, fp, n)`: of each text its rarest shingles, n - needed + extra of them. Two linked texts
    share at least the lesser `extra` of these; the other, long lists need not be merged, only probed."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        shingles, seen = Shingler(size), set()
        for b in batches:
            keys, ids, sizes = [], [], []
            for t in b["text"]:
                s = shingles(t)
                fp = _print(s)
                if not len(s) or fp in seen:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(fp)
                n = len(s)
                uses = shared.value[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                few = s[np.lexsort((s, uses))[: n - _needed(n, percent) + int(_extra(n))]]
                keys.append(few.view(np.int64))
                ids.append(np.full(len(few), fp))
                sizes.append(np.full(len(few), n))
            if keys:
                yield pd.DataFrame({"shingle": np.concatenate(keys), "fp": np.concatenate(ids), "n": np.concatenate(sizes)})

    return docs.select(F.col(text).alias("text")).mapInPandas(run, "shingle long, fp long, n long")


def candidates(index: DataFrame, percent: int, small: int = SMALL) -> DataFrame:
    """Lists, streamed in order: a list of at most `small` texts gives its pairs of fitting sizes `(a, b, na, nb)`;
    a longer one gives `(a, b)` with b its first text and `na` null. A list is never held beyond `small` texts,
    and pairs are handed on after the list that brings them past 20,000, not once a batch."""

    def run(batches):
        key, first, held, last = None, None, [], None
        out: list[tuple] = []

        def close():
            if held and len(held) > 1:
                for (a, na), (b, nb) in combinations(held, 2):
                    if 100 * min(na, nb) >= percent * max(na, nb):
                        out.append((a, b, na, nb) if a < b else (b, a, nb, na))

        def frame():
            rows = pd.DataFrame(out, columns=["a", "b", "na", "nb"]).astype("Int64")
            out.clear()
            return rows

        for batch in batches:
            for s, f, n in zip(batch["shingle"].tolist(), batch["fp"].tolist(), batch["n"].tolist()):
                if s != key:
                    close()
                    if len(out) > 20_000:
                        yield frame()
                    key, first, held, last = s, f, [(f, n)], f
                elif f != last:
                    last = f
                    if held is None:
                        out.append((first, f, None, None))
                        continue
                    held.append((f, n))
                    if len(held) > small:
                        out += [(first, g, None, None) for g, _ in held[1:]]
                        held = None
            if len(out) > 20_000:
                yield frame()
        close()
        if out:
            yield frame()

    return index.repartition("shingle").sortWithinPartitions("shingle", "fp").mapInPandas(run, "a long, b long, na long, nb long")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets: the smaller one probes the larger one."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def block_links(ids: list[int], sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked between two blocks of texts (indexes into `ids`), by DivideSkip.

    The long lists of a query are set aside; its short ones are merged, and what stands in fewer than
    `extra` of them is no candidate. Candidates not yet connected with the query are then looked up in the
    long lists: by binary probes when few, by counting the lists when many.
    """
    root = {i: i for i in {*left, *right}}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    flat = np.concatenate([sets[i] for i in right])
    owner = np.repeat(np.arange(len(right)), [len(sets[i]) for i in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(sets[i]) for i in right])
    same = left == right
    out = []
    for at, q in enumerate(left):
        s = sets[q]
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
        n = len(s)
        length = np.argsort(hi - lo, kind="stable")
        extra = int(_extra(n))
        short, long = length[: n - _needed(n, percent) + extra], length[n - _needed(n, percent) + extra :]
        lists = [owner[lo[i] : hi[i]] for i in short if hi[i] > lo[i]]
        if not lists:
            continue
        hits = np.bincount(np.concatenate(lists), minlength=len(right))
        fits = (hits >= extra) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
        if same:
            fits[: at + 1] = False
        here = [int(c) for c in np.flatnonzero(fits) if top(right[c]) != top(q)]
        if not here:
            continue
        if len(here) > 24:
            rest = [owner[lo[i] : hi[i]] for i in long if hi[i] > lo[i]]
            more = np.bincount(np.concatenate(rest), minlength=len(right)) if rest else np.zeros(len(right), np.int64)
            good = [c for c in here if linked(int(hits[c] + more[c]), n, int(size[c]), percent)]
        else:
            probe = s[long]
            good = [c for c in here if linked(int(hits[c]) + (_overlap(np.sort(probe), sets[right[c]]) if len(probe) else 0), n, int(size[c]), percent)]
        for c in good:
            if top(right[c]) != top(q):
                root[top(right[c])] = top(q)
                out.append((ids[q], ids[right[c]]))
    return out


def _sets(docs: DataFrame, wanted: DataFrame, size: int, doc: str, text: str) -> DataFrame:
    """`(fp, n, shingles)` of the texts in `wanted (doc, tk, fp)`."""
    own = wanted.select(F.col("doc").alias("_d"), "tk", "fp")
    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("_t"), F.col(text).alias("text"))
    rows = rows.join(own, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("tk"))).select("fp", "text")

    def run(batches):
        shingles = Shingler(size)
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            # a repeated id may stand for another text; only the wanted one has this fingerprint
            keep = [len(s) > 0 and _print(s) == f for s, f in zip(sets, b["fp"])]
            sets = [s for s, k in zip(sets, keep) if k]
            yield pd.DataFrame({"fp": b["fp"][keep], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return saved(rows.mapInPandas(run, "fp long, n long, shingles binary").dropDuplicates(["fp"]))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias("s" + c))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for b in batches:
            keep = [linked(_overlap(x := np.frombuffer(p, np.uint64), y := np.frombuffer(q, np.uint64)), len(x), len(y), percent) for p, q in zip(b["sa"], b["sb"])]
            yield b.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def clustered(stars: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links among texts that share long lists, block against block within each cluster of such texts.

    Blocks follow the sizes of the sets, so only blocks of fitting sizes meet; their weights are known from
    counts by size, and no cluster is gathered as a whole.
    """
    of = saved(components(stars).join(sets.withColumnRenamed("fp", "node"), "node").select(F.col("label").alias("cluster"), F.col("node").alias("fp"), "n", "shingles"))
    by = of.groupBy("cluster", "n").agg(F.sum("n").alias("w"))
    by = by.withColumn("base", F.sum("w").over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    spread = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # sets of one size are spread over the blocks that they fill
    placed = saved(of.join(by, ["cluster", "n"]).select("cluster", "fp", "n", "shingles", F.floor((F.col("base") + F.col("w") * spread) / block).alias("block")))
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = (blocks.select("cluster", *[F.col(c).alias(c + k) for c in ("block", "low", "high")]) for k in ("1", "2"))
    meet = x.join(y, "cluster").where((F.col("block1") <= F.col("block2")) & (100 * F.col("high1") >= percent * F.col("low2"))).select("cluster", "block1", "block2")
    ends = meet.select("*", F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    rows = ends.join(placed, ["cluster", "block"])

    def run(key, group):
        _, i, j = key
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        blocks = group["block"].tolist()
        left = [k for k, b in enumerate(blocks) if b == i]
        right = [k for k, b in enumerate(blocks) if b == j]
        got = block_links(group["fp"].tolist(), sets, left, right, percent) if left and right else []
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    return rows.groupBy("cluster", "block1", "block2").applyInPandas(run, "a long, b long")


def linked_components(docs: DataFrame, *, size: int = 4, percent: int = 85, doc: str = "doc_id", text: str = "text", small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: its id, `n_shingles`, `component_id`, `text_key` (hash of the text).

    Two texts are linked when 100 * intersection >= `percent` * union of their distinct `size`-word shingles;
    `component_id` is the smallest id reachable, or the own one. Null texts and texts without words have no
    shingle and are linked with nothing; shorter texts are one shingle. Equal sets are one class and are not
    compared; rows that repeat an id are one document. A null id has a component only through others. The
    smallest id is by the id's own type. `small` and `block` change the way, not the result. Extra columns are ignored.
    """
    rows, sketch = prints(docs, size, doc, text)
    rest = rows.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc", "tk")).alias("_r")).select("fp", "_r.doc", "_r.tk")
    found = saved(candidates(short_lists(docs, sketch, size, percent, text), percent, small))
    extra = lambda c: F.least(F.greatest(F.lit(1), F.floor(F.col(c) / 2)), 1 + F.floor(F.col(c) / 33))
    pairs = saved(found.where("na IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k")).where(F.col("k") >= F.least(extra("na"), extra("nb"))).select("a", "b"))
    stars = saved(found.where("na IS NULL").select("a", "b").distinct())
    some = pairs.union(stars).select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = _sets(docs, some.join(rest, "fp"), size, doc, text)
    links = saved(verified(pairs, sets, percent).union(clustered(stars, sets, percent, block)))
    # by distinct text first; the tables that rows are joined with are saved, so a group of many copies is a
    # skewed join that the engine can split
    of = rest.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", F.coalesce("label", "fp").alias("label"))
    of = saved(of)
    least = saved(of.groupBy("label").agg(F.min("doc").alias("low")))
    lows = saved(of.join(least, "label").select("fp", "low"))
    out = rows.join(lows, "fp", "left")
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.coalesce("low", "doc").alias("component_id"), F.col("tk").alias("text_key"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(reach.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n
"""


@query("op4_jaccard_join", SQL)
def op4(spark, sf_dir):
    return linked_components(table(spark, sf_dir, "documents")).drop("text_key")
