"""Merkle manifest of a dataset: a tree per source, one over the sources, and a proof for every document.

Leaves are dealt in partitions of 16^3 neighbours of one source. Proofs follow the octopus scheme: a leaf
partition computes which nodes its documents need and cannot derive themselves, fetches each of these once,
derives all interior nodes that its documents share, and writes the single proofs out from that.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import lower_ascii, saved
from cuewise.llm.registry import query, table

#: Children of a node, levels that one task builds at once, and leaves of a partition.
WIDTH, TIER = 16, 3
PART = WIDTH**TIER
#: Tree over the sources; the tree of a source has its rank, from 0 on.
TOP = -1
#: Nodes of a level that may be broadcast (a node takes about 60 bytes).
SMALL = 1 << 16


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """SHA-256, as hex, of the fields: `-` for null, else number of UTF-8 bytes, `:` and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def parents(run: list[str]) -> list[str]:
    """Nodes over neighbours of which the first starts a run."""
    return [digest("".join(run[i : i + WIDTH])) for i in range(0, len(run), WIDTH)]


def missing(size: int, first: int, end: int) -> list[tuple[int, int]]:
    """`(level, index)` of the nodes that leaves `first` to `end` of a tree of `size` leaves need beside what they
    derive themselves: at each level, the rest of the runs that their own nodes begin or end in."""
    out, level = [], 0
    while size > 1:
        low, high = first // WIDTH * WIDTH, min(size, -(-end // WIDTH) * WIDTH)
        out += [(level, i) for i in (*range(low, first), *range(end, high))]
        first, end, size, level = first // WIDTH, -(-end // WIDTH), -(-size // WIDTH), level + 1
    return out


def climbed(tree: int, size: int, first: int, own: list[str], fetched: dict) -> tuple[list[tuple[int, list[str]]], str]:
    """Per level, the index of the first node at hand and the whole runs from there on; and the root."""
    levels, level = [], 0
    while size > 1:
        low, end = first // WIDTH * WIDTH, first + len(own)
        high = min(size, -(-end // WIDTH) * WIDTH)
        at_hand = [fetched[tree, level, i] for i in range(low, first)] + own + [fetched[tree, level, i] for i in range(end, high)]
        levels.append((low, at_hand))
        first, own, size, level = low // WIDTH, parents(at_hand), -(-size // WIDTH), level + 1
    return levels, own[0]


def placed(docs: DataFrame, doc: Column, source: Column, leaf: Column, other: Column) -> DataFrame:
    """`tree, src, size, pos, doc, leaf, other`: the place of each document in the tree of its source.

    One sort over all documents by source, id and leaf, cut by ranges, so a large source spreads over many tasks;
    places are counted in each range and shifted by the sums of the ranges before (one row per source and range).
    """
    rows = docs.select(source.cast("string").alias("src"), doc.alias("doc"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("other"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["src", "doc", "leaf"]
    rows = saved(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    spans = rows.groupBy("src", "range").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("src", "range", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    trees = rows.groupBy("src").agg(F.count("*").alias("size")).withColumn("tree", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_first())) - 1)
    spans = spans.join(trees.withColumnRenamed("src", "_src"), F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    spans = spans.withColumnsRenamed({"src": "_src", "range": "_range"})
    out = rows.join(spans, F.col("src").eqNullSafe(F.col("_src")) & (F.col("range") == F.col("_range")))
    return saved(out.select("tree", "src", "size", (F.col("at") + F.col("shift")).alias("pos"), "doc", "leaf", "other"))


def nodes(leaves: DataFrame) -> DataFrame:
    """`tree, level, at, node, root`: nodes of all trees from the level over a leaf partition on, and every root.
    `leaves (tree, size, pos, leaf)`.

    A task builds `TIER` levels over `PART` neighbours; the highest of these are the leaves of the next round, so
    there are three rounds for 10^10 documents, each over a 4,096th of the rows before.
    """

    def lift(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        tree, size, first, base = (rows.column(c)[0].as_py() for c in ("tree", "size", "pos", "level"))
        now, out = [x.hex() for x in rows.column("leaf").to_pylist()], []
        if size == 1 and base == 0:
            out.append((0, 0, now[0], True))
        for level in range(base + 1, base + TIER + 1):
            if size == 1:
                break
            now, first, size = parents(now), first // WIDTH, -(-size // WIDTH)
            if level >= TIER or size == 1:
                out += [(level, first + i, x, size == 1) for i, x in enumerate(now)]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table({
            "tree": pa.array([tree] * len(out), pa.int32()), "size": pa.array([size] * len(out), pa.int64()), "level": pa.array(cols[0], pa.int32()),
            "at": pa.array(cols[1], pa.int64()), "node": pa.array([bytes.fromhex(x) for x in cols[2]], pa.binary()), "root": pa.array(cols[3], pa.bool_())})

    rounds, now, base = [], leaves.select("tree", "size", "pos", "leaf"), 0
    while True:
        part = F.floor(F.col("pos") / PART)
        made = now.withColumn("level", F.lit(base)).groupBy("tree", part.alias("part")).applyInArrow(lift, "tree int, size long, level int, at long, node binary, root boolean")
        rounds.append(saved(made))
        base += TIER
        now = rounds[-1].where((F.col("level") == base) & ~F.col("root")).select("tree", "size", F.col("at").alias("pos"), F.col("node").alias("leaf"))
        if now.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out.select("tree", "level", "at", "node", "root")


def fetched(leaves: DataFrame, all_nodes: DataFrame, sources: int) -> DataFrame:
    """`tree, part, nodes`: per leaf partition, each node that it needs and cannot derive, once.

    Levels of few nodes, which every partition asks for, are broadcast up to a stated number of nodes; a node
    of the others is asked for by the partitions below its run only.
    """

    def ask(batches):
        for b in batches:
            out = []
            for tree, size, part in zip(*(b.column(c).to_pylist() for c in ("tree", "size", "part"))):
                wanted = [(tree, *x) for x in missing(size, part * PART, min(size, (part + 1) * PART))] + [(TOP, *x) for x in missing(sources, tree, tree + 1)]
                out += [(tree, part, *x) for x in wanted]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["tree", "part", "of", "level", "at"])

    parts = leaves.where(F.col("pos") % PART == 0).select("tree", "size", F.floor(F.col("pos") / PART).alias("part"))
    wanted = parts.mapInArrow(ask, "tree int, part long, of int, level int, at long")
    rows = all_nodes.select(F.col("tree").alias("of"), "level", "at", "node")
    top = F.col("of") == TOP
    few = [(r["top"], r["level"]) for r in rows.groupBy(top.alias("top"), "level").count().where(F.col("count") <= SMALL // 16).collect()]
    small = F.lit(False)
    for is_top, level in few:
        small = small | ((top == F.lit(is_top)) & (F.col("level") == level))
    keys = ["of", "level", "at"]
    hit = wanted.where(small).join(F.broadcast(rows.where(small)), keys).union(wanted.where(~small).join(rows.where(~small), keys))
    return hit.select("tree", "part", *keys, "node")


def manifest(docs: DataFrame, fields: list[str], *, changed: dict[str, Column] | None = None, when: Column | None = None, doc: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of `docs`: `doc_id, source, pos, leaf, subroot, root, proof_sha256, folded_root, verified`.

    A leaf is the digest of `fields`. Where `when` holds, `folded_root` starts from the leaf with the columns in
    `changed` put in their place, else from the own leaf, and it climbs with the original siblings;
    `verified` says that it reaches the root. `proof_sha256` is the digest of all siblings, lowest level first.

    Null fields count as `-`, empty and very long texts by their whole value. A null id comes first in its source,
    a null source first among the sources, apart from the empty one. Equal ids are ordered by their leaves, and rows equal in
    all fields have neighbouring leaves of the same value. A lone document is its source's subroot, a lone
    source's subroot the root; its proof has no siblings. An empty table gives no rows. Columns that are no fields are not
    read, whatever their names.
    """
    plain = leaf(*[F.col(f"`{c}`") for c in fields])
    other = leaf(*[(changed or {}).get(c, F.col(f"`{c}`")) for c in fields])
    leaves = placed(docs, F.col(f"`{doc}`"), F.col(f"`{source}`"), plain, F.when(F.lit(False) if when is None else when, other))
    own = nodes(leaves)
    subroots = saved(own.where("root").select("tree", "node"))
    sources = subroots.count()
    top = subroots.select(F.lit(TOP).alias("tree"), F.lit(sources).cast("long").alias("size"), F.col("tree").cast("long").alias("pos"), F.col("node").alias("leaf"))
    over = nodes(top)
    # the levels that `nodes` doesn't write, rebuilt from the few subroots of each run
    low = subroots.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("tree").cast("long").alias("at"), "node")
    rows = own.where(f"level >= {TIER}").drop("root").union(low)
    for level in range(1, TIER):
        low = _over(low, level)
        rows = rows.union(low)
    rows = rows.union(over.where(f"level >= {TIER}").drop("root"))
    root = over.where("root").select(F.hex("node")).first()
    root = root[0].lower() if root else ""
    need = fetched(leaves, saved(rows), sources)

    def expand(key, rows: pa.Table, more: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        tree, size, first = (rows.column(c)[0].as_py() for c in ("tree", "size", "pos"))
        at_hand = {(r["of"], r["level"], r["at"]): r["node"].hex() for r in more.to_pylist()}
        leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
        inner, subroot = climbed(tree, size, first, leaves, at_hand)
        outer, top = climbed(TOP, sources, tree, [subroot], at_hand)
        proofs, folded = [], []
        for k, changed in enumerate(rows.column("other").to_pylist()):
            siblings, x = sha256(), changed and changed.hex()
            for levels, i in ((inner, first + k), (outer, tree)):
                for low, nodes in levels:
                    run = (i - low) // WIDTH * WIDTH
                    before, after = "".join(nodes[run : i - low]), "".join(nodes[i - low + 1 : run + WIDTH])
                    siblings.update((before + after).encode())
                    if x:
                        x = digest(before + x + after)
                    i //= WIDTH
            proofs.append(siblings.hexdigest())
            folded.append(x or top)  # an unchanged leaf folds to the root over the interiors above
        n = len(leaves)
        out = {"leaf": pa.array(leaves), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)}
        return pa.table({"doc": rows.column("doc"), "src": rows.column("src"), "pos": rows.column("pos"), **out})

    part = F.floor(F.col("pos") / PART).alias("part")
    both = leaves.groupBy("tree", part).cogroup(need.groupBy("tree", "part"))
    schema = leaves.select("doc", "src", "pos").schema
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(c, "string")
    out = both.applyInArrow(expand, schema).withColumnsRenamed({"doc": "doc_id", "src": "source"})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _over(low: DataFrame, level: int) -> DataFrame:
    """The next level of the tree over the sources; none over a root."""
    runs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: F.lower(F.hex(x["node"]))), "")
    made = low.groupBy("tree", F.floor(F.col("at") / WIDTH).alias("_at")).agg(F.unhex(F.sha2(runs, 256)).alias("node"))
    return made.select("tree", F.lit(level).alias("level"), F.col("_at").alias("at"), "node")


def tampered(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> tuple[dict[str, Column], Column]:
    """The change of the registered query: A-Z of the text lower-cased, where 5 divides the checksum of the id."""
    return {text: lower_ascii(F.col(text))}, F.crc32(F.col(doc).cast("string").cast("binary")) % 5 == 0


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sql(levels: int = 6) -> str:
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"
    changed = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digest = lambda text: "sha256(" + " || ".join(value(c) for c in FIELDS[:-1] + [text]) + ")"

    def tree(name: str) -> list[str]:
        """Nodes of each level with what stands before and after them in their run."""
        out = []
        for k in range(levels):
            run = f"OVER (PARTITION BY s, i // {WIDTH} ORDER BY i ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT s, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT s, i // {WIDTH} AS i, any_value((n + {WIDTH - 1}) // {WIDTH}) AS n, CASE WHEN any_value(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY s, i // {WIDTH})")
        return out

    def climb(name: str, start: str, prefix: str) -> list[str]:
        out, i = [], "i"
        for k in range(levels):
            out.append(f"{prefix}{k + 1} AS (SELECT c.* REPLACE (c.i // {WIDTH} AS i, CASE WHEN t.n = 1 THEN c.x ELSE sha256(t.b || c.x || t.a) END AS x, c.p || t.b || t.a AS p) FROM {start if k == 0 else f'{prefix}{k}'} c JOIN {name}s{k} t USING (s, i))")
        return out

    parts = [
        f"d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, {digest('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {digest(changed)} ELSE {digest('text')} END AS x FROM documents)",
        "e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM d)",
        "t0 AS (SELECT src AS s, i, n, leaf AS h FROM e)", *tree("t"),
        f"u0 AS (SELECT 0 AS s, s AS i, count(*) OVER () AS n, h FROM t{levels})", *tree("u"),
        "c0 AS (SELECT doc_id, leaf, src, src AS s, i, x, '' AS p FROM e)", *climb("t", "c0", "c"),
        f"v0 AS (SELECT doc_id, leaf, src, 0 AS s, src AS i, x, p FROM c{levels})", *climb("u", "v0", "v"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(v.p) AS proof_sha256, v.x AS folded_root, v.x = u.h AS verified FROM v{levels} v JOIN t{levels} t ON t.s = v.src, u{levels} u"


@query("op13_merkle_manifest", _sql())
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed, when = tampered(docs)
    return manifest(docs, FIELDS, changed=changed, when=when).drop("source", "pos")
