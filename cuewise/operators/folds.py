"""Row-to-row state over ordered groups of any length.

A fold runs over sorted partitions, block by block (see `ordered`). Where every
group fits one block it is a single pass. A longer group is folded speculatively: all blocks
run at once from a guessed start state, each block's end state becomes the
guess for the next block, and only blocks whose guess changed run again. At the
fixed point every block has its true start state, so the result is exact. Rules
that forget (a gap, a full window) settle in two or three rounds whatever the
length of the group; the number of rounds never exceeds the number of blocks.

A step is `step(state, rows, last) -> (out, state)` over plain tuples, with
`last` true on the closing call of a group's last block. States are JSON values of bounded
size; each step says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.operators.ordered import BLOCK
from cuewise.session import checkpointed


def _run(step: Callable, inputs: list[str], keys: list[str], columns: list[str], probe: bool):
    """Task function over rows sorted by key, block and order: state lives across Arrow batches, so
    neither a group nor a block is ever held whole."""
    part = [*keys, BLOCK]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last = None, None, False

        def close(found: list) -> None:
            out, end = step(state, [], last)
            found += [(*current[:-1], *row) for row in out]
            if probe:
                ends.append((*current, json.dumps(end)))

        for pdf in batches:
            found, ends = [], []
            starts = (pdf[part] != pdf[part].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            rows = list(zip(*[pdf[c].tolist() for c in inputs]))
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                first = pdf.iloc[lo]
                key = tuple(None if first[c] is None or first[c] != first[c] else first[c] for c in part)
                if key != current:
                    if current is not None:
                        close(found)
                    current, last = key, bool(first["_last"])
                    state = json.loads(first["_state"]) if first["_state"] is not None else None
                out, state = step(state, rows[lo:hi], False)
                found += [(*key[:-1], *row) for row in out]
            yield pd.DataFrame(ends, columns=[*part, "_end"]) if probe else pd.DataFrame(found, columns=[*keys, *columns])
        if current is not None:
            found, ends = [], []
            close(found)
            yield pd.DataFrame(ends, columns=[*part, "_end"]) if probe else pd.DataFrame(found, columns=[*keys, *columns])

    return apply


def _staged(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], columns: list[str], step: Callable, out: str, probe: bool = False) -> DataFrame:
    """Sort rows (with block, `_state` and `_last`) and stream them through `step`.

    The number of partitions is the session's own setting, stated outright: these stages are bound by
    Python time, not by bytes, so small partitions must not be merged for their size.
    """
    part = [*keys, BLOCK]
    types = dict(rows.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(n, *part).sortWithinPartitions(*part, *order)
    schema = f"{key_schema}, {BLOCK} {types[BLOCK]}, _end string" if probe else f"{key_schema}, {out}"
    return sorted_rows.mapInPandas(_run(step, inputs, keys, columns, probe), schema)


def grouped(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], fn: Callable, out: str) -> DataFrame:
    """`fn(rows) -> out` per group, for groups with a proven bound (chapters of a video, tokens of a frame)."""

    columns = [c.strip().split(" ")[0] for c in out.split(",")]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            found = []
            first = np.arange(len(pdf)) == 0
            for c in keys:
                first[1:] |= pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]
            starts = first.nonzero()[0].tolist()
            heads = zip(*[pdf[c].iloc[starts].tolist() for c in keys])
            rows = list(zip(*[pdf[c].tolist() for c in inputs]))
            for head, lo, hi in zip(heads, starts, [*starts[1:], len(pdf)]):
                now = tuple(None if v is None or v != v else v for v in head)
                if held and now != key:
                    found += [(*key, *row) for row in fn(held)]
                    held = []
                key = now
                held += rows[lo:hi]
            yield pd.DataFrame(found, columns=[*keys, *columns])
        if held:
            yield pd.DataFrame([(*key, *row) for row in fn(held)], columns=[*keys, *columns])

    types = dict(df.dtypes)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*dict.fromkeys([*keys, *order, *inputs])).repartition(n, *keys).sortWithinPartitions(*keys, *order)
    return rows.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(apply, ", ".join([*[f"{k} {types[k]}" for k in keys], out]))


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, out: str) -> DataFrame:
    """Apply `step` along each group of `df` (which carries the block column).

    `out` is the schema of the rows the step returns; keys are added in front. `step` is called
    once per batch of rows and, at the end of a block, once without rows.
    """
    part = [*keys, BLOCK]
    columns = [c.strip().split(" ")[0] for c in out.split(",")]
    rows = df.select(*part, *[c for c in dict.fromkeys([*order, *inputs]) if c not in part])

    def run(staged: DataFrame, probe: bool) -> DataFrame:
        return _staged(staged, keys, order, inputs, columns, step, out, probe)

    # distinct lets the optimizer drop joins that only add columns
    if rows.where(F.col(BLOCK) > 0).select(BLOCK).distinct().isEmpty():
        return run(rows.withColumn("_state", F.lit(None).cast("string")).withColumn("_last", F.lit(True)), False)

    w = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks = rows.select(*part).distinct().select(*part, F.lead(BLOCK).over(w).isNull().alias("_last"))
    # one row per block from here on
    empty = F.lit(None).cast("string")
    table = checkpointed(blocks.withColumn("_state", empty).withColumn("_end", empty).withColumn("_todo", F.lit(True)))
    while not table.where("_todo").isEmpty():
        todo = table.where("_todo").select(*part, "_last", "_state")
        ends = run(rows.join(todo, part), True).withColumnRenamed("_end", "_new")
        merged = table.drop("_todo").join(ends, part, "left").withColumn("_end", F.coalesce("_new", "_end")).drop("_new")
        table = checkpointed(merged.withColumn("_guess", F.lag("_end").over(w)).withColumn("_todo", ~F.col("_guess").eqNullSafe(F.col("_state")))
                             .withColumn("_state", F.col("_guess")).drop("_guess"))
    return run(rows.join(table.select(*part, "_last", "_state"), part), False)


def runs(df: DataFrame, keys: list[str], order: list[str], row_id: str, inputs: list[str], rule: Callable, keep: list[str] | None = None) -> DataFrame:
    """Rows with the id of the row that opened their run: keys, `row_id`, `run` and the columns in `keep`.

    `rule(state, row) -> (opens, state)`; state is None before the first row. A rule that
    closes a run after a row returns state None.
    """
    keep = keep or []
    types = dict(df.dtypes)
    n = len(inputs)

    def step(state, rows, last):
        opener, inner = state if state else (None, None)
        out = []
        for row in rows:
            opens, inner = rule(inner, row[1:n + 1])
            if opens:
                opener = row[0]
            out.append((row[0], opener, *row[n + 1:]))
        return out, [opener, inner]

    schema = ", ".join([f"{row_id} {types[row_id]}", f"run {types[row_id]}", *[f"{c} {types[c]}" for c in keep]])
    return fold(df, keys, order, [row_id, *inputs, *keep], step, schema)


# ---- rules; every state is a few numbers unless it says otherwise ----

def smart_merge(max_gap: float = 1.2, longest: float = 90.0, target: float = 45.0) -> Callable:
    """Rows `(start, end, ends_sentence, blank)`. Breaks on a gap or when too long; closes at the
    target length on a sentence end. The opening row itself is never tested for closing."""

    def rule(state, row):
        start, end, mark, blank = row
        if state is None or start - state[1] > max_gap or end - state[0] > longest:
            return True, [start, end, bool(mark)]
        ended = state[2] if blank else bool(mark)
        if end - state[0] >= target and ended:
            return False, None
        return False, [state[0], end, ended]

    return rule


def packing(span: float) -> Callable:
    """Rows `(start, end)`: a run grows while its end stays within `span` of its start."""
    return lambda s, r: (False, s) if s is not None and r[1] - s <= span else (True, r[0])


def fixed_blocks_rule(span: float) -> Callable:
    """Rows `(start, end)`: a run closes after the row that reaches `span`."""

    def rule(state, row):
        start = row[0] if state is None else state
        return state is None, None if row[1] - start >= span else start

    return rule


def anchored(span: float) -> Callable:
    """Rows `(start,)`: a new run starts at the first row `span` or more after the run's start."""
    return lambda s, r: (False, s) if s is not None and r[0] - s < span else (True, r[0])


def forced(span: float) -> Callable:
    """Rows `(start, end)`: a row whose end is `span` or more after the run's start opens a new run."""
    return lambda s, r: (False, s) if s is not None and r[1] - s < span else (True, r[0])


def keyword_shift(threshold: float = 0.2) -> Callable:
    """Rows `(pos, n, back)`: a row's place, its number of keywords, and the places where its keywords stood last before.

    Opens on low Jaccard with all keywords of the run so far (two empty sets score 0). A keyword belongs to the run
    if its last place is not before the run's start, so the start and the number of different
    keywords are all that is carried.
    """

    def rule(state, row):
        pos, n, back = row
        if state is not None:
            start, size = state
            shared = sum(1 for p in back if p >= start)
            if (shared / (size + n - shared) if size + n > shared else 0.0) >= threshold:
                return False, [start, size + n - shared]
        return True, [pos, n]

    return rule


def with_last_places(rows: DataFrame, keys: list[str], pos: str, words: str) -> DataFrame:
    """Adds `n`, the different words at a row's place, and `back`, the last place before of each that has one.

    The rows are shuffled once and streamed in order; what is held is the last place of each of a group's words.
    """
    others = [c for c in rows.columns if c not in (*keys, pos, words)]

    def step(state, batch, last):
        places, held = state or ({}, [])
        out = []

        def close():
            # rows of one place count together
            n, back = 0, []
            for row in held:
                for w in set(() if row[1] is None else row[1]):
                    if w in places:
                        back.append(places[w])
                    places[w] = row[0]
                    n += 1
            out.extend((*row, n, back) for row in held)

        for row in batch:
            if held and held[0][0] != row[0]:
                close()
                held = []
            held.append(row)
        if last:
            close()
        return out, (places, held)

    types = dict(rows.dtypes)
    columns = [pos, words, *others]
    staged = rows.withColumn(BLOCK, F.lit(0)).withColumn("_state", F.lit(None).cast("string")).withColumn("_last", F.lit(True))
    out = ", ".join([*[f"{c} {types[c]}" for c in columns], "n long", f"back array<{types[pos]}>"])
    found = _staged(staged, keys, [pos], columns, [*columns, "n", "back"], step, out)
    return found.select(*rows.columns, "n", "back")


def similar_text(threshold: float = 0.7) -> Callable:
    """Rows `(tokens,)`, the token set of a block: joins while similar to the block that opened the
    run. The state is that block's token set."""

    def rule(state, row):
        words = set(row[0]) if row[0] is not None else set()
        if state is not None:
            seen = set(state)
            if len(seen & words) / (len(seen | words) or 1) > threshold:
                return False, state
        return True, sorted(words)

    return rule


def midpoint_step(min_distance: float = 1.0) -> Callable:
    """Rows `(t,)`: a stamp closer than `min_distance` to the last output replaces it by the mean."""

    def step(state, rows, last):
        out = []
        for (t,) in rows:
            if state is not None and t - state < min_distance:
                state = (state + t) / 2
            else:
                if state is not None:
                    out.append((state,))
                state = t
        if last and state is not None:
            out.append((state,))
        return out, state

    return step


def chunk_step(most: int = 600, carry: int = 50) -> Callable:
    """Rows `(pos, tokens, *rest)` of non-blank texts: `(pos, chunk, carried, *rest)`. A chunk is flushed
    before it would exceed `most` tokens; whole texts from its end go along while they sum to `carry`
    at most. The state is the running sum and the short tail of rows that may be carried."""

    def step(state, rows, last):
        chunk, total, tail, filled = state if state else (0, 0, [], False)
        out = []
        for row in rows:
            tok = row[1]
            if total + tok > most and filled:
                chunk += 1
                kept, total = [], 0
                for r in reversed(tail):
                    if total + r[1] > carry:
                        break
                    kept.insert(0, r)
                    total += r[1]
                out += [(r[0], chunk, True, *r[2:]) for r in kept]
                tail = kept
            out.append((row[0], chunk, False, *row[2:]))
            tail.append(list(row))
            total += tok
            filled = True
            while len(tail) > 1 and sum(r[1] for r in tail[1:]) > carry:
                tail.pop(0)
        return out, [chunk, total, tail, filled]

    return step


def gate_step(spacing: float, interval: float, bits: int = 5, same: float = 0.9) -> Callable:
    """Rows `(pos, t, ok, hash, vec)`: selected when far enough in time, good, different in hash from
    the last selected one, and either changed in content or `interval` later. The state is the last
    selected time, hash and vector."""

    def step(state, rows, last):
        out = []
        for pos, t, ok, h, vec in rows:
            if state is not None:
                t0, h0, v0 = state
                if t - t0 < spacing or not ok or sum(a != b for a, b in zip(h, h0)) < bits:
                    continue
                dot = sum(a * b for a, b in zip(vec, v0))
                norm = (sum(a * a for a in vec) * sum(b * b for b in v0)) ** 0.5
                if (dot / norm if norm else 0.0) >= same and t - t0 < interval:
                    continue
            elif not ok:
                continue
            state = [t, h, [float(x) for x in vec]]
            out.append((pos,))
        return out, state

    return step


def admission_step(limit: int = 30, window: float = 60.0) -> Callable:
    """Rows `(id, t)`: fixed window from the first request after expiry; a request exactly at the end
    still belongs to the old window; denied requests do not count."""

    def step(state, rows, last):
        count, reset = state if state else (0, None)
        out = []
        for i, t in rows:
            if reset is None or t > reset:
                count, reset = 0, t + window
            if count >= limit:
                out.append((i, False, 0, reset))
            else:
                count += 1
                out.append((i, True, limit - count, reset))
        return out, [count, reset]

    return step
