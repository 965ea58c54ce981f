"""Near-duplicate lines of a video."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.blocks import alike, char_counts, within_edits
from cuewise.operators.folds import fold
from cuewise.operators.ordered import fixed_blocks
from cuewise.session import checkpointed


#: Base of the piece hashes, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashes(text: str, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each piece of `size` characters from `at` on, from one pass over the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * _powers(_BASE, len(points)))])
    h = (sums[at + size] - sums[at]) * _powers(_BACK, len(points))[at] + size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


#: Lines and characters of a group up to which every two of its lines are compared; pairs that one step compares, and that
#: are looked at whole together; lines of a group that are settled together.
FEW_LINES, FEW_CHARS, PAIRS, WHOLE, AT_ONCE = 1 << 13, 1 << 22, 1 << 14, 1 << 12, 1 << 8


class _Cut:
    """Where lines are cut into pieces, for one cutoff."""

    def __init__(self, cutoff: float):
        self.cutoff, self.extra = cutoff, (1 - cutoff) * 2 / cutoff

    def number(self, n):
        return np.floor(n * self.extra + 1e-9).astype(np.int64) + 1

    def own(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the pieces of a line of `n` characters."""
        many = int(self.number(np.int64(n)))
        ends = np.arange(many + 1) * n // many
        return ends[:-1], np.diff(ends)

    @cache
    def sizes(self, n: int) -> np.ndarray:
        """Sizes that a piece of any line within the band of `n` can have."""
        low, high = max(1, int(np.ceil(n * self.cutoff / (2 - self.cutoff) - 1e-9))), int(np.floor(n * (2 - self.cutoff) / self.cutoff + 1e-9))
        lengths = np.arange(low, high + 1)
        many = self.number(lengths)
        return np.unique(np.concatenate([lengths // many, -(-lengths // many)]))

    def every(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Every start of a piece of every such size."""
        sizes = [k for k in self.sizes(n).tolist() if k <= n]
        return np.concatenate([np.arange(n - k + 1) for k in sizes]), np.repeat(sizes, [n - k + 1 for k in sizes])


def _pieces(lines: DataFrame, keep: list[str], cut: _Cut, every: bool) -> DataFrame:
    """`keep` columns, `n`, and of each piece of a line its start `at` and its hash `h`."""

    def run(batches):
        for b in batches:
            found = [(t, *(cut.every if every else cut.own)(len(t))) for t in b["text"]]
            many = [len(at) for _, at, _ in found]
            out = b[keep].loc[b.index.repeat(many)].reset_index(drop=True)
            none = [np.zeros(0, np.int64)]
            yield out.assign(n=np.repeat([len(t) for t, _, _ in found], many).astype(np.int64), at=np.concatenate([at for _, at, _ in found] + none),
                             h=np.concatenate([_hashes(t, at, size) for t, at, size in found] + none))

    return lines.select(*keep, "text").mapInPandas(run, lines.select(*keep).schema.add("n", "long").add("at", "long").add("h", "long"))


def _long(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the groups that are not held: at most rows / `FEW_LINES` and characters / `FEW_CHARS`."""
    size = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("text")).alias("_chars"))
    return size.where((F.col("_n") > FEW_LINES) | (F.col("_chars") > FEW_CHARS)).select(*keys)


def _together(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One shuffle, after which the rows of a group follow each other."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(n, *keys).sortWithinPartitions(*keys)


def _whole(batches, keys: list[str]):
    """Rows of groups that follow each other, in frames that hold whole groups."""
    held = None
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        open_ = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
        held = b[open_]
        if not open_.all():
            yield b[~open_].reset_index(drop=True)
    if held is not None:
        yield held.reset_index(drop=True)


def _number(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """A number for each different value of `keys`, in the order in which they come."""
    return frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()


def _met(texts: np.ndarray, group: np.ndarray, reach, least, new: np.ndarray | None = None):
    """Pairs of row numbers of one group, each pair once, step by step: a text of `n` characters meets longer ones of up to
    `reach(n)`, and `least(n, m)` characters must stand in both. With `new`, only pairs with such a row."""
    n = np.array([len(t) for t in texts], np.int64)
    order = np.lexsort((n, group)).astype(np.int32)
    group, n, far = group[order], n[order], reach(n[order])
    new = np.ones(len(n), bool) if new is None else new[order]
    width = int(far.max(initial=0)) + 1
    start = np.arange(len(n)) + 1
    end = np.searchsorted(group * width + n, group * width + far, "right")
    # a row meets all that follow, or the new ones among them, which stand behind all in `to`
    fresh = np.flatnonzero(new)
    to = np.concatenate([np.arange(len(n)), fresh])
    start, end = (np.where(new, at, len(n) + np.searchsorted(fresh, at)) for at in (start, end))
    many = end - start
    used, row = np.zeros(len(n), bool), np.flatnonzero(many)
    steps = np.zeros(len(to) + 1, np.int64)
    np.add.at(steps, start[row], 1)
    np.add.at(steps, end[row], -1)
    used[to[np.cumsum(steps)[:-1] > 0]] = True
    used[row] = True
    counts, at = char_counts(texts[order[used]]).astype(np.int32), np.cumsum(used) - 1
    ends, low = np.cumsum(many), 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        x = np.repeat(np.arange(low, high), many[low:high])
        y = to[start[x] + np.arange(len(x)) - np.repeat(ends[low:high] - many[low:high] - (ends[low - 1] if low else 0), many[low:high])]
        near = np.minimum(counts[at[x]], counts[at[y]]).sum(axis=1) >= least(n[x], n[y])
        yield order[x[near]], order[y[near]]
        low = high


def _by_ratio(cutoff: float) -> dict:
    """For `_met`: what a ratio of `cutoff` needs."""
    return {"reach": lambda n: np.floor(n * (2 - cutoff) / cutoff + 1e-6).astype(np.int64), "least": lambda n, m: cutoff / 2 * (n + m) - 1e-9}


def _within(frame: pd.DataFrame, keys: list[str], cutoff: float):
    """Ordered pairs of row numbers of equal keys (sorted) whose length and character counts allow the ratio, step by step."""
    for x, y in _met(frame["text"].to_numpy(object), _number(frame, keys), **_by_ratio(cutoff)):
        yield np.concatenate([x, y]), np.concatenate([y, x])


def _met_within(lines: DataFrame, keys: list[str], rest: list[str], cutoff: float) -> DataFrame:
    """Pairs `(video_id, rest_x.., rest_y.., tx, ty)` inside groups of at most `FEW_LINES` lines: one shuffle of the lines,
    then one group at a time is held."""
    names = [(c, f"{c}_{s}") for s in "xy" for c in rest] + [("text", "tx"), ("text", "ty")]

    def run(batches):
        for frame in _whole(batches, keys):
            for x, y in _within(frame, keys, cutoff):
                for low in range(0, len(x), WHOLE):
                    i, j = x[low : low + WHOLE], y[low : low + WHOLE]
                    out = {"video_id": frame["video_id"].to_numpy()[i]}
                    yield pd.DataFrame(out | {name: frame[c].to_numpy()[i if name.endswith("x") else j] for c, name in names})

    types = dict(lines.dtypes)
    schema = ", ".join(["video_id " + types["video_id"], *[f"{name} {types[c]}" for c, name in names]])
    return _together(lines.select(*keys, *rest, "text"), keys).mapInPandas(run, schema)


def _go(texts: np.ndarray, group: np.ndarray, node: np.ndarray, rank: np.ndarray, cutoff: float, nodes: int) -> np.ndarray:
    """Which of `nodes` lines go: those like an earlier line of the group (by `rank`) that stays, in the rounds of `repeats`.
    `AT_ONCE` lines of a group at a time meet each other and what stayed before them; a pair is looked at whole once the
    earlier line stays."""
    known = np.array([bool(t) for t in texts], bool)
    texts, group, node, rank = texts[known], group[known], node[known], rank[known]
    order = np.lexsort((rank, group))
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    part = np.zeros(len(order), np.int64)
    part[order] = (np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))) // AT_ONCE
    gone = np.zeros(nodes, bool)
    for k in range(part.max(initial=-1) + 1):
        rows = np.flatnonzero((part <= k) & np.isin(group, group[part == k]) & ~gone[node])
        found = [(np.zeros(0, np.int32),) * 2]
        for i, j in _met(texts[rows], group[rows], **_by_ratio(cutoff), new=part[rows] == k):
            i, j = rows[i].astype(np.int32), rows[j].astype(np.int32)
            later = rank[i] > rank[j]
            x, y = np.where(later, i, j), np.where(later, j, i)
            found.append((x[rank[x] > rank[y]], y[rank[x] > rank[y]]))
        _settle(texts, node, *(np.concatenate(side) for side in zip(*found)), cutoff, gone)
    return gone


def _settle(texts: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray, cutoff: float, gone: np.ndarray) -> None:
    while len(x):
        open_ = np.zeros(len(gone), bool)
        open_[node[x]] = True
        ready = ~open_[node[y]]
        if not ready.any():
            break
        i, j = x[ready], y[ready]
        for low in range(0, len(i), WHOLE):
            k = slice(low, low + WHOLE)
            gone[node[i[k][alike(texts[i[k]], texts[j[k]], cutoff, counted=True)]]] = True
        left = ~ready & ~gone[node[x]] & ~gone[node[y]]
        x, y = x[left], y[left]


def _deduped(frame: pd.DataFrame, within: float, across: float, most_lines: int | None) -> pd.DataFrame:
    """Both steps of `dedup_lines` over whole videos `(video_id, window_no, line_no, text, low)`."""
    frame = frame.sort_values("line_no", kind="stable")
    frame = frame.assign(_v=_number(frame, ["video_id"]), _w=_number(frame, ["video_id", "window_no"]), _k=_number(frame, ["video_id", "line_no"]))
    nodes = len(frame)
    small = np.ones(len(frame), bool) if most_lines is None else np.bincount(frame["_w"])[frame["_w"]] <= most_lines
    first = frame[small].drop_duplicates(["_w", "low"])
    stays = np.zeros(nodes, bool)
    stays[first["_k"]] = True
    stays &= ~_go(first["low"].to_numpy(object), first["_w"].to_numpy(), first["_k"].to_numpy(), first["line_no"].to_numpy(), within, nodes)
    kept = frame[~small | stays[frame["_k"]]].sort_values(["window_no", "line_no"], kind="stable")
    texts = kept.drop_duplicates(["_v", "text"])
    gone = _go(texts["text"].to_numpy(object), texts["_v"].to_numpy(), texts["_k"].to_numpy(), texts["window_no"].to_numpy(), across, nodes)
    fresh = texts[~gone[texts["_k"]]][["_v", "text", "window_no"]].dropna()
    return kept.merge(fresh, on=["_v", "text", "window_no"])[["video_id", "line_no", "text"]]


def similar_pairs(lines: DataFrame, keys: list[str], cutoff: float, before: Column) -> DataFrame:
    """`(video_id, x, y)`: lines `y` before `x` (their `line_no`) whose block ratio with `x` reaches `cutoff`.

    `lines (keys.., line_no, text)`, `line_no` and any further column whole numbers without null; `before`
    relates the two sides, with `_x` and `_y` after the names. Groups of at most `FEW_LINES` lines and `FEW_CHARS` characters
    are shuffled once and compared whole, by length and character counts first. In longer ones lines meet on pieces, two to three rows a character:
    with a ratio of at least t, the characters of both that stand
    outside the blocks are at most (1 - t) of all, and the longer line is at most 2 / t - 1 times the other.
    So of one piece more than that, one piece of `y` is found whole in `x`, moved by no more than that. Pairs meet on
    the hash of such a piece, within the length band; only then are texts joined to them. In both, the
    ratio is worked out for those whose character counts allow it. No pair is lost; a cutoff must be above 2/3.
    """
    if cutoff <= 2 / 3:
        raise ValueError("pieces need a cutoff above 2/3")
    cut, rest = _Cut(cutoff), [c for c in lines.columns if c not in (*keys, "text")]
    filled = lines.where("text <> ''").dropna(subset=keys)
    long = F.broadcast(_long(filled, keys))
    few = _met_within(filled.join(long, keys, "left_anti"), keys, rest, cutoff).where(before)
    filled = filled.join(long, keys, "left_semi")
    side = lambda name, every: _pieces(filled, [*keys, *rest], cut, every).withColumnsRenamed({c: f"{c}_{name}" for c in (*rest, "n", "at")})
    both = F.col("n_x") + F.col("n_y")
    near = (2 * F.least("n_x", "n_y") >= cutoff * both - 1e-9) & (F.abs(F.col("at_x") - F.col("at_y")) <= (1 - cutoff) * both + 1e-9)
    met = side("x", True).join(side("y", False), [*keys, "h"]).where(near & before).select("video_id", F.col("line_no_x").alias("x"), F.col("line_no_y").alias("y")).distinct()
    text = lambda name: filled.select("video_id", F.col("line_no").alias(name), F.col("text").alias(f"t{name}"))
    pairs = met.join(text("x"), ["video_id", "x"]).join(text("y"), ["video_id", "y"])
    pairs = pairs.unionByName(few.select("video_id", F.col("line_no_x").alias("x"), F.col("line_no_y").alias("y"), "tx", "ty"))

    def run(batches):
        for b in batches:
            yield (b[alike(b["tx"], b["ty"], cutoff)] if len(b) else b)[["video_id", "x", "y"]]

    return pairs.mapInPandas(run, met.schema)


def repeats(pairs: DataFrame) -> DataFrame:
    """`(video_id, line_no)` of lines that go, where a line stays unless it is like an earlier one that stays.

    `pairs (video_id, x, y)`: `x` is like the earlier `y`. In each round the lines with no earlier one left
    in question stay, whatever is like them goes, and what was like lines that went is free of these. Every
    round settles at least the first lines of all chains; lines without any pair are never read.
    """
    open_ = checkpointed(pairs.distinct())
    gone = open_.select("video_id", F.col("x").alias("line_no")).limit(0)
    while not open_.isEmpty():
        stay = open_.select("video_id", "y").join(open_.select("video_id", F.col("x").alias("y")), ["video_id", "y"], "left_anti").distinct()
        out = checkpointed(open_.join(stay, ["video_id", "y"], "left_semi").select("video_id", "x").distinct())
        gone = gone.union(out)
        rest = open_.join(out, ["video_id", "x"], "left_anti").join(out.withColumnRenamed("x", "y"), ["video_id", "y"], "left_anti")
        open_ = checkpointed(rest.select("video_id", "x", "y"))
    return gone


def dedup_lines(lines: DataFrame, within: float = 0.90, across: float = 0.93, most_lines: int | None = None, memory: int | None = None,
                counted: DataFrame | None = None) -> DataFrame:
    """Lines `(video_id, line_no, text, window_no)` that repeat neither their window nor the past.

    Inside a window a line like one that stays (case folded) goes. Then lines go that are like a line
    kept from an earlier window. Videos of at most `FEW_LINES` lines and `FEW_CHARS` characters are held one at a time, after
    one shuffle of their lines. In longer ones both steps are similarity joins over distinct texts, then rounds over the pairs
    found; no window, video or memory is held. Windows of more than `most_lines` lines skip the first
    step. With `memory`, only the last so many kept lines count: their number depends on every decision
    before, so this form goes through each video in order and holds that many lines. `counted (video_id, text)` has at least
    the lines of each video, where these are sooner read than `lines`: by it the long videos are found.
    """
    if memory is not None:
        rows = fixed_blocks(lines, "line_no", 1 << 14)
        return fold(rows, ["video_id"], ["line_no"], ["window_no", "line_no", "text"], dedup_step(within, across, most_lines, memory), "line_no long, text string")
    lines = lines.select("video_id", "window_no", F.col("line_no").cast("long").alias("line_no"), "text")
    long = checkpointed(_long(lines if counted is None else counted, ["video_id"]))
    if long.isEmpty():
        return _dedup_few(lines, within, across, most_lines)
    few = _dedup_few(lines.join(F.broadcast(long), "video_id", "left_anti"), within, across, most_lines)
    return few.unionByName(_dedup_long(lines.join(F.broadcast(long), "video_id", "left_semi"), within, across, most_lines))


def _dedup_few(lines: DataFrame, within: float, across: float, most_lines: int | None) -> DataFrame:
    def run(batches):
        for frame in _whole(batches, ["video_id"]):
            yield _deduped(frame, within, across, most_lines)

    rows = _together(lines.dropna(subset=["video_id", "window_no", "line_no"]), ["video_id"])
    return rows.withColumn("low", F.lower("text")).mapInPandas(run, lines.select("video_id", "line_no", "text").schema)


def _dedup_long(lines: DataFrame, within: float, across: float, most_lines: int | None) -> DataFrame:
    lines = checkpointed(lines)
    key = ["video_id", "window_no"]
    small, exempt = lines, lines.limit(0)
    if most_lines is not None:
        size = lines.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most_lines).select(*key)
        small, exempt = lines.join(size, key, "left_anti"), lines.join(size, key, "left_semi")
    first = small.groupBy(*key, F.lower("text").alias("text")).agg(F.min("line_no").alias("line_no"))
    gone = repeats(similar_pairs(first, key, within, F.col("line_no_y") < F.col("line_no_x")))
    left = first.select("video_id", "line_no").join(gone, ["video_id", "line_no"], "left_anti")
    kept = checkpointed(small.join(left, ["video_id", "line_no"], "left_semi").unionByName(exempt))
    # a text that went once goes again, and one that stayed makes its later copies go: its first window decides
    texts = kept.groupBy("video_id", "text").agg(F.min("window_no").alias("window_no"), F.min_by("line_no", F.struct("window_no", "line_no")).alias("line_no"))
    gone = repeats(similar_pairs(texts, ["video_id"], across, F.col("window_no_y") < F.col("window_no_x")))
    fresh = texts.join(gone, ["video_id", "line_no"], "left_anti").select("video_id", "text", "window_no")
    return kept.join(fresh, ["video_id", "text", "window_no"], "left_semi").select("video_id", "line_no", "text")


def dedup_step(within: float = 0.90, across: float = 0.93, most_lines: int | None = 80, memory: int = 5000):
    """Rows `(window_no, line_no, text)`, whole windows in order, for the form with a bounded memory. The state is
    the last `memory` kept lines and the window in progress."""

    def close(state, out):
        held, _, pending = state
        kept = pending
        if most_lines is None or len(pending) <= most_lines:
            kept, seen = [], []
            for n, text in pending:
                low = text.lower()
                if not alike([low] * len(seen), seen, within).any():
                    seen.append(low)
                    kept.append((n, text))
        x, y = np.repeat(np.array([t for _, t in kept], object), len(held)), np.tile(np.array(held, object), len(kept))
        old = alike(x, y, across).reshape(len(kept), len(held)).any(axis=1)
        fresh = [(n, text) for (n, text), o in zip(kept, old) if not o]
        out += fresh
        return [(held + [text for _, text in fresh])[-memory:], None, []]

    def step(state, rows, last):
        state = state or [[], None, []]
        out = []
        for window, n, text in rows:
            if state[1] is not None and state[1] != window:
                state = close(state, out)
            state[1] = window
            state[2].append([n, text])
        if last:
            state = close(state, out)
        return out, state

    return step


def near_earlier(lines: DataFrame, edits: int) -> DataFrame:
    """Lines with an earlier line of the same video within `edits` edits.

    Videos of at most `FEW_LINES` lines and `FEW_CHARS` characters are held one at a time, after one shuffle of their lines.
    In longer ones lines meet on pieces (`_near_joined`). In both, equal lines are answered first and count once.
    """
    long = checkpointed(_long(lines, ["video_id"]))
    if long.isEmpty():
        return _near_few(lines, edits)
    few = _near_few(lines.join(F.broadcast(long), "video_id", "left_anti"), edits)
    return few.unionByName(_near_joined(lines.join(F.broadcast(long), "video_id", "left_semi"), edits))


def _by_edits(edits: int) -> dict:
    """For `_met`: what at most so many edits need."""
    return {"reach": lambda n: n + edits, "least": lambda n, m: m - edits}


def _near(frame: pd.DataFrame, edits: int) -> pd.DataFrame:
    """Rows of whole videos `(video_id, line_no, text)` that come after a line of their video within `edits` edits."""
    frame = frame.sort_values("line_no", kind="stable")
    frame = frame.assign(_t=_number(frame, ["video_id", "text"]))
    texts = frame.drop_duplicates("_t")
    text, first = texts["text"].to_numpy(object), texts["line_no"].to_numpy()
    hit = np.zeros(len(texts), bool)
    for i, j in _met(text, _number(texts, ["video_id"]), **_by_edits(edits)):
        later = first[i] > first[j]
        x, y = np.where(later, i, j), np.where(later, j, i)
        for low in range(0, len(x), WHOLE):
            a, b = x[low : low + WHOLE], y[low : low + WHOLE]
            open_ = ~hit[a] & (first[a] > first[b])
            a, b = a[open_], b[open_]
            hit[a[within_edits(text[a], text[b], edits)]] = True
    return frame[(first[frame["_t"]] < frame["line_no"]) | hit[frame["_t"]]][["video_id", "line_no"]]


def _near_few(lines: DataFrame, edits: int) -> DataFrame:
    def run(batches):
        for frame in _whole(batches, ["video_id"]):
            yield _near(frame, edits)

    rows = lines.select("video_id", "line_no", "text").dropna()
    return _together(rows, ["video_id"]).mapInPandas(run, rows.select("video_id", "line_no").schema)


def _near_joined(lines: DataFrame, edits: int) -> DataFrame:
    """`near_earlier` for videos that are not held.

    `edits + 1` pieces: an edit can spoil one piece only, so a true pair shares a piece, moved by `d`. What stands before it
    then differs by `d` in length and what follows by the rest of the difference in length, so these are at most `edits`
    together. Lines meet on the hash of such a piece; only then are texts joined to them. Equal lines are answered first
    by an aggregate and leave the join, so a line repeated many times adds one row.
    """
    n = edits + 1
    lines = checkpointed(lines)
    distinct = lines.groupBy("video_id", "text").agg(F.min("line_no").alias("first")).withColumn("k", F.xxhash64("text"))
    size = F.length("text")

    def piece(size: Column, i: int, d: int) -> Column:
        low, high = (F.floor(size * k / n).cast("int") for k in (i, i + 1))
        return F.xxhash64(size, F.lit(i), F.when(low + d >= 0, F.substring("text", low + d + 1, high - low)))

    moved = [(more, i, d) for more in range(-edits, edits + 1) for i in range(n) for d in range(-edits, edits + 1) if abs(d) + abs(more - d) <= edits]
    rows = lambda side, pieces: distinct.select("video_id", F.col("k").alias(f"k{side}"), F.col("first").alias(f"f{side}"), F.explode(F.array_distinct(F.array(*pieces))).alias("h"))
    own, probes = rows(1, [piece(size, i, 0) for i in range(n)]), rows(2, [piece(size - more, i, d) for more, i, d in moved])
    met = own.join(probes, ["video_id", "h"]).where("f1 < f2").select("video_id", "k1", "f1", "k2", "f2").distinct()
    text = lambda side: distinct.select("video_id", F.col("k").alias(f"k{side}"), F.col("first").alias(f"f{side}"), F.col("text").alias(f"t{side}"))
    near = met.join(text(1), ["video_id", "k1", "f1"]).join(text(2), ["video_id", "k2", "f2"]).where(F.levenshtein("t1", "t2", edits) >= 0)
    hits = near.groupBy("video_id", F.col("t2").alias("text")).agg(F.min("f1").alias("_near"))
    rows = lines.join(distinct.drop("k"), ["video_id", "text"]).join(hits, ["video_id", "text"], "left")
    return rows.where((F.col("first") < F.col("line_no")) | (F.col("_near") < F.col("line_no"))).select("video_id", "line_no")
