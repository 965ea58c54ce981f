"""Thinning of stamps by their smallest gaps, block by block.

The plain rule takes away one stamp at a time: of the smallest gap (the first one on ties) the right end goes,
of the last gap the left one, and the two gaps beside it become one. Gaps only grow, so the gaps taken
come in rising order, and a gap smaller than both neighbours is taken before either of them can change,
whatever happens elsewhere. So every block takes all it can decide by itself, and what it took is put
into the order of the plain rule afterwards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.operators.folds import grouped
from cuewise.operators.ordered import BLOCK, density_blocks
from cuewise.operators.windows import top_rows
from cuewise.session import checkpointed

#: Stamps of one block.
BLOCK_ROWS = 1 << 16


def contracted(ts: list[float], open_left: bool = False, open_right: bool = False) -> tuple[list[float], list[float]]:
    """For each stamp the gap it goes with and that gap's left end; not a number for stamps that stay.

    With an open side, the gap at it has a neighbour elsewhere: it is never taken here, only made larger.
    Without, everything between the two ends goes in the end.
    """
    n = len(ts)
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), n]
    gap = [b - a for a, b in zip(ts, ts[1:])]  # by left end
    width, left = [float("nan")] * n, [float("nan")] * n
    heap = [(g, i) for i, g in enumerate(gap)]
    heapq.heapify(heap)
    while heap:
        g, i = heapq.heappop(heap)
        if nxt[i] == n or gap[i] != g or width[i] == width[i]:
            continue
        h, j = prev[i], nxt[i]
        is_last = nxt[j] == n
        if (open_left and h < 0) or (open_right and is_last) or (h < 0 and is_last):
            continue
        if (h >= 0 and gap[h] <= g) or (not is_last and gap[j] < g):
            continue  # a smaller gap beside it is held up by an open side
        drop, keep = (i, h) if is_last else (j, i)
        width[drop], left[drop] = g, ts[i]
        nxt[keep] = nxt[drop]
        if nxt[keep] < n:
            prev[nxt[keep]] = keep
        gap[keep] = ts[nxt[keep]] - ts[keep]
        heapq.heappush(heap, (gap[keep], keep))
    return width, left


def removals(stamps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`(video_id, t, width, left)` for all but the first and last of the distinct stamps `(video_id, t)`: in the order
    of `width` and `left`, this is what the plain rule takes away.

    A round leaves each block of `block_rows` stamps with gaps that rise and then fall; the next one cuts
    anew, into blocks twice as long. Only groups longer than a block need a further round.
    """
    stays = F.col("width").isNull() | F.isnan("width")
    now, out = stamps.select("video_id", F.col("t").cast("double").alias("t")).where("t IS NOT NULL").distinct(), None

    def run(rows: list[tuple]) -> list[tuple]:
        ts, (_, beyond, part) = [r[0] for r in rows], rows[0]
        open_right = beyond is not None and beyond == beyond
        width, left = contracted(ts + [beyond] * open_right, part > 0, open_right)
        return list(zip(ts, width, left))

    while True:
        now = checkpointed(now)
        placed = density_blocks(now, ["video_id"], "t", target=block_rows).withColumnRenamed(BLOCK, "part")
        firsts = placed.groupBy("video_id", "part").agg(F.min("t").alias("first"))
        firsts = firsts.select("video_id", "part", F.lead("first").over(Window.partitionBy("video_id").orderBy("part")).alias("beyond"))
        # blocks stream past, many to a batch: most of them hold a few stamps
        made = grouped(placed.join(firsts, ["video_id", "part"]), ["video_id", "part"], ["t"], ["t", "beyond", "part"], run, "t double, width double, left double")
        made = checkpointed(made)
        taken = made.where(~stays).drop("part")
        out = taken if out is None else out.union(taken)
        if made.where("part > 0").isEmpty():
            return out
        now, block_rows = made.where(stays).select("video_id", "t"), block_rows * 2


def thin_gaps(stamps: DataFrame, keep: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stamps `(video_id, t)` left when the plain rule stops at `keep` (2 at least) per video.

    The ends and the `keep` - 2 stamps that go last, so only those are ranked; no video is gathered.
    Repeated stamps count once.
    """
    ends = stamps.groupBy("video_id").agg(F.array_distinct(F.array(F.min("t"), F.max("t"))).alias("t")).select("video_id", F.explode("t").alias("t")).withColumn("t", F.col("t").cast("double"))
    if keep <= 2:
        return ends.where("t IS NOT NULL")
    last = top_rows(removals(stamps, block_rows), ["video_id"], [F.desc("width"), F.desc("left")], keep - 2)
    return ends.where("t IS NOT NULL").unionByName(last.select("video_id", "t"))
