"""Results do not depend on how long groups are cut, and folds equal plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewise.operators import captions as ca
from cuewise.operators import chapters as ch
from cuewise.operators import folds as fo
from cuewise.operators import metrics as me
from cuewise.operators import neardup as nd
from cuewise.operators import ordered as od
from cuewise.operators import thinning as th
from cuewise.operators import vectors as ve
from cuewise.operators import windows as wi
from cuewise.operators.ordered import BLOCK, density_blocks, fixed_blocks, scan


def stamps(n=400, seed=1, hot=0.6):
    """Rows of three videos, one of which holds most of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = "hot" if rng.random() < hot else rng.choice("ab")
        rows.append((v, i, round(rng.random() * 3000, 3), rng.choice(["x", "y", None]), rng.random() * 40))
    return rows


SCHEMA = "video_id string, event_id long, start_s double, text string, value double"


def test_blocked_scan_equals_plain_windows(spark):
    df = spark.createDataFrame(stamps(), SCHEMA)
    order = ["start_s", "event_id"]
    blocked = density_blocks(df, ["video_id"], "start_s", target=20)
    assert blocked.agg(F.max(BLOCK)).first()[0] > 5
    got = scan(blocked, ["video_id"], order, number="n", lag={"l": "text"}, lead={"f": "start_s"}, total={"t": "value"}, peak_before={"p": "value"}, last_known={"k": "text"}, next_known={"x": "text"})
    w = Window.partitionBy("video_id").orderBy(*order)
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select("video_id", "event_id", F.row_number().over(w).alias("n"), F.lag("text").over(w).alias("l"), F.lead("start_s").over(w).alias("f"), F.sum("value").over(up).alias("t"),
                     F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), F.last("text", True).over(up).alias("k"), F.first("text", True).over(on).alias("x"))
    cols = ["video_id", "event_id", "n", "l", "f", "t", "p", "k", "x"]
    key = lambda r: (r[0], r[1])
    a = sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.select(cols).collect()], key=key)
    b = sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in want.select(cols).collect()], key=key)
    assert a == b


def loop(rows, rule, inputs):
    out = {}
    for v in {r[0] for r in rows}:
        state, opener = None, None
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
            opens, state = rule(state, inputs(r))
            opener = r[1] if opens else opener
            out[r[1]] = opener
    return out


@pytest.mark.parametrize("name", ["anchored", "packing", "fixed", "forced", "smart"])
def test_cut_folds_equal_plain_loops(spark, name):
    rows = stamps(300, seed=5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("end_s", F.col("start_s") + F.col("value")).withColumn("mark", F.col("event_id") % 3 == 0).withColumn("blank", F.lit(False))
    rule, cols, pick = {
        "anchored": (fo.anchored(100.0), ["start_s"], lambda r: (r[2],)),
        "packing": (fo.packing(120.0), ["start_s", "end_s"], lambda r: (r[2], r[2] + r[4])),
        "fixed": (fo.fixed_blocks_rule(90.0), ["start_s", "end_s"], lambda r: (r[2], r[2] + r[4])),
        "forced": (fo.forced(80.0), ["start_s", "end_s"], lambda r: (r[2], r[2] + r[4])),
        "smart": (fo.smart_merge(), ["start_s", "end_s", "mark", "blank"], lambda r: (r[2], r[2] + r[4], r[1] % 3 == 0, False)),
    }[name]
    want = loop(rows, rule, pick)
    for target in (25, 1 << 20):
        blocked = density_blocks(df, ["video_id"], "start_s", target=target)
        got = fo.runs(blocked, ["video_id"], ["start_s", "event_id"], "event_id", cols, rule)
        assert {r["event_id"]: r["run"] for r in got.collect()} == want


def test_admission_on_cut_groups(spark):
    rows = stamps(300, seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    step = fo.admission_step(3, 60.0)
    want = {}
    for v in {r[0] for r in rows}:
        out, _ = step(None, [(r[1], r[2]) for r in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1]))], True)
        want |= {o[0]: (o[1], o[2]) for o in out}
    got = fo.fold(density_blocks(df, ["video_id"], "start_s", target=20), ["video_id"], ["start_s", "event_id"], ["event_id", "start_s"], step, "event_id long, allowed boolean, remaining int, reset double")
    assert {r["event_id"]: (r["allowed"], r["remaining"]) for r in got.collect()} == want


def test_a_request_at_the_reset_time_is_in_the_old_window():
    out, _ = fo.admission_step(1, 60.0)(None, [(1, 0.0), (2, 60.0), (3, 60.1)], True)
    assert [(o[1], o[2]) for o in out] == [(True, 0), (False, 0), (True, 0)]


def test_midpoint_merge_moves_its_anchor(spark):
    df = spark.createDataFrame([("v", float(t)) for t in (0, 0.9, 1.4, 5, 5.5)], "video_id string, t double")
    for width in (1.0, 100.0):
        blocked = df.withColumn(BLOCK, F.floor(F.col("t") / width))
        got = sorted(r["t"] for r in fo.fold(blocked, ["video_id"], ["t"], ["t"], fo.midpoint_step(), "t double").collect())
        assert got == pytest.approx([0.925, 5.25])


def brute_thin(ts, keep):
    ts = list(ts)
    while len(ts) > keep:
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        i = gaps.index(min(gaps))
        ts.pop(i + 1 if i + 1 < len(gaps) else i)
    return ts


def test_thinning_equals_brute_force(spark):
    """One block, and a long group cut into blocks; even gaps, many equal ones, rising and falling ones."""
    rng = random.Random(3)
    shapes = {
        "free": sorted(rng.sample(range(2000), 60)), "ties": sorted(rng.sample(range(90), 60)), "even": list(range(0, 150, 3)),
        "rising": [k * k for k in range(50)], "falling": [-k * k for k in range(50)][::-1], "waves": sorted({k * 10 + (k * k) % 7 for k in range(55)}), "one": [5], "two": [1, 9], "none": [],
    }
    df = spark.createDataFrame([(v, float(t)) for v, ts in shapes.items() for t in ts] + [("free", float(shapes["free"][3]))], "video_id string, t double")
    for keep, block in ((3, 4), (21, 8), (59, 1 << 16)):
        got = {}
        for r in th.thin_gaps(df, keep, block).collect():
            got.setdefault(r["video_id"], []).append(r["t"])
        assert {v: sorted(ts) for v, ts in got.items()} == {v: [float(t) for t in brute_thin(ts, keep)] for v, ts in shapes.items() if ts}, (keep, block)


def test_removals_in_random_blocks():
    """Cut anywhere: what a block decides by itself is what the whole decides."""
    rng = random.Random(7)
    for _ in range(300):
        ts = sorted(rng.sample(range(400), rng.randint(3, 40)))
        width, left = th.contracted(ts)
        whole = {t: (w, l) for t, w, l in zip(ts, width, left) if w == w}
        assert len(whole) == len(ts) - 2
        a = rng.randrange(len(ts))
        b = rng.randint(a, len(ts) - 1)
        width, left = th.contracted(ts[a : b + 1], a > 0, b < len(ts) - 1)
        assert all(whole[t] == (w, l) for t, w, l in zip(ts[a:b + 1], width, left) if w == w)


def test_selected_frames(spark):
    hits = spark.createDataFrame([("v", f) for f in (5, 5, 9, 30, 31, None, 90)] + [("w", None)], "video_id string, frame long")
    assert sorted(r["frame"] for r in ch.selected_frames(hits).collect()) == [5, 9, 30, 31, 90]
    assert sorted(r["frame"] for r in ch.selected_frames(hits, 3).collect()) == brute_thin([5, 9, 30, 31, 90], 3)


def test_top_rows_and_sessions_on_a_hot_group(spark):
    rows = stamps(300, seed=2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = wi.top_rows(df, ["video_id"], [F.desc("value"), F.asc("event_id")], 5).groupBy("video_id").agg(F.sort_array(F.collect_list("event_id")).alias("e"))
    for r in got.collect():
        assert r["e"] == sorted(x[1] for x in sorted((x for x in rows if x[0] == r["video_id"]), key=lambda x: (-x[4], x[1]))[:5])
    n = wi.sessions(df.select("video_id", "event_id", "start_s"), 20.0, cap=4).groupBy("video_id").agg(F.count_distinct("session").alias("n")).collect()
    assert all(r["n"] <= 4 for r in n)


def test_interval_union_edges(spark):
    rows = [("v", 1, 0.0, 10.0), ("v", 2, 2.0, 3.0), ("v", 3, 10.05, 12.0), ("v", 4, 12.2, 13.0), ("v", 5, 20.0, 15.0), ("v", 6, -5.0, 0.5), ("v", 7, 12.9, 99.0)]
    df = spark.createDataFrame(rows, "video_id string, event_id long, start_s double, end_s double")
    got = sorted((r["start_s"], r["end_s"]) for r in wi.interval_union(df, F.lit(50.0)).collect())
    assert got == [(0.0, 12.0), (12.2, 50.0)]


def brute_dedup(lines, most_lines=10**9, memory=10**9):
    held, out = [], []
    for w in sorted({x[0] for x in lines}):
        kept, seen = [], []
        window = [x for x in lines if x[0] == w]
        for _, n, text in window:
            if len(window) > most_lines or not any(SequenceMatcher(None, text.lower(), k).ratio() >= 0.90 for k in seen):
                seen.append(text.lower())
                kept.append((n, text))
        fresh = [(n, t) for n, t in kept if not any(SequenceMatcher(None, t, g).ratio() >= 0.93 for g in held)]
        held = (held + [t for _, t in fresh])[-memory:]
        out += fresh
    return sorted(out)


def test_near_duplicate_lines(spark):
    rng = random.Random(4)
    base = ["the quick brown fox jumps", "over a lazy dog again", "numbers one two three four", "an unrelated line of words"]
    lines = []
    for n in range(60):
        t = rng.choice(base)
        if rng.random() < 0.6:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("abcXYZ") + t[k + 1:]
        lines.append((n // 6, n, t))
    df = spark.createDataFrame([("v", *x) for x in lines], "video_id string, window_no long, line_no long, text string")
    want = brute_dedup(lines)
    assert sorted((r["line_no"], r["text"]) for r in nd.dedup_lines(df).collect()) == want
    for memory in (5000, 3):
        cut = fixed_blocks(df, "line_no", 16)
        got = fo.fold(cut, ["video_id"], ["line_no"], ["window_no", "line_no", "text"], nd.dedup_step(memory=memory), "line_no long, text string")
        assert sorted((r["line_no"], r["text"]) for r in got.collect()) == brute_dedup(lines, memory=memory)
        assert sorted((r["line_no"], r["text"]) for r in nd.dedup_lines(df, memory=memory).collect()) == brute_dedup(lines, memory=memory)


def test_alignment_grids(spark):
    cases = {
        "square": (3, 3, [(0, 0, 0.9), (1, 1, 0.5), (2, 2, 0.8), (0, 1, 0.3)], 2.2),
        "row": (1, 3, [(0, 0, 0.2), (0, 2, 0.7)], 0.7),
        "column": (3, 1, [(0, 0, 0.4), (2, 0, 0.6)], 0.6),
        "crossed": (2, 2, [(0, 1, 0.6), (1, 0, 0.5)], 0.6),
        "none": (2, 2, [], 0.0),
    }
    pairs = spark.createDataFrame([(k, i, j, s, s) for k, c in cases.items() for i, j, s in c[2]], "video_id string, i long, j long, iou double, text double")
    counts = spark.createDataFrame([(k, c[0], c[1]) for k, c in cases.items()], "video_id string, n_ref long, n_pred long")
    for r in ca.alignment(pairs, counts).where("variant = 'd'").collect():
        n_ref, n_pred, _, best = cases[r["video_id"]]
        assert r["p"] == pytest.approx(best / n_pred) and r["r"] == pytest.approx(best / n_ref)


def full_alignment(s, text):
    """The whole table and all moves: (best sum, text along the path)."""
    m, n = len(s), len(s[0])
    best, move = [[0.0] * n for _ in range(m)], [[0] * n for _ in range(m)]
    for i in range(m):
        for j in range(n):
            options = [best[i - 1][j] if i else -1, best[i][j - 1] if j else -1, s[i][j] + (best[i - 1][j - 1] if i and j else 0)]
            best[i][j], move[i][j] = max(options), options.index(max(options))
    i, j, path = m - 1, n - 1, []
    while i >= 0:
        through = [k for k in range(j + 1) if move[i][k] == 2]
        if through:
            path.append((i, through[-1]))
            if i == 0 or through[-1] == 0:
                break
            j = through[-1] - 1
        i -= 1
    return best[-1][-1], sum(text[i][j] for i, j in path)


def test_alignment_paths_equal_full_tables(spark):
    rng = random.Random(12)
    cases, rows, counts = {}, [], []
    for k in range(60):
        m, n = rng.randint(1, 7), rng.randint(1, 7)
        s = [[rng.choice([0, 0, 0, 0.25, 0.5, 0.75]) for _ in range(n)] for _ in range(m)]
        x = [[rng.choice([0, 0.5, 1.0]) for _ in range(n)] for _ in range(m)]
        cases[str(k)] = (m, n, s, x)
        counts.append((str(k), m, n))
        rows += [(str(k), i, j, s[i][j], x[i][j]) for i in range(m) for j in range(n) if s[i][j] or i == j == 0]
    pairs = spark.createDataFrame([(v, i, j, float(a), float(b)) for v, i, j, a, b in rows], "video_id string, i long, j long, iou double, text double")
    got = ca.alignment(pairs, spark.createDataFrame(counts, "video_id string, n_ref long, n_pred long"), (0.0, 0.5)).collect()
    assert len(got) == 60 * 2 * 4
    for r in got:
        m, n, s, x = cases[r.video_id]
        cut = [[a if a >= r.threshold else 0 for a in row] for row in s]
        mixed = [[a * b for a, b in zip(u, v)] for u, v in zip(cut, x)]
        top, along = full_alignment(cut, x)
        want = {"a": along, "b": along, "c": full_alignment(mixed, x)[0], "d": top}[r.variant]
        assert (r.p, r.r) == pytest.approx((want / n, want / m))


def test_greedy_matching_is_one_to_one(spark):
    rng = random.Random(8)
    rows = [("v", i, j, rng.choice([0.2, 0.5, 0.9])) for i in range(12) for j in range(12) if rng.random() < 0.4]
    got = me.greedy_matching(spark.createDataFrame(rows, "video_id string, i long, j long, iou double")).collect()
    assert len({r["i"] for r in got}) == len(got) == len({r["j"] for r in got})
    used_i, used_j, want = set(), set(), set()
    for _, i, j, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), want.add((i, j))
    assert {(r["i"], r["j"]) for r in got} == want


def test_caption_intervals_at_048(spark):
    seg = lambda rows: spark.createDataFrame([("vid1", i, float(s), float(e)) for i, (s, e) in enumerate(rows)], "video_id string, i long, s double, e double")
    pairs = me.iou_pairs(seg([(0, 10), (15, 25)]), seg([(0, 5), (5, 12), (12, 25)])).where("iou >= 0.48").collect()
    assert {(r["i"], r["j"]) for r in pairs} == {(0, 0), (1, 2)}


def test_near_earlier_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["abcdefgh", "abcdxfgh", "bcdefghi", "zzzzzzzz", "abcdefgg", "hgfedcba"]
    lines = [(n, "".join(c if rng.random() > 0.1 else rng.choice("xyz") for c in rng.choice(words))) for n in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {n for n, t in lines if any(m < n and distance(t, u) <= 2 for m, u in lines)}
    df = spark.createDataFrame([("v", n, t) for n, t in lines], "video_id string, line_no long, text string")
    assert {r["line_no"] for r in nd.near_earlier(df, 2).collect()} == want


def merged_modules(rows, threshold, gap):
    """One module after the other, with all its parts."""
    out, total = [], None
    for v, pos, start, end, vec, title, summary, bins in rows:
        t, s = (title or "").strip(), (summary or "").strip()
        if out:
            last = out[-1]
            dot = sum(a * b for a, b in zip(total, vec))
            norm = (sum(a * a for a in total) * sum(b * b for b in vec)) ** 0.5
            if (dot / norm if norm else 0.0) >= threshold or start - last["end_s"] <= gap:
                total = [a + b for a, b in zip(total, vec)]
                if max(bins) >= max(last["bins"]):
                    last["end_s"] = end
                last["bins"] = sorted({*last["bins"], *bins})
                last["n"] += 1
                if t and len(t) < len(last["title"]):
                    last["title"] = t
                if s and s not in last["summary"]:
                    last["summary"] = (last["summary"] + "；" + s).strip("；")
                continue
        total = vec
        out.append({"module": pos, "start_s": start, "end_s": end, "n": 1, "title": t or "模組", "summary": s, "bins": sorted(bins)})
    return out


def test_module_merge_equals_loop(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        title, summary = rng.choice([None, "", " a title ", "ab", "longer title", "x"]), rng.choice([None, "", "first", "first part", "；odd；", " second "])
        rows.append(("v", i, i * 40.0, i * 40.0 + rng.choice([30.0, 38.0]), [rng.choice([0.0, rng.random()]) for _ in range(4)], title, summary, rng.choice([[2 * i], [2 * i, 2 * i + 1], [2 * i - 3, 2 * i]])))
    df = spark.createDataFrame(rows, "video_id string, pos long, start_s double, end_s double, vec array<double>, title string, summary string, bins array<long>")
    for threshold, gap in ((0.9, 5.0), (0.7, -1e9), (0.0, 0.0)):
        got = [{k: r[k] for k in r.asDict() if k != "video_id"} for r in ve.merge_modules(df, threshold, gap).orderBy("module").collect()]
        assert got == merged_modules(rows, threshold, gap)
    step = ve.module_step(0.9, 5.0)
    want = dict(step(None, [(r[1], r[2], r[3], max(r[7]), r[4]) for r in rows], True)[0])
    cut = fixed_blocks(df.withColumn("top", F.array_max("bins")), "pos", 7)
    got = fo.fold(cut, ["video_id"], ["pos"], ["pos", "start_s", "end_s", "top", "vec"], step, "pos long, module long")
    assert {r["pos"]: r["module"] for r in got.collect()} == want


def test_gated_selection_on_cut_groups(spark):
    rng = random.Random(12)
    rows = []
    for i in range(80):
        vec = [rng.choice([0.0, 1.0]) for _ in range(16)]
        rows.append(("v", i, i * 2.0, rng.random() > 0.2, "".join(str(int(x)) for x in vec), vec))
    picked, last = [], None
    for _, pos, t, ok, h, vec in rows:
        if not ok:
            continue
        if last is not None:
            if t - last[0] < 3.0 or sum(a != b for a, b in zip(h, last[1])) < 5:
                continue
            norm = (sum(vec) * sum(last[2])) ** 0.5
            if (sum(a * b for a, b in zip(vec, last[2])) / norm if norm else 0.0) >= 0.5 and t - last[0] < 20.0:
                continue
        last = (t, h, vec)
        picked.append(pos)
    df = spark.createDataFrame(rows, "video_id string, pos long, t double, ok boolean, hash string, vec array<double>")
    for width in (9, 1000):
        got = fo.fold(fixed_blocks(df, "pos", width), ["video_id"], ["pos"], ["pos", "t", "ok", "hash", "vec"], fo.gate_step(3.0, 20.0, same=0.5), "pos long")
        assert sorted(r["pos"] for r in got.collect()) == picked


def test_rouge_l_of_two_pairs(spark):
    rows = [(0.5, "v", 0, 0, "the cat sat", "the cat on the mat"), (0.5, "v", 1, None, "alone", None)]
    pairs = ca.token_pairs(spark.createDataFrame(rows, "tiou double, video_id string, j long, i long, pred_title string, ref_title string"))
    p, r, b = 2 / 3, 2 / 5, 1.2
    want = (1 + b * b) * p * r / (r + b * b * p)
    assert ca.rouge_l(pairs).first()["score"] == pytest.approx(want / 2)


@pytest.mark.parametrize("shape", ["even", "one hot instant", "skewed"])
def test_blocks_by_rank(spark, shape):
    """However the values lie, no block of a long group has twice the mean, and blocks follow the order."""
    rng = random.Random(6)
    value = {"even": rng.random, "one hot instant": lambda: 0.5 if rng.random() < 0.6 else rng.random(), "skewed": lambda: rng.random() ** 12 * 1e6}[shape]
    rows = [("long", i, value()) for i in range(20_000)] + [("short", i, value()) for i in range(300)]
    df = spark.createDataFrame(rows, "video_id string, event_id long, t double")
    got = density_blocks(df, ["video_id"], "t", target=1000, tie="event_id").collect()
    sizes, spans = {}, {}
    for r in got:
        if r["video_id"] == "long":
            sizes[r[BLOCK]] = sizes.get(r[BLOCK], 0) + 1
            lo, hi = spans.get(r[BLOCK], ((r["t"], r["event_id"]), (r["t"], r["event_id"])))
            spans[r[BLOCK]] = (min(lo, (r["t"], r["event_id"])), max(hi, (r["t"], r["event_id"])))
    assert len(sizes) > 12 and max(sizes.values()) <= 2 * 20_000 / len(sizes)
    order = [spans[b] for b in sorted(spans)]
    assert all(a[1] < b[0] for a, b in zip(order, order[1:]))
    assert {r[BLOCK] for r in got if r["video_id"] == "short"} == {0}


def test_few_blocks_for_any_group(spark, monkeypatch):
    monkeypatch.setattr(od, "MOST_BLOCKS", 8)
    df = spark.createDataFrame([("v", i, float(i % 7)) for i in range(5000)], "video_id string, event_id long, t double")
    sizes = [r["count"] for r in density_blocks(df, ["video_id"], "t", target=10, tie="event_id").groupBy(BLOCK).count().collect()]
    assert len(sizes) <= 10 and max(sizes) < 1300


def test_keyword_runs_equal_sets(spark):
    """The last places give the same runs as the sets of all words, also on cut groups."""
    rng = random.Random(10)
    rows, want = [], {}
    for v in "ab":
        seen, run = None, None
        for n in range(120):
            k = rng.sample("abcdefghijklmnop", rng.choice([0, 0, 1, 3, 6]))
            rows.append((v, n, [*k, *k[:1]] if rng.random() < 0.9 else None))
            words = set(rows[-1][2] or [])
            both = (seen or set()) | words
            if seen is None or (len(seen & words) / len(both) if both else 0.0) < 0.2:
                seen, run = words, n
            else:
                seen = both
            want[v, n] = run
    df = spark.createDataFrame(rows, "video_id string, line_no long, k array<string>")
    places = fo.with_last_places(df, ["video_id"], "line_no", "k")
    for width in (16, 1 << 16):
        got = fo.runs(fixed_blocks(places, "line_no", width), ["video_id"], ["line_no"], "line_no", ["line_no", "n", "back"], fo.keyword_shift(0.2))
        assert {(r["video_id"], r["line_no"]): r["run"] for r in got.collect()} == want
