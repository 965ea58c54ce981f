"""Caption similarity, alignment scores, lexicon snap and window choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions import timefmt as tf
from cuewise.operators import captions as ca
from cuewise.operators import chapters as ch
from cuewise.functions.timefmt import sec_to_hms
from cuewise.operators import metrics as me
from cuewise.operators.lexicon import snap
from cuewise.operators.ordered import density_blocks, scan
from cuewise.plans.registry import query
from cuewise.plans.scoring import SEGS_SQL, sides
from cuewise.plans.timebase import HMS_SQL, TOK_SQL
from cuewise.plans.timed_joins import IOU_SQL, raw_sides
from cuewise.session import checkpointed


def title_pairs(t):
    """Chapter titles widened to a few words that both sides share in part."""
    words = lambda c: F.concat_ws(" ", F.lit("about"), F.split("title", " ")[1], F.when(F.col("idx") % 2 == 0, "item").otherwise("the item"), F.split("title", " ")[0])
    ref, pred = t.ref.withColumn("title", words("title")), t.pred.withColumn("title", words("title"))
    return ca.token_pairs(ch.caption_pairs(ref, pred, me.iou_pairs(*raw_sides(t))))


PAIR_SQL = f"""
r AS (SELECT video_id, idx, start_s, end_s, 'about ' || string_split(title, ' ')[2] || CASE WHEN idx % 2 = 0 THEN ' item ' ELSE ' the item ' END || string_split(title, ' ')[1] AS title FROM ref),
p AS (SELECT video_id, idx, start_s, end_s, 'about ' || string_split(title, ' ')[2] || CASE WHEN idx % 2 = 0 THEN ' item ' ELSE ' the item ' END || string_split(title, ' ')[1] AS title FROM pred),
thr AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS t),
pr AS (SELECT t AS tiou, p.video_id, p.idx AS j, coalesce(r.idx, -1) AS i, string_split(p.title, ' ') AS pw, CASE WHEN r.title IS NULL THEN [] ELSE string_split(r.title, ' ') END AS rw FROM p CROSS JOIN thr LEFT JOIN r ON r.video_id = p.video_id AND {IOU_SQL} >= t),
g AS (SELECT tiou, video_id, j, i, n, gram, sum(h) AS hyp, sum(rr) AS ref FROM (
  SELECT tiou, video_id, j, i, n, unnest([array_to_string(pw[k:k + n - 1], ' ') FOR k IN range(1, len(pw) - n + 2)]) AS gram, 1 AS h, 0 AS rr FROM pr, range(1, 5) AS q(n) UNION ALL
  SELECT tiou, video_id, j, i, n, unnest([array_to_string(rw[k:k + n - 1], ' ') FOR k IN range(1, len(rw) - n + 2)]), 0, 1 FROM pr, range(1, 5) AS q(n)) GROUP BY ALL),
m AS (SELECT tiou, video_id, n, sum(least(hyp, ref)) AS hit, sum(hyp) AS al FROM g GROUP BY ALL)
"""


@query("a23_bleu_precision", "ref pred", f"WITH {PAIR_SQL} SELECT tiou, video_id, CAST(n AS INTEGER) AS n, round((hit + 1e-15::DOUBLE) / (al + 1e-9::DOUBLE), 6) AS precision FROM m")
def a23_precision(t):
    return ca.bleu(title_pairs(t)).select("tiou", "video_id", "n", F.round("precision", 6).alias("precision"))


@query("a23_bleu_scores", "ref pred", f"""WITH {PAIR_SQL},
l AS (SELECT tiou, video_id, sum(len(pw)) AS c, sum(len(rw)) AS r FROM pr GROUP BY ALL),
b AS (SELECT a.tiou, a.video_id, a.n, pow(product((b.hit + 1e-15::DOUBLE) / (b.al + 1e-9::DOUBLE)), 1.0::DOUBLE / a.n) AS s FROM m a JOIN m b ON a.tiou = b.tiou AND a.video_id = b.video_id AND b.n <= a.n GROUP BY a.tiou, a.video_id, a.n),
s AS (SELECT b.tiou, b.video_id, b.n, s * CASE WHEN c / (r + 1e-9::DOUBLE) < 1 THEN exp(1 - (r + 1e-9::DOUBLE) / c) ELSE 1 END AS s FROM b JOIN l USING (tiou, video_id))
SELECT CAST(n AS INTEGER) AS n, round_even(avg(x), 2) AS score FROM (SELECT tiou, n, avg(s) * 100 AS x FROM s GROUP BY 1, 2) GROUP BY 1""")
def a23_bleu(t):
    return ca.mean_over_videos(ca.bleu(title_pairs(t)), ["n"])


@query("a23_rouge_l", "ref pred", f"""WITH {PAIR_SQL},
u AS (SELECT DISTINCT pw, rw FROM pr),
lc AS (SELECT pw, rw, list_reduce(list_concat([list_transform(range(len(rw) + 1), lambda j: 0::BIGINT)], list_transform(range(1, len(pw) + 1), lambda i: [i])), lambda prev, e:
  list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len(rw) + 1), lambda j: [j])), lambda acc, f: list_append(acc, CASE WHEN rw[f[1]] = pw[e[1]] THEN prev[f[1]] + 1 ELSE greatest(prev[f[1] + 1], acc[len(acc)]) END)))[len(rw) + 1] AS hit FROM u),
sc AS (SELECT tiou, video_id, CASE WHEN hit > 0 THEN (1 + 1.2::DOUBLE * 1.2) * (hit / len(pr.pw)::DOUBLE) * (hit / len(pr.rw)::DOUBLE) / (hit / len(pr.rw)::DOUBLE + 1.2::DOUBLE * 1.2 * (hit / len(pr.pw)::DOUBLE)) ELSE 0 END AS s FROM pr JOIN lc ON pr.pw = lc.pw AND pr.rw = lc.rw)
SELECT round_even(avg(x), 2) AS score FROM (SELECT tiou, avg(v) * 100 AS x FROM (SELECT tiou, video_id, avg(s) AS v FROM sc GROUP BY 1, 2) GROUP BY 1)""")
def a23_rouge(t):
    return ca.mean_over_videos(ca.rouge_l(title_pairs(t)))


@query("a23_cider", "ref pred", f"""WITH {PAIR_SQL},
np AS (SELECT tiou, video_id, count(*) AS np FROM pr GROUP BY ALL), df AS (SELECT tiou, video_id, n, gram, count(*) AS df FROM g WHERE ref > 0 GROUP BY ALL),
w AS (SELECT g.*, hyp * (ln(np) - ln(greatest(1, coalesce(df, 0)))) AS h, ref * (ln(np) - ln(greatest(1, coalesce(df, 0)))) AS rr FROM g JOIN np USING (tiou, video_id) LEFT JOIN df USING (tiou, video_id, n, gram)),
s AS (SELECT tiou, video_id, j, i, n, CASE WHEN sum(h * h) > 0 AND sum(rr * rr) > 0 THEN sum(least(h, rr) * rr) / (sqrt(sum(h * h)) * sqrt(sum(rr * rr))) ELSE sum(least(h, rr) * rr) END AS s FROM w GROUP BY ALL),
q AS (SELECT pr.tiou, pr.video_id, pr.j, pr.i, coalesce(sum(s), 0) / 4 * 10 * exp(-((len(pw) - len(rw)) * (len(pw) - len(rw))) / 72.0::DOUBLE) AS s FROM pr LEFT JOIN s USING (tiou, video_id, j, i) GROUP BY pr.tiou, pr.video_id, pr.j, pr.i, pw, rw)
SELECT round_even(avg(x), 2) AS score FROM (SELECT tiou, avg(v) * 100 AS x FROM (SELECT tiou, video_id, avg(s) AS v FROM q GROUP BY 1, 2) GROUP BY 1)""")
def a23_cider(t):
    return ca.mean_over_videos(ca.cider(title_pairs(t)))


GRID_SQL = f"""{SEGS_SQL},
wd AS (SELECT 'r' AS side, video_id, start_s, list_distinct(string_split(title, ' ')) AS w FROM ref UNION ALL SELECT 'p', video_id, start_s, list_distinct(string_split(title, ' ')) FROM pred),
tx AS (SELECT p.*, coalesce(len(list_intersect(r.w, q.w)) / nullif(len(list_distinct(r.w || q.w)), 0)::DOUBLE, 0) AS text FROM pairs p LEFT JOIN wd r ON r.side = 'r' AND r.video_id = p.video_id AND r.start_s = p.rs LEFT JOIN wd q ON q.side = 'p' AND q.video_id = p.video_id AND q.start_s = p.ps),
thr AS (SELECT unnest([0.0, 0.3, 0.5])::DOUBLE AS t),
gr AS (SELECT video_id, n_ref, n_pred, t, i, list(CASE WHEN iou >= t THEN iou ELSE 0 END ORDER BY j) AS s, list(coalesce(text, 0) ORDER BY j) AS x FROM (
  SELECT c.*, thr.t, gi.i, gj.j, coalesce(tx.iou, 0) AS iou, tx.text FROM cnt c, thr, LATERAL (SELECT unnest(range(n_ref)) AS i) gi, LATERAL (SELECT unnest(range(n_pred)) AS j) gj
  LEFT JOIN tx ON tx.video_id = c.video_id AND tx.i = gi.i AND tx.j = gj.j WHERE n_ref > 0) GROUP BY ALL),
kd AS (SELECT gr.* REPLACE (CASE WHEN kind = 'mix' THEN list_transform(list_zip(s, x), lambda z: z[1] * z[2]) ELSE s END AS s), kind FROM gr, (SELECT unnest(['iou', 'mix']) AS kind)),
f AS (
  SELECT video_id, t, kind, -1::BIGINT AS i, []::DOUBLE[] AS before, []::DOUBLE[] AS now, []::DOUBLE[] AS s FROM (SELECT DISTINCT video_id, t, kind FROM kd)
  UNION ALL SELECT k.video_id, k.t, k.kind, k.i, f.now, list_reduce(list_transform(range(1, k.n_pred + 1), lambda j: [j::DOUBLE]), lambda acc, e: list_append(acc, greatest(coalesce(f.now[e[1]::BIGINT], -1), coalesce(acc[e[1]::BIGINT - 1], -1),
    k.s[e[1]::BIGINT] + CASE WHEN e[1] > 1 THEN coalesce(f.now[e[1]::BIGINT - 1], 0) ELSE 0 END)), []::DOUBLE[]), k.s
  FROM f JOIN kd k ON k.video_id = f.video_id AND k.t = f.t AND k.kind = f.kind AND k.i = f.i + 1),
tk AS (SELECT f.video_id, f.t, f.i, n_ref, n_pred, x, list_filter(range(1, n_pred + 1), lambda j: f.s[j] + CASE WHEN j > 1 THEN coalesce(before[j - 1], 0) ELSE 0 END > greatest(coalesce(before[j], -1), coalesce(now[j - 1], -1))) AS take
  FROM f JOIN gr USING (video_id, t, i) WHERE kind = 'iou'),
bk AS (
  SELECT video_id, t, max(n_ref) - 1 AS i, max(n_pred) AS j, 0.0::DOUBLE AS total FROM tk GROUP BY 1, 2
  UNION ALL SELECT video_id, t, i - 1, CASE WHEN p IS NULL THEN j ELSE p - 1 END, total + CASE WHEN p IS NULL THEN 0 ELSE x[p] END
  FROM (SELECT bk.*, x, list_max(list_filter(take, lambda c: c <= bk.j)) AS p FROM bk JOIN tk ON tk.video_id = bk.video_id AND tk.t = bk.t AND tk.i = bk.i WHERE bk.i >= 0 AND bk.j > 0)),
sc AS (SELECT video_id, t, unnest(['a', 'b']) AS variant, max(total) AS score FROM bk GROUP BY 1, 2
  UNION ALL SELECT video_id, t, CASE kind WHEN 'iou' THEN 'd' ELSE 'c' END, max(now[len(now)]) FROM f GROUP BY video_id, t, kind),
al AS (SELECT variant, t, n_ref, n_pred, coalesce(score, 0) AS score FROM cnt CROSS JOIN thr CROSS JOIN (SELECT unnest(['a', 'b', 'c', 'd']) AS variant) LEFT JOIN sc USING (video_id, t, variant) WHERE n_ref > 0)
"""


@query("a22_alignment_score", "ref pred", f"""WITH RECURSIVE {GRID_SQL}
SELECT variant, t AS threshold, round_even(avg(p) * 100, 2) AS p, round_even(avg(r) * 100, 2) AS r, round_even(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) * 100, 2) AS f1
FROM (SELECT variant, t, CASE WHEN n_pred > 0 THEN score / n_pred ELSE 0 END AS p, CASE WHEN n_pred > 0 THEN score / n_ref ELSE 0 END AS r FROM al) GROUP BY 1, 2""")
def a22(t):
    """All four variants at thresholds 0, 0.3 and 0.5; the text score is the share of title words in common."""
    r, p = sides(t)
    counts = me.side_counts(r, p).where("n_ref > 0")
    titles = lambda df, k: df.select("video_id", F.col("start_s").cast("double").alias(f"{k}s"), F.array_distinct(F.split("title", " ")).alias(f"{k}w"))
    named = me.iou_pairs(r, p).join(titles(t.ref, "r"), ["video_id", "rs"], "left").join(titles(t.pred, "p"), ["video_id", "ps"], "left")
    empty = F.array().cast("array<string>")
    scored = named.withColumn("text", tx.jaccard(F.coalesce("rw", empty), F.coalesce("pw", empty)))
    return ca.alignment(scored, counts, (0.0, 0.3, 0.5)).groupBy("variant", "threshold").agg(*[F.bround(F.avg(c) * 100, 2).alias(c) for c in ("p", "r", "f1")])


# Terms a misread word is snapped to.
TERMS = ["Jupyter", "Anaconda", "Google", "Python", "Assistant", "Untitled", "Login", "Distribution", "Manage", "Trusted", "Packages", "Environments", "Navigator", "Colab", "Drive"]


TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


def misread(t):
    """Distinct words; one in nine is a term with a letter left out, and every second of these gets the word's own first letter at its end."""
    # each different word once, before it is hashed; the optimizer would leave out a distinct before another one
    words = checkpointed(t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("w")).distinct())
    at = lambda i: F.conv(F.substring(F.md5("w"), i, 6), 16, 10).cast("int")
    term = F.get(F.array(*[F.lit(x) for x in TERMS]), at(7) % len(TERMS))
    hole = at(13) % F.length(term)
    cut = F.concat(F.substring(term, F.lit(1), hole), F.substring(term, hole + 2, F.length(term)), F.when(at(19) % 2 == 0, F.substring("w", 1, 1)).otherwise(""))
    return words.select(F.when(at(1) % 9 == 0, cut).otherwise(F.col("w")).alias("w")).distinct()


@query("x15_lexicon_snap", "", f"""WITH RECURSIVE
w0 AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x0b\\x85]+'), lambda x: x <> '')) AS w FROM documents),
w1 AS (SELECT w, ('0x' || substr(md5(w), 1, 6))::INT AS h1, {TERMS_SQL}[('0x' || substr(md5(w), 7, 6))::INT % {len(TERMS)} + 1] AS term, ('0x' || substr(md5(w), 13, 6))::INT AS h3, ('0x' || substr(md5(w), 19, 6))::INT AS h4 FROM w0),
w2 AS (SELECT DISTINCT CASE WHEN h1 % 9 = 0 THEN substr(term, 1, h3 % length(term)) || substr(term, h3 % length(term) + 2) || CASE WHEN h4 % 2 = 0 THEN substr(w, 1, 1) ELSE '' END ELSE w END AS w FROM w1),
lat AS (SELECT w FROM w2 WHERE length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 0.7::DOUBLE * length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) AND regexp_matches(w, '\\p{{L}}')),
p0 AS (SELECT w, t AS a, length(t) AS na, length(w) AS nb FROM lat, (SELECT unnest({TERMS_SQL}) AS t)),
p AS (SELECT * FROM p0 WHERE 2 * least(na, nb) >= 0.82::DOUBLE * (na + nb) - 1e-9
  AND 2 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(na - length(replace(a, c, '')), nb - length(replace(w, c, ''))))) >= 0.82::DOUBLE * (na + nb) - 1e-9),
r AS (
  SELECT w, a, 0 AS alo, na AS ahi, 0 AS blo, nb AS bhi, 0 AS k FROM p
  UNION ALL
  SELECT w, a, CASE WHEN side = 1 THEN alo ELSE i + n END, CASE WHEN side = 1 THEN i ELSE ahi END, CASE WHEN side = 1 THEN blo ELSE j + n END, CASE WHEN side = 1 THEN j ELSE bhi END, CASE WHEN side = 1 THEN n ELSE 0 END
  FROM (SELECT *, code_n AS n, (code_n * 1000000 - code) // 1000 AS i, (code_n * 1000000 - code) % 1000 AS j FROM (SELECT *, (code + 999999) // 1000000 AS code_n FROM (
    SELECT r.*, list_max(list_concat([0], flatten(list_transform(range(alo, ahi), lambda x: list_transform(range(blo, bhi), lambda y:
      len(list_filter(range(1, least(ahi - x, bhi - y) + 1), lambda z: substr(a, x + 1, z) = substr(w, y + 1, z))) * 1000000 - x * 1000 - y))))) AS code FROM r WHERE alo < ahi AND blo < bhi))) q, (SELECT unnest([1, 2]) AS side)
  WHERE n > 0),
s AS (SELECT w, a, 2.0::DOUBLE * sum(k) / (length(a) + length(w)) AS ratio FROM r GROUP BY w, a),
b AS (SELECT w, arg_max(a, (ratio, a)) AS a FROM s WHERE ratio >= 0.82::DOUBLE GROUP BY w)
SELECT w2.w, coalesce(b.a, w2.w) AS snapped FROM w2 LEFT JOIN b USING (w)""")
def x15(t):
    return snap(misread(t), TERMS)


@query("t6_training_window", "ref", f"""
WITH b AS (SELECT DISTINCT video_id, start_s FROM (SELECT video_id, start_s FROM ref UNION ALL SELECT DISTINCT video_id, 0 FROM ref)),
u AS (SELECT video_id, start_s, row_number() OVER (PARTITION BY video_id ORDER BY start_s) - 1 AS place FROM b),
c AS (SELECT video_id, arg_max(start_s, ln((CAST('0x' || substr(md5(video_id || ':' || place || ':11'), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE) / pow(0.8::DOUBLE, place)) AS w0 FROM u GROUP BY 1),
l AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS i, CAST(floor(start_s) AS BIGINT) AS sec, {HMS_SQL.format("CAST(floor(start_s) AS BIGINT)")} || ': ' || text AS line FROM evs),
k AS (SELECT l.*, w0, {TOK_SQL.format('line')} AS tok FROM l JOIN c USING (video_id)),
r AS (SELECT *, sum(CASE WHEN sec >= w0 THEN tok ELSE 0 END) OVER (PARTITION BY video_id ORDER BY i) AS run, sum(tok) OVER (PARTITION BY video_id) <= 150 AS whole FROM k),
t AS (SELECT video_id, max(whole::INT) = 1 AS whole, arg_max(sec, i) AS fin FROM r WHERE whole OR (sec >= w0 AND run <= 150) GROUP BY 1)
SELECT ref.video_id, CAST(CASE WHEN whole THEN 0 ELSE w0 END AS BIGINT) AS w0, whole, {HMS_SQL.format("CAST(start_s - CASE WHEN whole THEN 0 ELSE w0 END AS BIGINT)")} || ' - ' || title AS answer
FROM ref JOIN c USING (video_id) JOIN t USING (video_id) WHERE whole OR (start_s >= w0 AND start_s <= fin)""")
def t6(t):
    """Events stand in for the transcript, so that videos lie on both sides of the budget."""
    b = ch.add_zero(t.ref.select("video_id", "start_s", "duration"))
    rows = scan(density_blocks(t.evs.select("video_id", "event_id", "start_s", "text"), ["video_id"], "start_s", tie="event_id"), ["video_id"], ["start_s", "event_id"], number="seg_idx")
    lines = rows.select("video_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.floor("start_s").alias("stamp_s"), F.concat(sec_to_hms(F.floor("start_s")), F.lit(": "), "text").alias("line"))
    return ch.training_window(lines, tx.chunk_tokens(F.col("line")), b, t.ref, seed=11, budget=150)
