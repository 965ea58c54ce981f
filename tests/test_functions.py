"""Scalar rules on literals: Han text, bad stamps, broken JSON, option lists."""

import random

import pytest
from pyspark.sql import functions as F

from cuewise.functions import chapterlines as cl
from cuewise.functions import jsontext as js
from cuewise.functions import text as tx
from cuewise.functions import timefmt as tf


def values(spark, rows, expr, schema="a string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


BAD = ["01:02:03", "02:03", "1:2:3", "00:90:00", "00:00:60", "abc", "", None, "00:01:02.5", "77"]


@pytest.mark.parametrize("policy,want", [
    ("zero", [3723, 123, 3723, 5400, 60, 0, 0, 0, 0, 0]),
    ("null", [3723, 123, 3723, 5400, 60, None, None, None, None, None]),
    ("strict", [3723, -1, 3723, -1, -1, -1, -1, -1, -1, -1]),
    ("two_part", [3723, 123, 3723, -1, -1, -1, -1, -1, -1, -1]),
    ("decimal", [3723.0, 123.0, 3723.0, None, None, None, None, None, 62.5, 77.0]),
])
def test_clock_policies(spark, policy, want):
    assert values(spark, BAD, tf.hms_to_sec(F.col("a"), policy)) == want


def test_seconds_to_clock(spark):
    assert values(spark, [0.0, 59.9, 3661.0, -5.0, 360000.0], tf.sec_to_hms(F.col("a")), "a double") == ["00:00:00", "00:00:59", "01:01:01", "00:00:00", "100:00:00"]
    assert values(spark, [61.0, 3661.0], tf.sec_to_hms(F.col("a"), short=True), "a double") == ["01:01", "01:01:01"]


def test_stamp_forms(spark):
    assert values(spark, ["5:07", "1:2:3", "x", "1:2:3:4"], tf.normalize_stamp(F.col("a"))) == ["00:05:07", "01:02:03", "x", "1:2:3:4"]
    assert values(spark, [" 00:01:02 ", "0:1:2", None], tf.is_hms(F.col("a"))) == [True, False, False]


def test_token_estimates_with_han(spark):
    texts = ["中文字", "中文 and more", "㐀㐁x", "", "😀ab", None]
    assert values(spark, texts, tx.chunk_tokens(F.col("a"))) == [4, 5, 3, 0, 0, 0]
    assert values(spark, texts, tx.prompt_tokens(F.col("a"))) == [4, 4, 1, 0, 1, 0]


def test_collapse_and_limit(spark):
    got = values(spark, ["go go go go on", "a b a b", "哈哈哈哈", "one two"], tx.collapse_phrases(F.col("a")))
    assert got == ["go on", "a b a b", "哈", "one two"]


def test_normalize_line(spark):
    assert values(spark, ["-- what??! ok --", "測試 測試", "a  b", "——"], tx.normalize_line(F.col("a"))) == ["what? ok", "測試", "a b", ""]


def test_normalize_line_at_its_edges(spark):
    """As with every pattern over every line, also before the line ends that Java's `$` knows."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ab  -–—\t\r\n\u0085\u2028\u3000\x0b\x1c?？！!、,…．。漢😀x") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9]))) for _ in range(3000)]
    c = F.regexp_replace(F.col("a"), f"([{tx.PUNCT}])[{tx.PUNCT}]+", "$1")
    c = F.regexp_replace(c, r"(?U)^([\x{4e00}-\x{9fff}A-Za-z0-9\-_]+)(?:\s+\1)+$", "$1")
    c = tx.strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\s{2,}", " "), r"^[ \t\-–—]+|[ \t\-–—]+$", ""))
    assert values(spark, texts, tx.normalize_line(F.col("a"))) == values(spark, texts, c)


def test_titles(spark):
    assert values(spark, ["那個主題介紹。", "所以ab", "A  title!"], tx.clean_title(F.col("a"))) == ["個主題介紹", "所以ab", "A title"]
    assert values(spark, ["[模組] 內容", "[solo]", "單元3：天花板"], tx.client_title(F.col("a"))) == ["模組 - 內容", "solo", "天花板"]


def test_script_mapping(spark):
    assert values(spark, ["图书门", "abc"], tx.to_traditional(F.col("a"))) == ["圖書門", "abc"]


def test_similarity_of_han_text(spark):
    rows = [("天花板大樣圖", "天花板圖例"), ("red blue", "blue green"), ("", "")]
    got = values(spark, rows, tx.text_jaccard(F.col("a"), F.col("b")), "a string, b string")
    assert got == pytest.approx([2 / 7, 1 / 3, 0.0])


def test_low_information(spark):
    rows = ["x", "def run():", "see https://a.org", "word", "go go go go", "aaaa bbbb", "open settings now", "useful words here"]
    assert values(spark, rows, tx.is_low_information(F.col("a"))) == [True, False, False, True, True, False, True, False]


def test_token_keep_rule(spark):
    rows = [("word", 0.6, 10.0), ("word", 0.59, 10.0), ("中文字幕", 0.55, 10.0), ("中文", 0.6, 10.0), ("中文", 0.75, 10.0), ("word", 0.9, 90.0)]
    assert values(spark, rows, tx.keep_token(F.col("a"), F.col("b"), F.col("c"), F.lit(100.0)), "a string, b double, c double") == [True, False, True, False, True, False]


def test_budget_prefix_and_head(spark):
    text = "一二三。四五六！seven eight."
    assert values(spark, [text], tx.budget_prefix(F.col("a"), 4)) == ["一二三。"]
    assert values(spark, ["ab\ncd\nef"], tx.head_lines(F.col("a"), F.lit(6))) == ["ab\ncd"]
    assert values(spark, ["abcdefgh\nx"], tx.head_lines(F.col("a"), F.lit(4))) == ["abcd"]


# Fixed value: a reply with its chapter lines.
REPLY = """00:19:19 - 登入 Google 帳戶
00:21:27 - 課程介紹與簽到流程
00:23:02 - 課程目標與證照考取
00:24:28 - 開課問卷與學員上傳區
00:27:01 - Python 程式設計概論
00:28:07 - 安裝與設定 Jupyter Notebook
00:30:31 - 基本 Python 語法練習
00:35:14 - 使用 Jupyter Notebook 進行程式開發
00:40:11 - 使用 ChatGPT 進行程式碼輔助
00:43:01 - 資料型態與基本運算
00:47:29 - 文字轉整數與年齡計算
00:52:16 - CSV 檔案寫入與資料庫應用
02:09:34 - 課後練習與資料寫入
02:28:03 - 課程總結與未來學習方向
"""


def chapters_of(spark, text, variant="current"):
    df = spark.createDataFrame([("v", text)], "video_id string, reply string")
    return [(r["stamp"], r["title"]) for r in cl.parse_chapters(df, "video_id", "reply", variant).orderBy("pos").collect()]


def test_reply_of_fourteen_lines(spark):
    got = chapters_of(spark, REPLY)
    assert len(got) == 14 and got[0] == ("00:19:19", "登入 Google 帳戶") and got[-1] == ("02:28:03", "課程總結與未來學習方向")


def test_chapter_line_fallbacks(spark):
    assert chapters_of(spark, "* [5:07] Intro\n1:02:03: Next\n5:07 again") == [("00:05:07", "Intro"), ("01:02:03", "Next")]
    assert chapters_of(spark, "at 5:07 we start\nno stamp", "legacy") == [("00:05:07", "we start")]
    text = "00:00:00 Introduction - good\n00:05:30 - 00:05:33: Second Chapter\n00:05:33: Another Chapter\n00:90:00 - Wrong time\n00:39:00 - What is this?"
    assert chapters_of(spark, text, "clock") == [("00:00:00", "Introduction - good"), ("00:05:30", "Second Chapter"), ("00:05:33", "Another Chapter"), ("00:39:00", "What is this?")]


def test_json_in_prose(spark):
    rows = ['x ```json\n{"k": 1}\n``` y', '```\n[1]\n```', ' {"k": 2} ', 'so {"k": 3} it is', "list [1, 2] end", "none", ""]
    assert values(spark, rows, js.json_blob(F.col("a"))) == ['{"k": 1}', "[1]", '{"k": 2}', '{"k": 3}', "[1, 2]", None, None]
    rows = ["{“k”: 1}", '{"k": 1} tail', '```json\n{"k": 2}\n```', "bad"]
    assert values(spark, rows, js.repaired_json(F.col("a"))) == ['{"k": 1}', None, '{"k": 2}', None]


def test_question_fields(spark):
    doc = '{"question": "q", "options": "only", "correct_option": "C", "difficulty": "HARD", "course_type": "設計", "tags": [" a ", "", "b", "c", "d", "e", "f"]}'
    f = js.question_fields(F.parse_json(F.lit(doc)))
    row = spark.range(1).select(*[v.alias(k) for k, v in f.items()]).first()
    assert row.asDict() == {"question": "q", "options": ["only"], "correct_answer": "C", "difficulty": "hard", "course_type": "設計", "tags": ["a", "b", "c", "d", "e"]}


def test_option_shuffle_keeps_the_answer(spark):
    df = spark.createDataFrame([(["w", "x", "y", "z"], "C", "正確答案是 C，因為")], "o array<string>, c string, e string")
    for seed in range(5):
        order, label, expl = js.shuffled(F.col("o"), F.col("c"), F.col("e"), seed)
        r = df.select(order.alias("o"), label.alias("l"), expl.alias("e")).first()
        assert sorted(r["o"]) == ["w", "x", "y", "z"] and r["o"]["ABCD".index(r["l"])] == "y" and r["e"].startswith(f"正確答案是 {r['l']}")


def test_option_hygiene(spark):
    df = spark.createDataFrame([(["A", "B", "C"], [" x", "x ", ""], "B")], "l array<string>, t array<string>, c string")
    options, label = js.tidy_options(F.col("l"), F.col("t"), F.col("c"))
    r = df.select(options.alias("o"), label.alias("l")).first()
    assert r["o"] == ["x", "（選項補齊）2", "（選項補齊）3", "（選項補齊）4"] and r["l"] == "A"
