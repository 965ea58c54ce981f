"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewise.operators.barrier import let

# The two Han ranges of the chunk estimator, and the one range of the prompt estimator.
HAN_WIDE = "[\\u4e00-\\u9fff\\u3400-\\u4dbf]"
HAN = "[\\u4e00-\\u9fff]"


def strip(c: Column) -> Column:
    """Trim any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def chunk_tokens_of(han: Column, length: Column) -> Column:
    """Chunk token estimate from counts, so joined text need not be built."""
    return F.floor(han * F.lit(1.5) + (length - han) * F.lit(0.3)).cast("long")


def chunk_tokens(text: Column) -> Column:
    """1.5 per Han character and 0.3 per other character, cut to whole tokens."""
    text = F.coalesce(text, F.lit(""))
    return chunk_tokens_of(count_of(text, HAN_WIDE), F.length(text).cast("long"))


def prompt_tokens(text: Column) -> Column:
    """One per Han character plus a quarter per other character, at least 1 for the rest."""
    text = F.coalesce(text, F.lit(""))
    han = count_of(text, HAN)
    rest = F.greatest(F.lit(1).cast("long"), F.floor((F.length(text) - han) / 4))
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(han + rest)


# Overlay and boilerplate patterns of slide and speech text. A look at the next character spares most places the rest.
CLOCK_OVERLAY = r"(?U)(?=\d)\b\d{2}:\d{2}:\d{2}\b"
DATE_OVERLAY = r"(?U)(?=\d)\b(?:\d{4}/\d{1,2}/\d{1,2}|202\d-\d{1,2}-\d{1,2})\b"
DEGREE_OVERLAY = r"(?U)[℃°]\s*\S*"
WATERMARKS = r"(?U)(?:聯成電腦|Amara\.org|Google|msn)\S*"
SUBTITLE_CREDIT = r"(?U)(字幕由\s*Amara\.org\s*社群提供\s*){2,}"


def squeeze(c: Column) -> Column:
    """Runs of two or more white space characters become one space; ends trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def clean_slide_text(c: Column, watermarks: bool = False) -> Column:
    for pattern in (CLOCK_OVERLAY, DATE_OVERLAY, DEGREE_OVERLAY) + ((WATERMARKS,) if watermarks else ()):
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(c)


def clean_speech_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, SUBTITLE_CREDIT, " "))


# Filler words and end marks cut from titles, and unit prefixes.
FILLERS = ["那", "所以", "這個", "那個", "就是", "呢", "啊", "喔", "然後", "接著"]
TITLE_END = r"[。，“”、！？\.!?,]+$"
LEGACY_TITLE_END = r"[。，、！？]+$"
TOPIC_END = r"(?U)[，。；、\s]+$"
CLIENT_PREFIX = r"(?U)^\s*單元\s*\d+\s*[-－–—:：]\s*"


def clean_title(title: Column, legacy: bool = False) -> Column:
    """Title without fillers, end marks and double spaces. Under four characters: back to the
    original (legacy: capitalised instead)."""
    c = title
    for word in FILLERS:
        c = F.replace(c, F.lit(word), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(strip(c), LEGACY_TITLE_END if legacy else TITLE_END, ""), r"(?U)\s+", " ")
    short = (F.length(c) > 0) & (F.length(c) < 4)
    return F.when(short, F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 4))) if legacy else strip(title)).otherwise(c)


def client_title(title: Column) -> Column:
    """`[tag] body` becomes `tag - body`; then the unit prefix goes."""
    t = strip(title)
    tag, body = strip(F.regexp_extract(t, r"^\[([^\]]*)\]", 1)), strip(F.regexp_replace(t, r"^\[[^\]]*\]", ""))
    joined = F.when(t.rlike(r"^\[[^\]]*\]"), F.when(body != "", F.concat(tag, F.lit(" - "), body)).otherwise(tag)).otherwise(t)
    return strip(F.regexp_replace(joined, CLIENT_PREFIX, ""))


def topic_title(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(title), r"(?U)\s+", " "), TOPIC_END, "")


def collapse_phrases(text: Column, min_repeat: int = 3) -> Column:
    """A chunk repeated at least `min_repeat` times in a row becomes one."""
    # fixed value: the repeated-phrase pattern
    return F.regexp_replace(text, r"(?U)((\S+)(?:\s*\2){%d,})" % (min_repeat - 1), "$2")


# End punctuation of a merged segment, leading junk, and punctuation runs of slide lines.
SENTENCE_END = r"(?U)[。．！!？?：:；;」”\.,\)]\s*$"
LEADING_JUNK = r"(?U)^[\s:：,\-–—·.。!！?？]+"
PUNCT = "?？!！、,…．。"


def ends_sentence(text: Column) -> Column:
    return strip(text).rlike(SENTENCE_END)


def strip_leading_junk(text: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(text, r"(?U)\s+", " ")), LEADING_JUNK, "")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7f]", " ")


def normalize_line(text: Column) -> Column:
    """Punctuation runs to their first mark, a repeated word to one, outer dashes and spaces off.

    Most lines have no such runs or edges, so a plainer look comes first. Java's `$` also stands before a last line end of
    at most two characters: what ends a line is among its last three.
    """

    def where(seen: Callable[[Column], Column], change: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda c: F.when(seen(c), change(c)).otherwise(c)

    edges = lambda c: F.concat(F.substring(c, 1, 1), F.substring(c, -3, 3))
    c = let(where(lambda c: c.rlike(f"[{PUNCT}][{PUNCT}]"), lambda c: F.regexp_replace(c, f"([{PUNCT}])[{PUNCT}]+", "$1")), text)
    # fixed value: the doubled-word pattern
    c = F.regexp_replace(c, r"(?U)^([\x{4e00}-\x{9fff}A-Za-z0-9\-_]+)(?:\s+\1)+$", "$1")
    c = F.regexp_replace(c, r"(?U)\s{2,}", " ")
    c = let(where(lambda c: edges(c).rlike(r"[ \t\-–—]"), lambda c: F.regexp_replace(c, r"^[ \t\-–—]+|[ \t\-–—]+$", "")), c)
    return let(where(lambda c: edges(c).rlike(r"(?U)\s"), strip), c)


def tokens(text: Column) -> Column:
    """White-space tokens; none for blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits. The share of each different character is what the text
    loses without it, so nothing is sorted and no character becomes a row."""

    def bits(t: Column, chars: Column) -> Column:
        shares = F.transform(chars, lambda ch: (F.octet_length(t) - F.octet_length(F.replace(t, ch, F.lit("")))) / F.octet_length(ch) / F.char_length(t))
        return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p + F.lit(1e-12)))

    return F.when(F.length(text) > 0, let(bits, text, F.array_remove(F.array_distinct(F.split(text, "")), ""))).otherwise(F.when(text.isNotNull(), 0.0))


def repeat_ratio(text: Column) -> Column:
    return let(lambda t: F.when(F.size(t) <= 1, 1.0).otherwise(1.0 - F.size(F.array_distinct(t)) / F.size(t)), tokens(text))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def ascii_letter_ratio(text: Column) -> Column:
    return _share(count_of(text, "[A-Za-z]"), count_of(text, r"\p{L}"))


def caps_ratio(text: Column) -> Column:
    return _share(count_of(text, r"\p{Lu}"), count_of(text, r"\p{L}"))


def unique_line_ratio(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), strip), lambda x: x != "")
    return let(lambda x: _share(F.size(F.array_distinct(x)), F.size(x)), lines)


# Signs of code, and of overlays counted as junk.
CODE_SIGNS = [r"`[^`]+`", r"(?md):\s*$", r"(?U)\b(def|class|if|else|for|while|print)\b", r"\{|\}|\[|\]|\(|\)", r"(?md)^\s{2,}\S", r"(?md)^\s*#"]
JUNK = r"(?:\d{2}:\d{2}:\d{2})|(?:\d{4}/\d{1,2}/\d{1,2})|(?:℃)|(?:https?://\S+)"


def code_likeness(text: Column) -> Column:
    hits = sum((text.rlike(p).cast("int") for p in CODE_SIGNS), F.lit(0))
    return F.least(F.lit(1.0), hits / len(CODE_SIGNS))


def _per_120(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 120))


def junk_ratio(text: Column) -> Column:
    return F.least(F.lit(1.0), count_of(text, JUNK) / _per_120(text))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def slide_quality(text: Column) -> Column:
    return _clamp(0.45 * F.least(F.lit(1.0), F.length(text) / 2500.0) + 0.25 * code_likeness(text) + 0.20 * unique_line_ratio(text) - 0.20 * junk_ratio(text))


def speech_quality(text: Column) -> Column:
    uniq = unique_line_ratio(text)
    marks = F.least(F.lit(1.0), count_of(text, "[。！？.!?,，]") / _per_120(text))
    return _clamp(0.50 * F.least(F.lit(1.0), F.length(text) / 3000.0) + 0.25 * marks + 0.20 * uniq - 0.15 * (1.0 - uniq))


def source_weights(slides: Column, speech: Column, sim: Column, q_slides: Column, q_speech: Column, floor: float = 0.25, ceil: float = 0.75) -> tuple[Column, Column, Column]:
    """Weights of slide and speech text and the agreement used. One side empty: floor or ceiling;
    a short side (< 200): plain quality shares; else shares scaled by agreement."""
    has_a, has_b = F.length(slides) > 0, F.length(speech) > 0
    short = (F.length(slides) < 200) | (F.length(speech) < 200)
    total = q_slides + q_speech
    plain = F.greatest(F.lit(floor), F.least(F.lit(ceil), q_slides / F.when(total == 0, 1.0).otherwise(total)))
    f = 0.5 + 0.5 * sim
    wt = q_slides * f + q_speech * f
    scaled = F.least(F.lit(ceil), F.greatest(F.lit(floor), q_slides * f / F.when(wt == 0, 1.0).otherwise(wt)))
    w = (F.when(~has_a & has_b, F.lit(floor)).when(~has_b & has_a, F.lit(ceil)).when(short & has_a & has_b, plain).when(short, F.lit(floor)).otherwise(scaled))
    return w, 1.0 - w, F.when(short, 0.0).otherwise(sim)


# Fixed value: a word of the title rules.
WORD = r"(?U)\b[\w\-]+\b"


# Fixed value: words of a title, for the comparison of neighbouring titles.
TITLE_WORDS = r"(?U)[\x{4e00}-\x{9fff}]+|\b[a-zA-Z0-9_]+\b"


def title_likeness(text: Column) -> Column:
    """0 to 1: few marks, about six words, capitals help, small numbers hurt."""
    t = strip(text)
    w = count_of(t, WORD)
    marks = 1.0 - count_of(t, "[,:;.!?]") / F.greatest(F.lit(1), F.length(t))
    size = 1.0 - F.least(F.abs(w - 6) / 10, F.lit(1.0))
    score = 0.55 * marks + 0.35 * size + F.when(caps_ratio(t) > 0.35, 0.3).otherwise(0.0) - F.when(t.rlike(r"(?U)\b\d{1,2}\b"), 0.15).otherwise(0.0)
    return F.when(w == 0, 0.0).otherwise(_clamp(score))


def gated_fusion(slide: Column, speech: Column, conf: Column, changed: Column, gate_at: float = 0.65) -> tuple[Column, Column, Column]:
    """(fused text, strategy, gate): a header-like slide leads and the speech is cut to 500 characters."""
    gate = (0.6 * title_likeness(slide) + 0.4 * F.coalesce(conf, F.lit(0.5))) + F.when(changed, 0.1).otherwise(0.0)
    lead = F.concat(F.lit("[OCR_HEADER]\n"), strip(slide), F.lit("\n\n[ASR_SUMMARY]\n"), F.substring(strip(speech), 1, 500))
    even = F.concat(F.lit("[OCR_TEXT]\n"), strip(slide), F.lit("\n\n[ASR_TEXT]\n"), strip(speech))
    return F.when(gate >= gate_at, lead).otherwise(even), F.when(gate >= gate_at, "OCR_DOMINANT").otherwise("BALANCED"), gate


def head_lines(text: Column, limit: Column) -> Column:
    """Whole lines from the top within `limit` characters; a longer first line is cut instead."""
    lines = F.split(text, r"\r\n|\n|\r")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"), F.lit(True).alias("go"))

    def step(acc, ln):
        size = acc["total"] + F.length(ln) + 1
        ok = acc["go"] & (size <= limit)
        return F.struct(F.when(ok, size).otherwise(acc["total"]).alias("total"), (acc["n"] + ok.cast("int")).alias("n"), ok.alias("go"))

    n = F.aggregate(lines, zero, step)["n"]
    cut = F.array_join(F.slice(lines, F.lit(1), n), "\n")
    return F.when(F.length(text) <= limit, text).when((n > 0) & (cut != ""), cut).otherwise(F.substring(text, F.lit(1), limit.cast("int")))


def budget_prefix(text: Column, budget: int) -> Column:
    """Sentences from the start while their token sum stays within the budget."""
    parts = F.split(text, "(?<=[。！？.!?])")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"))

    def step(acc, s):
        total = acc["total"] + prompt_tokens(s)
        return F.struct(total.alias("total"), (acc["n"] + (total <= budget).cast("int")).alias("n"))

    n = F.aggregate(parts, zero, step)["n"]
    return F.when(prompt_tokens(text) <= budget, text).otherwise(F.array_join(F.slice(parts, F.lit(1), n), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays; 0 for two empty ones."""

    def score(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)

    return let(score, a, b)


def bigrams(text: Column) -> Column:
    """Different pairs of neighbouring characters, from one list of the characters."""

    def pairs(t: Column) -> Column:
        two = F.transform(F.slice(t, F.lit(1), F.size(t) - 1), lambda c, i: F.concat(c, F.get(t, i + 1)))
        return F.when(F.size(t) >= 2, F.array_distinct(two)).otherwise(F.array().cast("array<string>"))

    return let(pairs, F.split(strip(text), ""))


# Fixed value: Han characters of the similarity rules.
HAN_ANY = "[\\u3400-\\u9fff]"


def text_jaccard(a: Column, b: Column) -> Column:
    """Character bigrams when either side holds Han characters, else white-space tokens."""
    return F.when(a.rlike(HAN_ANY) | b.rlike(HAN_ANY), jaccard(bigrams(a), bigrams(b))).otherwise(jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b))))


def relevance(topics: Column, keywords: Column) -> Column:
    """Jaccard of two word sets plus 0.1 when any word holds or is held by one of the other side."""
    clean = lambda arr: F.array_distinct(F.filter(F.transform(arr, lambda x: F.lower(F.trim(x))), lambda x: x != ""))

    def score(g: Column, c: Column) -> Column:
        # a word that both have decides at once; else each is sought in all words of the other side, put together
        held = lambda words, by: let(lambda text: F.exists(words, lambda x: F.contains(text, x)), F.concat(F.lit("\0"), F.array_join(by, "\0")))
        near = F.arrays_overlap(g, c) | held(g, c) | held(c, g)
        value = F.least(F.lit(1.0), jaccard(g, c) + F.when(near, 0.1).otherwise(0.0))
        return F.when((F.size(g) == 0) | (F.size(c) == 0), 0.0).otherwise(value)

    return let(score, clean(topics), clean(keywords))


# Administrative chatter. The first character is looked at first; no other character folds to one of these letters.
ADMIN = (r"(?=[zZmMpPlL\u4e00-\u9fff])(?iU)(?:\bzoom\b|\bmeeting id\b|\bpasscode\b|\blog[\s-]?in\b|出勤|請假|排程|課程公告|麥克風|鏡頭|連線問題|投影|錄影設定)")
ADMIN_WORD = r"(?iU)\b(id|passcode|join|record|mute|unmute|link|網址)\b"
DOMAIN_WORD = r"(?iU)\b(class|function|api|dataset|變數|函式|圖層|製圖|建模|演算法|模型)\b"
ADMIN_TAIL = r"(?=[mMpPzZuUrRjJlL網])(?i)(meeting id|passcode|zoom|mute|unmute|record|join|link|網址)[^\n]*"


def is_admin(text: Column) -> Column:
    return text.rlike(ADMIN) | ((count_of(text, ADMIN_WORD) >= 2) & (count_of(text, DOMAIN_WORD) == 0))


def scrub_admin(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(text, ADMIN, " "), ADMIN_TAIL, " "))


# Simplified characters of the fallback table and their traditional forms.
SIMPLIFIED = "体台后广画录观面发门问类网图书记读党术层约"
TRADITIONAL = "體臺後廣畫錄觀麵發門問類網圖書記讀黨術層約"


def to_traditional(c: Column) -> Column:
    return F.translate(c, SIMPLIFIED, TRADITIONAL)


# What marks a slide line as code, link, mail, measure or date, and words of screen furniture.
CODE_HEADS = ["def ", "class ", "import ", "from ", "for ", "while ", "if ", "elif ", "else:", "return "]
CODE_CHARS = r"""[_()\[\]{}=:.<>+\-*/%|&!^,@'"\\]"""
LINK = r"(?U)https?://|(?:\w[\w\.-]+)\.(?:com|org|edu|net|io|gov|tw|jp)(?:/|\b)"
MAIL = r"(?U)[\w\.-]+@[\w\.-]+\.\w+"
MEASURE = r"(?iU)\b\d+(?:\.\d+)?\s?(?:%|px|cm|mm|in|s|ms|GB|MB|KB|dpi|fps|Hz)\b"
DATE = r"(?U)\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[:：]\d{2}(?:[:：]\d{2})?)\b"
SCREEN_WORDS = [
    "help", "settings", "file", "edit", "view", "run", "kernel", "tools", "navigator", "account", "sign in", "login",
    "checkpoint", "last checkpoint", "trusted", "packages", "environments", "console", "output", "undo", "redo",
    "merge cell", "split cell", "clear output", "selected cell", "restart", "interrupt", "shutdown", "assistant",
    "home", "insert", "format", "window", "workspace", "ribbon", "toolbar", "properties", "layers", "model", "layout",
]
LINE_DENYLIST = [
    "user", "使用者", "user:", "使用者:", "username", "ta", "助教", "ta:", "助教:", "聯成小幫手", "小幫手", "幫手",
    "file", "檔案", "edit", "編輯", "view", "檢視", "settings", "設定", "options", "選項",
    "loading...", "載入中...", "please wait", "請稍候", "welcome", "歡迎", "thank you", "謝謝", "logout", "登出",
    "next", "下一步", "previous", "上一步", "submit", "提交",
]


def looks_like_code(text: Column) -> Column:
    t = strip(text)
    head = F.lit(False)
    for h in CODE_HEADS:
        head = head | t.startswith(h)
    return head | (count_of(t, CODE_CHARS) >= F.greatest(F.lit(2).cast("long"), F.floor(F.length(t) / 10)))


def is_low_information(text: Column) -> Column:
    """Short lines are; code, links, mails, measures, dates and long lines are not; then
    repeated words, low entropy or screen words are."""
    # the length first, so that no pattern ever runs over a long line
    keep = (F.length(text) >= 25) | looks_like_code(text) | text.rlike(LINK) | text.rlike(MAIL) | text.rlike(MEASURE) | text.rlike(DATE)
    screen = F.lower(text).rlike("|".join(SCREEN_WORDS))
    return (F.when(F.coalesce(F.length(text), F.lit(0)) < 2, True).when(keep, False)
            .when(repeat_ratio(text) >= 0.60, True).when(entropy(text) < 1.20, True).otherwise(screen))


def keep_token(text: Column, conf: Column, center_x: Column, width: Column) -> Column:
    """Recognised word: confidence bound by script, and not in the right side bar."""
    latin = ascii_letter_ratio(text) >= 0.7
    sure = F.when(latin, conf >= 0.60).otherwise((conf >= 0.75) | ((conf >= 0.55) & (count_of(text, HAN) >= 4)))
    return (strip(text) != "") & sure & ~(center_x / F.greatest(F.lit(1.0), width) > 0.82)


# Titles that say nothing, and words no title may hold.
GENERIC_TITLE = "^介紹$|^引言$|^摘要$|^總結$|^回顧$|^說明$|^範例$|^示範$|^注意事項$"
TITLE_BANLIST = ["介紹", "小結", "示範", "操作", "畫面", "這一段", "Part", "Chapter", "概要", "講解"]
META_TITLE = r"(?iU)(slide|agenda|welcome|thanks|q\s*&\s*a|speaker)"


def _banned(title: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in TITLE_BANLIST]), lambda w: F.contains(title, w))


def is_generic_title(title: Column) -> Column:
    t = strip(title)
    return (t == "") | _banned(t) | t.rlike(GENERIC_TITLE)


def is_bare_title(title: Column) -> Column:
    """The test of block titles: none, a banned word, or a single character."""
    return (F.length(title) < 2) | _banned(title)


def is_valid_title(title: Column) -> Column:
    return (count_of(title, WORD) <= 10) & ~title.rlike(META_TITLE)


def shares(slides: Column, speech: Column, w_slides: Column, w_speech: Column, budget: int, least: float = 0.30) -> tuple[Column, Column]:
    """Character budgets of two texts by weight with a minimum share; an empty side gives its part away."""
    a, b = strip(slides) != "", strip(speech) != ""
    wa, wb = F.greatest(F.lit(least), w_slides), F.greatest(F.lit(least), w_speech)
    sa = F.when(a & b, wa / (wa + wb)).when(a, 1.0).when(b, 0.0).otherwise(0.5)
    sb = F.when(a & b, wb / (wa + wb)).when(a, 0.0).when(b, 1.0).otherwise(0.5)
    return F.floor(budget * sa), F.floor(budget * sb)
