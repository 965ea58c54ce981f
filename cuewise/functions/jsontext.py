"""JSON inside model replies: find it, check it, and read typed rows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewise.operators.barrier import let

# Keys every question record must have.
REQUIRED = ["QuestionId", "QuestionText", "Options", "CorrectAnswer", "Explanation", "Tags", "Difficulty"]


def missing_keys(record: Column, required: list[str] = REQUIRED) -> Column:
    """Required keys a JSON object does not have; all of them when it is no object."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in required]), keys)


def strict_json(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else. The parser ignores what follows
    the first value, so the text is read as the first of two array items and the second must be there."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"#"]')))
    whole = (F.try_variant_get(both, "$[1]", "string") == "#") & F.try_variant_get(both, "$[2]", "string").isNull()
    return F.when(whole, F.try_variant_get(both, "$[0]", "variant"))


def field(doc: Column, key: str, default: Column | None = None) -> Column:
    """Value of a top-level key as text; the default only when the key is absent."""
    has = F.array_contains(F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>")), key)
    value = F.get_json_object(doc, f"$.{key}")
    return value if default is None else F.when(has, value).otherwise(default)


def truthy(text: Column) -> Column:
    """Text of a value that counts as given: not missing and not empty."""
    return F.when(text != "", text)


def json_blob(text: Column) -> Column:
    """JSON part of a reply: fenced block, whole text, first object span, first array span."""

    def found(pattern: str, c: Column) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))

    s = F.trim(text)
    whole = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
    fenced = F.when(F.contains(text, F.lit("```")), F.coalesce(found(TAGGED_BLOB, text), found(PLAIN_BLOB, text)))
    return F.coalesce(fenced, F.when(whole, s), found(r"(?s)(\{.*\})", s), found(r"(?s)(\[.*\])", s))


# Fences around JSON in replies.
TAGGED_BLOB = r"(?is)```json\s*([\[{].*?[\]}])\s*```"
PLAIN_BLOB = r"(?s)```\s*([\[{].*?[\]}])\s*```"
TAGGED_FENCE = r"(?s)```json\s*(.*?)\s*```"
PLAIN_FENCE = r"(?s)```\s*(\{.*?\})\s*```"


def repaired_json(text: Column) -> Column:
    """Fenced or whole text; curly quotes are mended when it does not parse as it stands. Null when it never does."""
    tagged = F.nullif(F.regexp_extract(text, TAGGED_FENCE, 1), F.lit(""))
    fenced = F.nullif(F.regexp_extract(text, PLAIN_FENCE, 1), F.lit(""))
    tries = lambda blob: F.filter(F.array(blob, F.translate(blob, "“”’\u0000", "\"\"'")), lambda x: strict_json(x).isNotNull())
    return let(lambda blob: F.get(tries(blob), F.lit(0)), F.trim(F.coalesce(tagged, fenced, text)))


def as_list(v: Column) -> Column:
    """A variant as an array of text: lists by item, a single value as one item, nothing as none."""
    kind = F.schema_of_variant(v)
    items = F.transform(F.expr("try_cast(null as array<string>)"), lambda x: x)
    listed = v.try_cast("array<string>")
    one = F.array(v.try_cast("string"))
    return F.when(v.isNull() | (kind == "VOID"), F.array().cast("array<string>")).when(kind.startswith("ARRAY"), F.coalesce(listed, items, F.array().cast("array<string>"))).otherwise(one)


# Question difficulties and course types.
DIFFICULTIES = ["easy", "medium", "hard"]
COURSE_TYPES = ["設計", "程式", "數學", "語言", "商業", "科學", "其他"]


def question_fields(v: Column) -> dict[str, Column]:
    """Normalised question of a variant: answer alias, four options at most, known difficulty and type, five tags."""
    get = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    difficulty = F.lower(F.coalesce(get("difficulty"), F.lit("medium")))
    kind = F.trim(F.coalesce(get("course_type"), F.lit("其他")))
    tags = F.filter(F.transform(F.filter(as_list(get("tags", "variant")), lambda x: x.isNotNull() & (x != "")), lambda x: F.trim(x)), lambda x: x.isNotNull())
    return {
        "question": F.coalesce(get("question"), F.lit("")),
        "options": F.slice(as_list(get("options", "variant")), 1, 4),
        "correct_answer": F.coalesce(get("correct_answer"), get("correct_option"), F.lit("")),
        "difficulty": F.when(difficulty.isin(DIFFICULTIES), difficulty).otherwise("medium"),
        "course_type": F.when(kind.isin(COURSE_TYPES), kind).otherwise("其他"),
        "tags": F.slice(tags, 1, 5),
    }


def tidy_options(labels: Column, texts: Column, correct: Column) -> tuple[Column, Column]:
    """Four distinct non-empty option texts labelled A to D, and the label of the right one.

    The right text is found by its old label, put back in front when it was lost, and pads fill up.
    """
    pos = F.array_position(F.transform(labels, lambda x: F.trim(x)), F.trim(correct))
    right = F.when(pos > 0, F.trim(F.get(texts, (pos - 1).cast("int"))))
    right = F.when(right != "", right)
    clean = F.array_distinct(F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != ""))
    clean = F.when(right.isNotNull() & ~F.array_contains(clean, right), F.concat(F.array(right), clean)).otherwise(clean)
    pads = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("（選項補齊）"), i))
    full = F.when(F.size(clean) >= 4, F.slice(clean, 1, 4)).otherwise(F.concat(clean, F.slice(pads, F.size(clean) + 1, F.lit(4) - F.size(clean))))
    at = F.array_position(full, right)
    label = F.when(right.isNotNull(), F.substring(F.lit("ABCD"), F.greatest(at, F.lit(1)).cast("int"), F.lit(1))).when(correct.isin("A", "B", "C", "D"), correct).otherwise("A")
    return full, label


def shuffled(options: Column, correct: Column, explanation: Column, seed: int) -> tuple[Column, Column, Column]:
    """Options in a repeatable random order, the moved label, and the explanation with that label."""
    old = F.instr(F.lit("ABCD"), F.coalesce(correct, F.lit("A")))
    text = F.coalesce(F.get(options, F.greatest(old - 1, F.lit(0))), F.get(options, F.lit(0)))
    order = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat(o, F.lit(f":{seed}"))).alias("h"), o.alias("o")))), lambda s: s["o"])
    order = F.slice(order, 1, 4)
    label = F.substring(F.lit("ABCD"), F.greatest(F.array_position(order, text), F.lit(1)).cast("int"), F.lit(1))
    return order, label, F.regexp_replace(explanation, F.lit(r"正確答案是\s+[A-D]"), F.concat(F.lit("正確答案是 "), label))
