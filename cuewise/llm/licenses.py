"""License scans: template markup compiled into token automata, and fixed phrases."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import FOLD, raw
from cuewise.llm.notices import TEMPLATES
from cuewise.llm.registry import query, table

#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_MARK = re.compile(r"<<optional>>|<</optional>>|<<var (\d+)\.\.(\d+)>>|[^\s<>]+")


def parts(template: str):
    """Marks and folded words of a template, in order; a mark is a match, a word a string."""
    for m in _MARK.finditer(template):
        if m[0].startswith("<<"):
            yield m
        else:
            yield from (w.decode() for w in raw(m[0]).translate(FOLD).split())


class Automaton:
    """States over tokens: `steps[state]` by token, `any_[state]` for any token, `free[state]` without one."""

    def __init__(self, template: str):
        self.steps, self.any_, self.free = [{}], [None], [[]]
        opened, at, mandatory = [], 0, []
        for m in parts(template):
            if isinstance(m, str):
                token = m.encode()
                new = self._state()
                self.steps[at][token] = new
                at = new
                if not opened:
                    mandatory.append(token)
            elif m[0] == "<<optional>>":
                opened.append(at)
            elif m[0] == "<</optional>>":
                self.free[opened.pop()].append(at)
            else:
                low, high = int(m[1]), int(m[2])
                states = [at]
                for _ in range(high):
                    new = self._state()
                    self.any_[states[-1]] = new
                    states.append(new)
                at = states[-1]
                for s in states[low:-1]:
                    self.free[s].append(at)
        self.end = at
        #: A word without which nothing is accepted, and the words that may come first.
        self.anchor = max(mandatory, key=len)
        start = self._closed({0})
        self.first = None if any(self.any_[s] is not None for s in start) else {t for s in start for t in self.steps[s]}

    def _state(self) -> int:
        self.steps.append({})
        self.any_.append(None)
        self.free.append([])
        return len(self.steps) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def match(self, tokens: list[bytes], at: int) -> int | None:
        """End of the longest accepted stretch that starts at `at`."""
        now, end = self._closed({0}), None
        for i in range(at, len(tokens)):
            then = {self.steps[s].get(tokens[i]) for s in now} | {self.any_[s] for s in now}
            then.discard(None)
            if not then:
                return end
            now = self._closed(then)
            if self.end in now:
                end = i + 1
        return end

    def find(self, tokens: list[bytes]) -> list[tuple[int, int]]:
        """Accepted stretches, each the longest from its start, none inside the one before."""
        out, past = [], 0
        for i, t in enumerate(tokens):
            if i >= past and (self.first is None or t in self.first) and (end := self.match(tokens, i)):
                out.append((i, end))
                past = end
        return out


@cache
def automata() -> list[tuple[str, bytes, Automaton]]:
    made = [(label, Automaton(t)) for label, ts in TEMPLATES.items() for t in ts]
    return [(label, b" " + a.anchor + b" ", a) for label, a in made]


def scan_text(text) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
    """Words of a text, `(label, first word)` of each place of a phrase, `(label, start, end)` of each accepted notice."""
    tokens = raw(text).translate(FOLD).split()
    line = b" " + b" ".join(tokens) + b" "
    places = []
    for phrase, label in PHRASES.items():
        needle, at, before, word = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := line.find(needle, at + 1)) >= 0:
            word += line.count(b" ", before, at)  # words since the last place
            before = at
            places.append((label, word))
    notices = [(label, s, e) for label, anchor, a in automata() if anchor in line for s, e in a.find(tokens)]
    return len(tokens), places, notices


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `n_words`, `places` (label, word) and `notices` (label, start, end).

    Null and empty texts have no words and no finding. Whole texts are read; only id and text are used, whatever
    other columns are called. Each row is scanned for itself: rows that repeat an id, or have none, have a
    row each, and an empty table gives none. Notices of one label and form don't overlap (of two that would, the
    first counts, and it is taken as long as it can be); those of different labels may.
    """
    kind = docs.schema[doc].dataType
    # ids travel as text: pandas would turn whole numbers beside a null into floats
    rows = docs.select(F.col(doc).cast("string").alias("_id"), F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            got = [scan_text(t) for t in batch["_text"]]
            yield pd.DataFrame({
                "_id": batch["_id"],
                "n_words": [g[0] for g in got],
                "places": [[{"label": x, "word": w} for x, w in g[1]] for g in got],
                "notices": [[{"label": x, "start": s, "end": e} for x, s, e in g[2]] for g in got],
            })

    out = rows.mapInPandas(run, "_id string, n_words long, places array<struct<label string, word long>>, notices array<struct<label string, start long, end long>>")
    return out.withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", doc)


def regex(template: str) -> str:
    """The same template as a pattern over words joined by single spaces, with one space before and after."""
    out = " "
    for m in parts(template):
        if isinstance(m, str):
            out += m + " "
        elif m[0] == "<<optional>>":
            out += "(?:"
        else:
            out += ")?" if m[0] == "<</optional>>" else f"(?:[^ ]+ ){{{m[1]},{m[2]}}}"
    return out


def _sql() -> str:
    fold = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    place = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}"
        for p, label in PHRASES.items())
    notice = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM d WHERE regexp_matches(line, '{regex(t)}')" for label, ts in TEMPLATES.items() for t in ts)
    return f"""
WITH d0 AS (SELECT doc_id, {fold} AS w FROM documents),
d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d0),
p AS ({place}), n AS ({notice}),
pg AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1),
ng AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM n) GROUP BY 1),
ac AS (SELECT DISTINCT doc_id, true AS accepted FROM n)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN accepted THEN 1.0::DOUBLE WHEN labels IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM d LEFT JOIN pg USING (doc_id) LEFT JOIN ng USING (doc_id) LEFT JOIN ac USING (doc_id)
"""


@query("op5_license_scan", _sql())
def op5(spark, sf_dir):
    """Score: 1 where a notice's whole mandatory wording stands, 0.5 where only a phrase does."""
    found = scan(table(spark, sf_dir, "documents"))
    word, label = F.transform("places", lambda x: x["word"]), F.transform("places", lambda x: x["label"])
    both = F.concat(label, F.transform("notices", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        joined(label).alias("base_labels"), joined(both).alias("labels"),
        F.when(F.size("notices") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"))
