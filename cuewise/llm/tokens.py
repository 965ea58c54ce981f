"""Token counts of whole texts: a broadcast table of frequent pre-tokens, then a cache in each worker.

A byte-level tokenizer never merges across the borders between pre-tokens, so a text has as many tokens as its
pre-tokens together. The pre-tokens here are words between single spaces, which the tokenizer may cut further.
They are never shuffled: each task looks them up where it reads the text.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from functools import cache, cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.registry import query, table

#: White space of the pre-token rule.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Borders that no token reaches over: before a space with a word behind it, and around other white space.
PIECE = re.compile(f"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]")
#: A space that is followed by white space or by the end, so that splitting at spaces would not do.
UNEVEN = re.compile(f" (?![^{WHITE}])")
#: Pre-tokens of the broadcast table, of a worker's cache and of a task's count, and their longest length in characters.
FREQUENT, CACHED, COUNTED, LONGEST = 1 << 16, 1 << 18, 1 << 13, 48
#: Pre-tokens that the library is given at once.
AT_ONCE = 1 << 14


@cache
def loaded(name: str):
    """The tokenizer of a file, for byte-level vocabularies as `.json`; and the strings of its special tokens."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    if made.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{name}: pre-tokens are known for byte-level tokenizers without normalizer and prefix space only")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, tuple(t["content"] for t in made["added_tokens"])


def pre_tokens(text: str) -> list[str]:
    """Stretches of a text that are tokenized apart from each other, as keys of the tables: a word (with what
    follows it up to the next single space) stands for itself with the space before it; any other stretch has two
    spaces in front, which no word has."""
    if UNEVEN.search(text):
        return [p[1:] if len(p) > 1 and p[0] == " " and not p[1:].isspace() else "  " + p for p in PIECE.findall(text)]
    keys = text.split(" ")
    if keys[0]:
        keys[0] = "  " + keys[0]
    else:
        del keys[0]
    return keys


def encoded(name: str, texts: list[str]) -> list[int]:
    """Numbers of tokens, by the library, of stretches that it takes one by one."""
    tokenizer, _ = loaded(name)
    out = []
    for i in range(0, len(texts), AT_ONCE):
        some = texts[i : i + AT_ONCE]
        of = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False).word_ids
        out += np.bincount(np.array(of, np.int64), minlength=len(some)).tolist()
    return out


def encoded_keys(name: str, keys: list[str]) -> list[int]:
    return encoded(name, [k[2:] if k.startswith("  ") else " " + k for k in keys])


class Lengths:
    """Frequent pre-tokens and their numbers of tokens. Travels as one string and two rows of bytes, and becomes a
    hash table once in each worker. A number of tokens is at most the bytes of a pre-token, so it fits a byte."""

    def __init__(self, keys: list[str], tokens: list[int]):
        self.text, self.sizes, self.tokens = "".join(keys), bytes(map(len, keys)), bytes(tokens)

    def items(self):
        at = 0
        for size, n in zip(self.sizes, self.tokens):
            yield self.text[at : at + size], n
            at += size

    def __len__(self) -> int:
        return len(self.sizes)

    @cached_property
    def known(self) -> dict[str, int]:
        """The table of this worker: the frequent pre-tokens, and those it has met since; kept from task to task."""
        return dict(self.items())

    def add(self, new: dict[str, int]) -> None:
        """Put into the worker's cache; a full one is emptied down to the frequent pre-tokens."""
        if len(self.known) + len(new) > len(self) + CACHED:
            self.__dict__["known"] = dict(self.items())
        self.known.update(x for x in list(new.items())[:CACHED] if len(x[0]) <= LONGEST)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("text", "sizes", "tokens")}


def counts(texts: list[str], name: str, lengths: Lengths) -> list[int]:
    """Numbers of tokens of whole texts. Misses of a batch are encoded together, each once."""
    tokenizer, special = loaded(name)
    get = lengths.known.get
    out, late, new = [], [], {}
    for i, text in enumerate(texts):
        if any(s in text for s in special):  # special strings cut a text; the library does it
            out.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
            continue
        keys = pre_tokens(text)
        found = list(map(get, keys))
        if None in found:
            rest = [k for k, n in zip(keys, found) if n is None]
            late.append((i, rest))
            new.update(dict.fromkeys(rest))
            found = [n for n in found if n is not None]
        out.append(sum(found))
    if new:
        new = dict(zip(new, encoded_keys(name, list(new))))
        for i, rest in late:
            out[i] += sum(map(new.__getitem__, rest))
        lengths.add(new)
    return out


def frequent_pieces(texts: DataFrame, most: int = FREQUENT, width: int = COUNTED) -> DataFrame:
    """`(piece, n)`: the most frequent pre-tokens over all documents, as keys. `texts (t)`.

    A task counts the words between spaces in a bounded summary: whenever it outgrows four times `width`, the
    count at rank `width` is taken from all, which loses no word above one in `width` of the task. At most
    four times `width` rows leave a task. The table decides speed, never a result.
    """

    def run(batches):
        held = Counter()
        for b in batches:
            for text in b["t"]:
                held.update(text.split(" "))
                if len(held) > 4 * width:
                    held = _pruned(held, width)
        kept = [(p, n) for p, n in held.items() if n > 1 and 0 < len(p) <= LONGEST and not p[0].isspace()]
        yield pd.DataFrame(kept, columns=["piece", "n"])

    return texts.mapInPandas(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)


def _pruned(held: Counter, width: int) -> Counter:
    cut = sorted(held.values(), reverse=True)[width]
    return Counter({p: n - cut for p, n in held.items() if n > cut})


def frequent_lengths(texts: DataFrame, name: str, most: int = FREQUENT) -> Lengths:
    """Table of at most `most` pre-tokens of at most `LONGEST` characters: under 16 MB whatever the corpus."""
    keys = [r["piece"] for r in frequent_pieces(texts, most).collect() if len(r["piece"].encode()) < 255]
    return Lengths(keys, encoded_keys(name, keys))


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", *, limit: int = 1024, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `n_bytes`, `n_tokens` as the library counts them, `over_limit`.

    `name` is a file of the public tokenizers, or a path that executors have, with a byte-level rule. Null
    texts count as empty: no byte, no token. Strings of special tokens inside a text are special tokens, as the library's default has it. Whole texts
    are counted, also those without any white space; rows that repeat an id, or have none, have a row each.
    No order matters, so there are no ties. Two passes over the texts and no shuffle but that of each task's few
    frequent pre-tokens. Extra columns are not read; an empty table gives none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lengths = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select(t.alias("t")), name))
    rows = docs.select(F.col(doc).alias("doc"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("t"))

    def run(batches):
        for b in batches:
            n = counts(b.column("t").to_pylist(), name, lengths.value)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, rows.drop("t").schema.add("n_tokens", "long"))
    return out.select(F.col("doc").alias(doc), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op12_token_counts")
def op12(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
