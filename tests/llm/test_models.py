"""Language, licenses, secrets, classifier and language models."""

import re
from math import log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuewise.llm import cotraining, language, licenses, lmscore, notices, secrets
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op1(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_language_edges(spark):
    rows = plain.corpus()
    model = language.fit(plain.table(spark, rows))
    got = {r.doc_id: r for r in language.identify(plain.table(spark, rows), model).collect() if r.doc_id is not None}
    for i, text, lang, _ in rows:
        if i is not None and text and re.search("[a-z]{40}|[a-z]{3}.{200}", text, re.S):
            assert got[i].lang_pred == lang
    assert [got[i].lang_pred for i in (73, 74, 75, 78)] == ["und"] * 4
    none = language.fit(plain.table(spark, []))
    assert {r.lang_pred for r in language.identify(plain.table(spark, rows), none).collect()} == {"und"}
    assert language.identify(plain.table(spark, []), model).count() == 0


def test_letters_beyond_the_first_plane(spark):
    """Emoji are no letters, so a text of them is `und` and they part words; letters of other planes are letters."""
    model = language.fit(plain.table(spark, plain.corpus()))
    assert [model.decide(t)[:2] for t in ("😀😀😀 🎉🎉🎉🎉", "", "12 !!", None)] == [("und", 0.0)] * 4
    assert model.decide("𐐷𐐷𐐷𐐷𐐷")[0] == model.prior
    same = [[h.tolist() for h in language.grams(t, 4)] for t in ("thereon😀anderin", "thereon anderin")]
    assert same[0] == same[1]


def test_language_filter_exact(spark):
    """The filter holds every n-gram put in, in all its languages, and few others."""
    rows = plain.corpus()
    docs = plain.table(spark, rows)
    model = language.fit(docs, contrast=0.0, least=1e-9)
    for _, text, lang, _ in rows:
        if text and lang in model.langs:
            total, own = 0, 0
            for h in language.grams(text, model.n):
                masks = None
                for at in language._slots(h, model.hashes, len(model.bits)):
                    got = model.bits[at.astype(np.int64)]
                    masks = got if masks is None else masks & got
                own += int(model._slice(masks, model.langs.index(lang)).sum())
                total += len(h)
            assert own == total
    assert model.false.max() < 0.02


def test_many_languages(spark):
    rows = [(i, plain.speech(__import__("random").Random(i), 80, [chr(0x61 + i % 26) + chr(0x430 + i), chr(0x3B1 + i % 20) + "q"]), f"l{i:03d}", "s") for i in range(70)]
    model = language.fit(plain.table(spark, rows))
    assert model.bits.shape[1] == 2
    assert sum(r.lang_pred == f"l{r.doc_id:03d}" for r in language.identify(plain.table(spark, rows), model).collect()) >= 68


def test_long_text_in_pieces():
    text = "".join(chr(97 + i % 23) for i in range((1 << 20) + 77))
    assert sum(len(h) for h in language.grams(text, 4)) == len(text) + 2 - 3


LICENSED = [
    "x Released under the MIT License.", "released under the terms of the mit license", "under the MIT license",
    "Licensed under the Apache License, Version 2.0.", "licensed under apache license version 2", "apache license version 2 apache license version 2",
    "This work is licensed under the GNU General Public License, version 3.", "this fine big work is licensed under the gnu general public license either version 3",
    "this is licensed under the gnu general public license version 3", "Licensed under CC BY-NC 4.0.", "licensed under a cc by nc", "cc by", "", None,
    "released under the new bsd license", "under the a b c bsd license",
    *[re.sub(r"<<var 1..12>>", "THE EXAMPLE PROJECT", re.sub(r"<<(/?optional|var 1..1)>>", "", t)).upper() for t in (notices.MIT, notices.ISC, notices.APACHE, notices.MPL, notices.UNLICENSE, notices.BSD_HEAD + notices.BSD_TAIL)],
    "Copyright 2020\n" + re.sub(r"<<optional>>.*?<</optional>>", "", notices.MIT) + "\nand more",
    "This program is free software under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License, or (at your option) any later version",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
]


def test_automata_equal_patterns():
    for text in LICENSED:
        line = " " + " ".join(plain.folded(text)) + " "
        tokens = [x.encode() for x in plain.folded(text)]
        for label, ts in licenses.TEMPLATES.items():
            for t in ts:
                a = licenses.Automaton(t)
                want = re.search(licenses.regex(t), line)
                got = a.find(tokens)
                assert bool(got) == bool(want), (text, label)
                if want:
                    assert got[0][0] == line.count(" ", 0, want.start())


def test_license_scan(spark):
    rows = [(i, t, None, None) for i, t in enumerate(LICENSED)]
    got = {r.doc_id: r for r in licenses.scan(plain.table(spark, rows)).collect()}
    assert len(got) == len(rows) and got[13].n_words == 0
    assert [p.word for p in got[5].places] == [0, 4]
    assert {n.label for n in got[6].notices} == {"gpl-3"} and not got[8].notices
    assert [{n.label for n in got[16 + k].notices} for k in range(10)] == [{"mit"}, {"isc"}, {"apache-2"}, {"mpl-2"}, {"unlicense"}, {"bsd-2"}, {"mit"}, {"lgpl"}, {"gpl-2"}, {"cc-by-sa"}]
    assert licenses.scan(plain.table(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["MIT", "ISC", "APACHE", "MPL", "UNLICENSE", "BSD_HEAD"])
def test_every_mandatory_word_counts(name):
    """A notice with one word changed, left out or put in is no notice of that label."""
    template = notices.BSD_HEAD + notices.BSD_NAMES + notices.BSD_TAIL if name == "BSD_HEAD" else getattr(notices, name)
    label = {"MIT": "mit", "ISC": "isc", "APACHE": "apache-2", "MPL": "mpl-2", "UNLICENSE": "unlicense", "BSD_HEAD": "bsd-3"}[name]
    own = licenses.Automaton(template)
    plain_parts = list(licenses.parts(re.sub(r"<<optional>>.*?<</optional>>", "", template.replace("<<var 1..12>>", "HOLDERNAME"), flags=re.S)))
    words = [w.encode() for w in plain_parts]
    assert own.find([b"x", *words, b"y"]) == [(1, 1 + len(words))]
    for i, w in enumerate(words):
        free = w == b"holdername"
        assert bool(own.find([*words[:i], b"never", *words[i + 1 :]])) == free, (label, i, w)
        assert not own.find(words[:i] + words[i + 1 :]) or words[i - 1 : i] == [w], (label, i, w)
        if i and not free and words[i - 1] != b"holdername":
            found = own.find([*words[:i], b"never", b"never", *words[i:]])
            assert not found, (label, i, w)


def test_accepted_only_whole():
    """Texts that begin as a licence and go on otherwise."""
    forbids = re.sub(r"<<[^>]*>>", "", notices.MIT).replace("modify, merge,", "").replace("sublicense, and/or sell", "sublicense")
    fee = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: pay us ten dollars."
    assert [licenses.scan_text(t)[2] for t in (forbids, fee)] == [[], []]


def test_many_places():
    words, places, _ = licenses.scan_text("under the mit license " * 20_000)
    assert words == 80_000 and [w for _, w in places[:3]] == [0, 4, 8] and len(places) == 20_000


def test_secrets(spark):
    rng = __import__("random").Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = plain.corpus(40)
    rows += [(500 + i, plain.speech(rng, 30, plain.EN) + f' token = "{h}" ' + plain.speech(rng, 30, plain.EN), "en", "s") for i, h in enumerate(hexes[:40])]
    rows += [(600 + i, plain.speech(rng, 30, plain.EN) + f" commit {h} " + "thereoninaneder" * 2, "en", "s") for i, h in enumerate(hexes[40:])]
    rows.append(rows[-25])
    got = secrets.scan(plain.table(spark, rows), doc_id=F.col("doc_id")).collect()
    assert {r.doc_id for r in got if r.secret} == set(range(500, 540))
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert r.value in plain.words(text)[r.word]
    assert secrets.scan(plain.table(spark, []), doc_id=F.col("doc_id")).count() == 0


def test_forest_is_the_trained_one(spark):
    """The column says what the forest's own votes say, on findings with given labels."""
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.random((300, len(secrets.FEATURES))), columns=secrets.FEATURES)
    data["label"] = ((data["digits"] + data["coverage"]) > 1).astype(float)
    df = spark.createDataFrame(data)
    score = np.array([r[0] for r in df.withColumn("p", secrets.forest(df)).select("p").collect()])
    assert ((score > 0.5) == (data["label"] > 0)).mean() > 0.9
    assert df.withColumn("p", secrets.forest(df.where("label = 1"))).first().p == 1.0


def test_classifier_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = cotraining.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = cotraining.scored(docs, model, doc_id=F.col("doc_id")).join(labels, "doc_id").where("doc_id % 3 = 0").toPandas()
    bad, good = got[got["quality"] == 0], got[got["quality"] == 1]
    assert good["kept"].mean() > 0.95 and bad["kept"].mean() < 0.2
    for view in ("text_score", "meta_score"):
        assert good[view].mean() > bad[view].mean() + 0.3


def test_classifier_rounds_share_labels():
    """A view that can't learn from its few labels learns from the other view."""
    rng = np.random.default_rng(0)
    text = [np.array([int(rng.integers(100, 20_000)), 5 if i % 2 else 6], np.int32) for i in range(400)]
    meta = [np.array([int(rng.integers(100, 4000)), 7 if i % 2 else 8], np.int32) for i in range(400)]
    label = [float(i % 2) if i < 24 else None for i in range(400)]
    pair = cotraining.cotrain(pd.DataFrame({"text": text, "meta": meta, "label": label}, dtype=object).astype({"label": float}))
    p, q, both = pair.probability(cotraining.Rows(text), cotraining.Rows(meta))
    truth = np.arange(400) % 2 == 1
    assert all(((x > 0.5) == truth).mean() > 0.95 for x in (p, q, both))


def test_classifier_edges(spark):
    rows = plain.corpus(10)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = cotraining.scored(plain.table(spark, rows), cotraining.fit(plain.table(spark, rows), labels), doc_id=F.col("doc_id")).collect()
    assert len(got) == len(rows) and all(r.score == 0.5 and r.kept for r in got)


def test_packed_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 300, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        counts = [rng.choice([0, 1, 2, 255, 256, 65534, 65535, 65536, 1 << 40], len(keys)) for _ in range(2)]
        for got, want in [*zip(lmscore.unpack(lmscore.pack(*counts, keys), True), (*counts, keys)), *zip(lmscore.unpack(lmscore.pack(*counts)), counts)]:
            assert len(got) == len(want) and (got == want).all()
    close = np.arange(70, dtype=np.uint64)
    assert (lmscore.unpack(lmscore.pack(np.ones(70, int), np.zeros(70, int), close), True)[2] == close).all()


def test_language_models_whole(spark, monkeypatch):
    """Every word and pair that stands twice has its own losses, in the target or not; against the formula, written out."""
    monkeypatch.setattr(lmscore, "CHUNK", 3000)
    rows = plain.corpus() + [(800 + i, "rareone raretwo filler words", "en", "s") for i in range(2)]
    docs, good = plain.table(spark, rows), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.scored(docs, good).collect() if r.doc_id is not None}
    assert len(got) == len({r[0] for r in rows if r[0] is not None}) and lmscore.scored(docs, good).count() == len(rows)
    one, two = [{}, {}], [{}, {}]
    for i, text, *_ in rows:
        w = plain.folded(text)
        for side in (0, 1):
            if side or i in range(0, 60, 3):
                for x in w:
                    one[side][x] = one[side].get(x, 0) + 1
                for p in zip(w, w[1:]):
                    two[side][p] = two[side].get(p, 0) + 1
    vocab = {x for x, n in one[1].items() if n >= 2}
    pairs = {p for p, n in two[1].items() if n >= 2}
    assert "rareone" in vocab and "rareone" not in one[0]
    rest = [sum(n for x, n in one[side].items() if x not in vocab) for side in (0, 1)]
    for i, text, *_ in rows:
        w = plain.folded(text)
        if i is None or len(w) > 10_000:
            continue
        for side, loss in ((0, got[i].target_loss), (1, got[i].background_loss)):
            every = sum(one[side].values())
            c = lambda x: one[side].get(x, 0) if x in vocab else rest[side]  # noqa: E731, B023
            want = 0.0
            for k, x in enumerate(w):
                q = (w[k - 1], x) if k else None
                seen = two[side].get(q, 0) if q in pairs else 0
                p = 0.3 * (c(x) + 0.5) / (every + 0.5 * (len(vocab) + 1)) + (0.7 * min(1.0, seen / (c(q[0]) + 0.5)) if seen else 0.0)
                want -= log(p)
            assert got[i].n_tokens == len(w) and loss == pytest.approx(want / max(1, len(w)))
    assert got[800].target_loss > got[800].background_loss + 1
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.scored(plain.table(spark, []), none).count() == 0
    assert lmscore.scored(plain.table(spark, plain.corpus(5)), none).count() == len(plain.corpus(5))
    assert all(r.target_loss == r.background_loss == 0 for r in lmscore.scored(plain.table(spark, [(1, None, None, None), (2, " ", None, None)]), none).collect())


def test_secrets_inside_words(spark):
    """All runs of a word are candidates, each with the key before it; a name before an equals sign is no part of the value."""
    key, other = "9a8b7c6d5e4f3a2b1c0d9e8f", "3f2a9c0d1e2b3c4d5e6f"
    texts = ['{"request_id":"%s","api_key":"%s"}' % (other, key), "AWS_SECRET_ACCESS_KEY=" + key, f"https://x.y/?request={other}&token={key}", f"token = {key}==", f"{other},{key}"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "piece string")
    got = {(r.doc_id, r.value): r for r in secrets.by_rule(secrets.findings(docs, none, doc_id=F.col("doc_id"))).collect()}
    sure = {k for k, r in got.items() if r.label == 1.0}
    assert sure == {(0, key), (1, key), (2, key), (3, key + "==")}
    assert {(0, other), (1, "AWS_SECRET_ACCESS_KEY"), (2, other), (4, key), (4, other)} <= set(got)
