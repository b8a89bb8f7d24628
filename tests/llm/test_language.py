"""Language filters against plain sets, and their accuracy on held-out documents."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from roadgeo.llm import language, queries

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    """The n-grams of a text, by size, one character at a time."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = {1: [], 2: [], 3: []}
    for w in words:
        out[1] += list(w)
    if words:
        line = f" {' '.join(words)} "
        out[2] = [line[i : i + 2] for i in range(len(line) - 1)]
        out[3] = [line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " "]
    return out


def key(gram):
    codes = [0 if c == " " else ord(c) for c in gram]
    return sum(c << 18 * (len(codes) - 1 - i) for i, c in enumerate(codes)) | len(codes) << 54


def plain_contained(rows):
    """(lang, key) pairs of rows of (doc_id, text, lang)."""
    votes, n = defaultdict(int), defaultdict(int)
    for doc_id, text, lang in rows:
        if text is None or lang is None or (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1):
            continue
        n[lang] += 1
        for grams in plain_grams(text).values():
            for g in grams:
                votes[lang, key(g)] += max(1, language.VOTE // len(grams))
    share = {(lang, k): v / (n[lang] * float(language.VOTE)) for (lang, k), v in votes.items()}
    most = defaultdict(float)
    for (_, k), s in share.items():
        most[k] = max(most[k], s)
    return {(lang, k) for (lang, k), s in share.items() if s >= language.FLOOR and s >= language.RATIO * most[k]}, dict(n)


ROWS = [
    (1, "the river and the stone", "en"), (2, "the winter, the letter", "en"), (3, "der Fluss und das Tor", "de"), (4, "das Haus — der Garten", "de"),
    (5, "Ёлка и снег", "ru"), (6, None, "en"), (7, "12 34 !", "de"), (None, "and the seven", "en"), (8, "", None), (9, "the the", None), (9, "the the", "en"),
    (10, "雪の庭 雪", "ja"), (11, "𝒳 the \U0001F600 end", "en"),
]


def test_contained_is_what_plain_counting_gives(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    langs, grams = language.contained(docs)
    expected, n = plain_contained(ROWS)
    assert {(r["lang"], r["gram"]) for r in grams.collect()} == expected
    assert {r["lang"]: r["n"] for r in langs.collect()} == n


def test_filter_answers_to_all_that_a_language_contains(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    langs, grams = language.contained(docs)
    built = language.build(langs, grams)
    of = defaultdict(set)
    for r in grams.collect():
        of[r["lang"]].add(r["gram"])
    keys = np.array(sorted(set().union(*of.values())))
    masks = built.languages(keys)[:, 0]
    extra = 0
    for i, lang in enumerate(built.langs):
        answers = {int(k) for k, m in zip(keys, masks) if int(m) >> i & 1}
        assert of[lang] <= answers
        extra += len(answers - of[lang])
    assert extra <= 0.05 * len(keys) * len(built.langs)
    assert max(built.chance) < 0.02


def test_many_languages_take_several_words(spark):
    letters = [chr(0x4E00 + 7 * i) for i in range(70)]
    docs = spark.createDataFrame([(3 * i, f"{c}{c} {c}", f"l{i:02}") for i, c in enumerate(letters)] * 2, "doc_id bigint, text string, lang string")
    learnt = {r["lang"] for r in docs.where(~language.held_out()).collect()}
    rows = language.identify(docs).join(docs.distinct(), "doc_id").collect()
    assert len(learnt) < 70 and len(rows) == 140
    assert all(r["lang_pred"] == r["lang"] for r in rows if r["lang"] in learnt)


def test_results_of_awkward_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    clash = docs.selectExpr("*", "1 as gram", "2 as votes", "3 as n", "4 as held_out", "5 as score", "'x' as lang_pred", "6 as share", "7 as most")
    rows = [tuple(r) for r in language.identify(clash).collect()]
    assert sorted(rows, key=str) == sorted((tuple(r) for r in language.identify(docs).collect()), key=str)
    by_id = {r[0]: r for r in rows}
    assert len(rows) == len(ROWS)
    for blank in (6, 7, 8):
        assert by_id[blank][2:] == ("und", 0.0)
    assert [r[2] for r in rows if r[0] == 9] == ["en", "en"] and by_id[None][2] == "en" and by_id[None][1] is False
    assert all(0 <= r[3] <= 1 for r in rows)


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [1 << 22, 64])
def test_long_texts_are_read_in_slices(monkeypatch, cut):
    monkeypatch.setattr(language, "SLICE", cut)
    text = "Über alles: the river, la niña 7 ёлка " * 40
    texts = language.Texts.of([text, None, "a"])
    for size in (1, 2, 3):
        got = [int(k) for places, numbers in texts.grams(size) for k in texts.keys(numbers[texts.owners(places) == 0], size)]
        assert got == [key(g) for g in plain_grams(text)[size]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pred = queries.op11_language_filters(spark, SF)
    rows = pred.where("held_out").join(docs.where("lang is not null").select("doc_id", "lang").distinct(), "doc_id").collect()
    assert len(rows) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
