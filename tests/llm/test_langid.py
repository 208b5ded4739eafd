"""Language identification: held-out accuracy, the back-off by hand, and unusual inputs."""

import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidepanel.llm import langid


def model(rows):
    totals, entries, words = {}, [], {}
    for lang, text in rows:
        for w in langid.words_of(text):
            words[lang, w] = words.get((lang, w), 0) + 1
    counts = {}
    for (lang, w), n in words.items():
        counts[lang, 0, w] = n
        for size in range(1, langid.LONGEST + 1):
            for g in langid.grams_of(w, size):
                counts[lang, size, g] = counts.get((lang, size, g), 0) + n
    for (lang, size, _), n in counts.items():
        totals[lang, size] = totals.get((lang, size), 0) + n
    entries = [(*k, n) for k, n in counts.items()]
    languages = sorted({lang for lang, _ in rows})
    return langid.Model(languages, [sum(r[0] == lang for r in rows) for lang in languages], totals, entries)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    asked = [r for r in got if r.held_out and len(langid.words_of(r.text)) >= 3]
    right = sum(r.lang_pred == r.lang for r in asked)
    assert len(asked) > 2000 and right / len(asked) > 0.99
    assert all(0.0 <= r.score <= 1.0 for r in got)


def test_spark_model_is_the_plain_one(spark):
    rows = [("en", "the cat sat on the mat"), ("en", "the dog"), ("de", "der Hund und die Katze"), ("fr", "le chat et le chien"), ("fr", "été " * 5)]
    got, want = langid.learn(spark.createDataFrame(rows, "lang string, text string")), model(rows)
    assert got.languages == want.languages and got.grams == want.grams and got.usual == want.usual


def test_words_first_then_shorter_grams():
    got = model([("en", "thing thing other"), ("de", "ding anderer")])
    assert got.evidence("thing") == got.words["thing"]
    assert [i for i, _ in got.evidence("thing")] == [1]
    six = got.evidence("ething")  # 'thing' and 'hing ' are known n-grams of five letters
    known = [g for g in langid.grams_of("ething", 5) if g in got.grams[5]]
    assert known == ["thing", "hing "] and math.isclose(six[0][1], sum(got.grams[5][g][0][1] for g in known) / 2)
    assert not [g for s in (5, 4, 3) for g in langid.grams_of("zdi", s) if g in got.grams[s]]
    assert got.evidence("zdi") == [(i, v / len([g for g in langid.grams_of("zdi", 2) if g in got.grams[2]])) for i, v in got.grams[2]["di"]]
    assert got.evidence("中文") == [] and langid.grams_of("a", 1) == ["a"]


def test_unusual_inputs(spark):
    rows = [(i, t, lang, 1, 1.0) for i, (t, lang) in enumerate(30 * [("the house and the garden", "en"), ("das Haus und der Garten", "de")])]
    odd = [(None, None, None), (1000, "", "en"), (1001, "123 .!", "de"), (1002, None, "fr"), (1003, "中文", None), (1004, "the " * 400_000, None), (1004, "the " * 400_000, None), (1005, "x" * 300_000, "en"), (1006, "DAS HAUS", None)]
    docs = spark.createDataFrame(rows + [(*o, 1, 1.0) for o in odd], "doc_id long, text string, lang string, size int, n double")
    got = {}
    for r in langid.languages(docs).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert sum(map(len, got.values())) == 69
    assert got[None] == got[1000] == got[1001] == got[1002] == [("und", 0.0)]
    assert got[1003][0][0] in ("de", "en") and math.isclose(got[1003][0][1], 1 / 3 if zlib.crc32(b"1002") % 4 != 2 else 1 / 2)
    assert len(got[1004]) == 2 and got[1004][0] == got[1004][1] and got[1004][0][0] == "en" and got[1004][0][1] > 0.9
    assert got[1006][0][0] == "de"
    unlabelled = langid.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.where("doc_id < 60").collect()} == {"und"}
    assert langid.languages(docs.where("false")).collect() == []


def test_words_of_latin_texts_are_those_of_the_pattern():
    plain = lambda text: langid._words(text.lower())
    for c in map(chr, [*range(0x500), 0x2019, 0x3000, 0x4E2D, 0x1F600, 0xDFFF]):
        for text in (c, f"Ab{c}Cd É{c}", f"{c}x\u0301{c}"):
            assert langid.words_of(text) == plain(text), repr(text)


def test_grams_of_many_words_are_those_of_each(spark, monkeypatch):
    words = ["a", "ab", "the", "thé", "there", "中文", "x" * 50, "e\u0301t", "\U0001d4d0b", "thethethe"]
    times = [3, 1, 2, 5, 1, 4, 7, 1, 1, 2**40]
    want = Counter()
    for word, n in zip(words, times, strict=True):
        for size in range(1, langid.LONGEST + 1):
            for gram in langid.grams_of(word, size):
                want[size, gram] += n
    # Each n-gram comes once, however many words have it: before, every one of every word was counted by itself.
    found = [((size, gram), n) for size, some in langid.grams_in(words, times) for gram, n in some]
    assert len(found) == len(want) and dict(found) == want
    rows = spark.createDataFrame([(lang, w, n) for lang in ("en", "de") for w, n in zip(words, times, strict=True)], "lang string, key string, n long")
    for held, chunk in ((langid.HELD, langid.CHUNK), (5, 1)):
        monkeypatch.setattr(langid, "HELD", held)
        monkeypatch.setattr(langid, "CHUNK", chunk)
        got = {(r.lang, r["size"], r.key): r.n for r in langid.gram_counts(rows).collect()}
        assert got == {(lang, *k): n for lang in ("en", "de") for k, n in want.items()}
