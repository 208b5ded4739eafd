"""Language identification, words first: known words by their log frequency in each language, unseen ones by their character n-grams.

Learning counts every word of every labelled text and every character n-gram of
those words. The model keeps the most frequent words and n-grams of each
language, `WORDS` and `GRAMS` of each length at most and `ENTRIES` in all, which
bounds what is broadcast. Everything else backs off.

The evidence of a key is log(f + floor) for each language, f being its share
among the words (n-grams of that length) of the language and `floor` half an
occurrence in the largest language, less log(floor): 0 where a language lacks
the key. A word of the model scores by its own evidence. Another falls back to
its n-grams of five characters, blanks at both ends included; if the model has
none of them, to those of four, and so on down to one. The known n-grams of the
longest such length score by their mean.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, written

LONGEST = 5
WORDS, GRAMS, ENTRIES = 40_000, 10_000, 1_000_000
#: At most so many languages are learned, those with the most texts.
LANGUAGES = 5_000
#: Longer words are known by their n-grams only.
WORD_LETTERS = 40
#: Evidence of more words than this makes no answer more certain.
CERTAIN = 16
#: Bounds of a task's counts and of its memory of unseen words, and of the characters that it counts at once.
HELD, CHUNK = 300_000, 1_000_000
_words = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
#: The characters of Latin-1 in lower case, and blanks for those that are no letters; it has no marks.
_LATIN = "".join(c.lower() if _words(c) else " " for c in map(chr, range(256))).encode("latin-1")


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text: a letter, then letters and marks."""
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _words(text.lower())


def grams_of(word: str, length: int) -> list[str]:
    whole = f" {word} "
    return [g for i in range(len(whole) - length + 1) if (g := whole[i:i + length]) != " "]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _summed(df: DataFrame, count: Callable[[dict[int, Counter], list[str], list[int]], None]) -> DataFrame:
    """(lang, size, key, n): what `count` adds to the Counters by size for the texts of each language, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[int, Counter]] = {}
        waiting: dict[str, tuple[list[str], list[int]]] = {}
        letters = 0
        for batch in batches:
            for lang, text, n in zip(batch["lang"], batch["text"], batch["n"], strict=True):
                texts, times = waiting.setdefault(lang.as_py(), ([], []))
                texts.append(text.as_py())
                times.append(n.as_py())
                letters += len(texts[-1]) + 1
                if letters >= CHUNK:
                    yield from added(counts, waiting)
                    letters = 0
        yield from added(counts, waiting)
        yield from given(counts)

    def added(counts: dict[str, dict[int, Counter]], waiting: dict[str, tuple[list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
        for lang, (texts, times) in waiting.items():
            count(counts.setdefault(lang, defaultdict(Counter)), texts, times)
        waiting.clear()
        if sum(len(found) for sizes in counts.values() for found in sizes.values()) > HELD:
            yield from given(counts)
            counts.clear()

    def given(counts: dict[str, dict[int, Counter]]) -> Iterator[pa.RecordBatch]:
        for lang, sizes in counts.items():
            for size, found in sizes.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(found)), pa.repeat(pa.scalar(size, pa.int32()), len(found)), pa.array(list(found), pa.string()),
                     pa.array(list(found.values()), pa.int64())], ["lang", "size", "key", "n"])

    return df.mapInArrow(run, "lang string, size int, key string, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, size = 0, key, n) of every word."""

    def count(counts: dict[int, Counter], texts: list[str], _: list[int]) -> None:
        for text in texts:
            counts[0].update(words_of(text))

    return _summed(docs.select("lang", "text", F.lit(1).cast("long").alias("n")), count)


def grams_in(words: list[str], times: list[int]) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """The n-grams of words that occur `times` each: by size, all that differ and how often they occur."""
    text = " ".join(["", *words, ""])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    blank = code == ord(" ")
    # What begins at a blank is the next word's.
    weights = np.append(times, 0)[np.cumsum(blank) - 1].astype(float)
    _, ids = np.unique(code, return_inverse=True)
    at = np.arange(len(code))  # where n-grams begin
    letters = int(ids.max()) + 1
    for size in range(1, LONGEST + 1):
        if size > 1:
            # An n-gram goes on unless it ends: with its word's blank, or with the text.
            on = (at + size - 1 < len(code)) & ((size == 2) | ~blank[np.minimum(at + size - 2, len(code) - 1)])
            at, ids = at[on], ids[on] * letters + letter[at[on] + size - 1]
            _, first, ids = np.unique(ids, return_index=True, return_inverse=True)
        else:
            letter = ids
            _, first = np.unique(ids, return_index=True)
        n = np.bincount(ids, weights[at]).astype(np.int64).tolist()
        found = [(text[i:i + size], k) for i, k in zip(at[first].tolist(), n, strict=True)]
        if size == 1:
            found = [f for f in found if f[0] != " "]
        yield size, found


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, key, n) of every n-gram of counted words, `size` being its length."""

    def count(counts: dict[int, Counter], words: list[str], times: list[int]) -> None:
        for size, found in grams_in(words, times):
            held = counts[size]
            for gram, n in found:
                held[gram] += n

    return _summed(words.select("lang", F.col("key").alias("text"), "n"), count)


class Model:
    """Evidence by key: for each language that has it, (number, value)."""

    def __init__(self, languages: list[str], prior: list[int], totals: dict[tuple[str, int], int], entries: list[tuple[str, int, str, int]]) -> None:
        self.languages = languages
        self.usual = max(range(len(languages)), key=lambda i: (prior[i], -i), default=0)
        number = {lang: i for i, lang in enumerate(languages)}
        most = {size: max(totals.get((lang, size), 0) for lang in languages) for size in range(LONGEST + 1)} if languages else {}
        found: list[dict[str, list[tuple[int, float]]]] = [{} for _ in range(LONGEST + 1)]
        for lang, size, key, n in sorted(entries):
            floor = 0.5 / most[size]
            found[size].setdefault(key, []).append((number[lang], math.log(n / totals[lang, size] / floor + 1.0)))
        self.words, self.grams = found[0], found

    def evidence(self, word: str) -> list[tuple[int, float]]:
        known = self.words.get(word)
        return known if known is not None else self.unseen(word)

    def unseen(self, word: str) -> list[tuple[int, float]]:
        whole = f" {word} "
        for size in range(LONGEST, 0, -1):
            get = self.grams[size].get
            known = [found for i in range(len(whole) - size + 1) if (found := get(whole[i:i + size])) is not None]
            if known:
                sums: dict[int, float] = {}
                for found in known:
                    for i, value in found:
                        sums[i] = sums.get(i, 0.0) + value
                return [(i, s / len(known)) for i, s in sorted(sums.items())]
        return []

    def predict(self, text: str | None, memory: dict[str, list[tuple[int, float]]]) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.languages:
            return "und", 0.0
        sums = [0.0] * len(self.languages)
        for word, n in Counter(words).items():
            found = memory.get(word)
            if found is None:
                found = self.evidence(word)
                if len(memory) >= HELD:
                    memory.clear()
                memory[word] = found
            for i, value in found:
                sums[i] += n * value
        best = max(range(len(sums)), key=lambda i: (sums[i], i == self.usual, -i))
        scale = min(1.0, CERTAIN / len(words))
        return self.languages[best], 1.0 / sum(math.exp((s - sums[best]) * scale) for s in sums)


def learn(docs: DataFrame) -> Model:
    """The model of all rows of (text, lang) whose lang is not null.

    Counts cover all texts; only the selection is bounded. Keys with as few occurrences
    as those that no longer fit (in steps of an eighth of a power of two) stay out together.
    """
    spark = docs.sparkSession
    rows = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    languages = sorted(texts)
    words, words_path = written(word_counts(rows), "words")
    grams, grams_path = written(gram_counts(words), "grams")
    keys = words.union(grams)
    step = F.floor(F.log2("n") * 8).cast("int")
    totals: dict[tuple[str, int], int] = {}
    kept: dict[tuple[str, int], int] = {}
    room: dict[tuple[str, int], int] = {}
    short = (F.length("key") <= WORD_LETTERS).cast("int")
    for r in keys.groupBy("lang", "size", step.alias("step")).agg(F.sum(short).alias("keys"), F.sum("n").alias("n")).orderBy(F.col("step").desc()).collect():
        if r.lang not in texts:
            continue
        at = r.lang, r["size"]
        totals[at] = totals.get(at, 0) + r.n
        share = ENTRIES // len(texts)
        room.setdefault(at, min(WORDS, share // 2) if at[1] == 0 else min(GRAMS, share // 2 // LONGEST))
        room[at] -= r["keys"]
        if room[at] >= 0:
            kept[at] = r.step
    if kept:
        limits = spark.createDataFrame([(lang, size, least) for (lang, size), least in kept.items()], "lang string, size int, least int")
        chosen = keys.where(F.length("key") <= WORD_LETTERS).join(limits, ["lang", "size"]).where(step >= F.col("least")).select("lang", "size", "key", "n").toArrow()
        entries = list(zip(*(chosen[c].to_pylist() for c in ("lang", "size", "key", "n")), strict=True))
    else:
        entries = []
    for path in (words_path, grams_path):
        discard(spark, path)
    return Model(languages, [texts[lang] for lang in languages], totals, entries)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[tuple[int, float]]] = {}
        for batch in batches:
            found = [sent.value.predict(text.as_py(), memory) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of (doc_id, text, lang).

    Learns from the rows with a lang whose crc32 of doc_id, as text, is not 2 modulo 4
    (a null doc_id counts as the empty text: learned from); a prediction sees the text
    alone. A null text, one without a letter, and every text if nothing is labelled are
    `und` with score 0. Letters without any evidence give the language with the most
    texts (ties to the smaller name), at 1 / languages. Repeated rows count and are
    answered each time. The score is the posterior of equally likely languages, with the
    evidence scaled down to that of `CERTAIN` words where there are more.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = identified(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
