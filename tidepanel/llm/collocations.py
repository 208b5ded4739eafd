"""Collocations: phrases that occur more often than their parts suggest, counted in HAT-tries.

Phrases are counted length by length, each in one pass over the texts. A phrase
can only reach `least` if the two phrases one word shorter inside it do, so a
pass counts nothing else: the frequent phrases of the length before go out as a
Bloom filter of fixed size. What the filter lets through by mistake costs a count
and changes no result.

A task counts into a HAT-trie over its own word ids. Beyond `MEMORY` entries it
spills whole subtrees, largest first, as runs sorted by phrase; Spark merges the
runs of all tasks by partitions of the phrase. The partition is that of the
phrase as a whole and not of its first word, so that a common word is spread.
Nothing else is held: a task's memory is bounded by `MEMORY`, `VOCABULARY` and
`CHUNK` (and by its longest word), whatever the texts are.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import discard, written
from tidepanel.llm.hattrie import HatTrie

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bounds of a task: entries of its trie, ids of its words, bytes of text that are split at once.
MEMORY, VOCABULARY, CHUNK = 400_000, 400_000, 2 << 20
#: Rows of a batch of runs.
RUN = 20_000
#: The filter: 8 MB, four bits a phrase.
FILTER_BITS, FILTER_KEYS = 1 << 26, 4
#: A byte that no UTF-8 text holds stands for the end of a piece.
END = b"\xff"
_table = bytearray(range(256))
for _upper, _lower in zip(string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), strict=True):
    _table[_upper] = _lower
for _end in b".,;:!?\n\x0b\x0c\r":
    _table[_end] = END[0]
PLAIN = bytes(_table)


def hashed(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte integers, each with its own seed: what Spark's xxhash64 folds over an array of longs."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    h = seeds + p5 + np.uint64(8) ^ turned(values * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a Bloom filter holds."""
    low, high, found = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), np.ones(len(h), bool)
    for i in range(FILTER_KEYS):
        at = (low + np.uint64(i) * high) & np.uint64(FILTER_BITS - 1)
        found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def filter_bits(rows: DataFrame, h: Column) -> np.ndarray:
    """The Bloom filter of the rows' hashes: at most 8 MB reach the driver, however many they are."""
    keyed = rows.select(h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned(h, 32).alias("high"))
    spots = keyed.select(F.explode(F.array(*((F.col("low") + F.lit(i) * F.col("high")).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in range(FILTER_KEYS)))).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("mask")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bits


class Frequent:
    """A Bloom filter of phrases of a language; without bits it holds everything."""

    def __init__(self, bits: np.ndarray | None = None) -> None:
        self.bits = bits

    def holds(self, lang: bytes, phrases: np.ndarray) -> np.ndarray:
        """`phrases`: the hash of each word, one phrase a row."""
        found = np.ones(len(phrases), bool)
        if self.bits is None:
            return found
        h = hashed(np.full(len(phrases), word_hashes([lang])[0]), np.uint64(42))
        for word in phrases.T:
            h = hashed(word, h)
        return passes(self.bits, h)


def frequent(counts: DataFrame) -> Frequent:
    """The filter of the (lang, phrase) rows."""
    return Frequent(filter_bits(counts, F.xxhash64(F.transform(F.concat(F.array("lang"), F.split("phrase", " ")), lambda w: F.xxhash64(w)))))


class Seen(dict):
    """Numbers of words by first sight, the end of a piece being 0; `fresh` gathers those that are new."""

    def __init__(self) -> None:
        super().__init__({END: 0})
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Words:
    """Ids of words by first sight; -1 for the end of a piece and for words that the filter lacks."""

    def __init__(self, lang: bytes, known: Frequent, names: list[bytes], hashes: list[np.ndarray]) -> None:
        self.lang, self.known, self.names, self.hashes, self.ids = lang, known, names, hashes, Seen()
        self.held = np.full(1, -1)  # the id of each number

    def of(self, tokens: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        fresh, self.ids.fresh = self.ids.fresh, []
        hashes = word_hashes(fresh)
        known = self.known.holds(self.lang, hashes[:, None])
        self.held = np.append(self.held, np.where(known, len(self.names) + np.cumsum(known) - 1, -1))
        self.names += compress(fresh, known.tolist())
        self.hashes.append(hashes[known])
        return self.held[numbers]


class Counter:
    """Counts the phrases of `length` words in one task and gives them out as runs."""

    def __init__(self, length: int, known: Frequent, memory: int, vocabulary: int) -> None:
        self.length, self.known, self.memory, self.vocabulary = length, known, memory, vocabulary
        self._reset()

    def _reset(self) -> None:
        self.trie, self.names, self.langs, self.ids = HatTrie(self.length + 1), [], [], {}
        self.hashes: list[np.ndarray] = []

    def add(self, lang: bytes, tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
        if lang not in self.ids:
            self.ids[lang] = len(self.langs), Words(lang, self.known if self.length > 1 else Frequent(), self.names, self.hashes)
            self.langs.append(lang)
        number, words = self.ids[lang]
        found, counts = self._phrases(lang, words.of(tokens))
        if len(found):
            self.trie.add(np.hstack([np.full((len(found), 1), number), found]), counts)
        if self.trie.entries > self.memory:
            yield from self.spill(self.memory // 2)
        if len(self.names) + sum(len(w.ids) for _, w in self.ids.values()) > 2 * self.vocabulary:
            yield from self.spill(0)
            self._reset()

    def _phrases(self, lang: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct phrases as rows of word ids, sorted, and their counts."""
        grams, size = ids, len(self.names)
        rows = np.arange(size)[:, None]
        if self.length == 1:
            counts = np.bincount(ids[ids >= 0], minlength=size)
            return rows[counts > 0], counts[counts > 0]
        self.hashes[:] = hashes, = [np.concatenate(self.hashes)]
        for k in range(2, self.length + 1):
            whole = (grams[:-1] >= 0) & (grams[1:] >= 0)
            pairs, which, counts = np.unique(grams[:-1][whole] * size + ids[k - 1:][whole], return_inverse=True, return_counts=True)
            rows = np.hstack([rows[pairs // max(size, 1)], (pairs % max(size, 1))[:, None]])
            if k < self.length:
                alive = self.known.holds(lang, hashes[rows])
                grams = np.full(len(whole), -1)
                grams[whole] = np.where(alive[which], which, -1) if len(pairs) else which
        return rows, counts

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Whole subtrees of the trie as runs, each sorted by language and phrase."""
        names, langs = pa.array(self.names, pa.binary()), pa.array(self.langs, pa.binary())
        run: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for subtree in self.trie.spill(keep):
            run.append(subtree)
            size += len(subtree[1])
            if size >= RUN:
                yield self._batch(run, names, langs)
                run, size = [], 0
        if run:
            yield self._batch(run, names, langs)

    def _batch(self, run: list[tuple[np.ndarray, np.ndarray]], names: pa.Array, langs: pa.Array) -> pa.RecordBatch:
        rows, counts = (np.concatenate(x) for x in zip(*run, strict=True))
        words = [names.take(pa.array(ids)) for ids in rows.T[1:]]
        phrases = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
        table = pa.RecordBatch.from_arrays([langs.take(pa.array(rows[:, 0])).cast(pa.string()), phrases.cast(pa.string()), pa.array(counts)], ["lang", "phrase", "n"])
        return table.sort_by([("lang", "ascending"), ("phrase", "ascending")])


def pieces(text: bytes, overlap: int, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words and ends of a text in lists of about `chunk` bytes; each list but the first begins with the last `overlap` of the one before."""
    at, tail = 0, []
    while at < len(text):
        upto = text.find(b" ", at + chunk) if len(text) > at + chunk else -1
        upto = len(text) if upto < 0 else upto
        tokens = tail + text[at:upto].translate(PLAIN).replace(END, b" \xff ").split()
        yield tokens
        at, tail = upto, tokens[-overlap:] if overlap else []


def counted(docs: DataFrame, length: int, known: Frequent | None = None, memory: int = MEMORY, vocabulary: int = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, n) of all phrases of `length` words whose shorter phrases `known` holds."""
    sent = docs.sparkSession.sparkContext.broadcast(known or Frequent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(length, sent.value, memory, vocabulary)
        for batch in batches:
            held: dict[bytes, list[bytes]] = {}
            for lang, text in zip(batch["lang"].cast(pa.binary()), batch["text"].cast(pa.binary()), strict=True):
                tokens = held.setdefault(lang.as_py(), [])
                for part in pieces(text.as_py(), length - 1, chunk):
                    tokens += part
                    tokens.append(END)
                    if len(tokens) > chunk // 4:
                        yield from counter.add(lang.as_py(), tokens)
                        tokens.clear()
            for lang, tokens in held.items():
                yield from counter.add(lang, tokens)
        yield from counter.spill(0)

    runs = docs.mapInArrow(run, "lang string, phrase string, n long")
    return runs.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, list[str]]:
    """(lang, words, phrase, a) of the phrases that occur at least `least` times, (lang, n) of all words, and the paths of both."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, words_path = written(counted(rows, 1), "words")
    totals, totals_path = written(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    level, path = written(words.where(F.col("a") >= least).select("lang", F.lit(1).alias("words"), "phrase", "a"), "phrases")
    discard(docs.sparkSession, words_path)
    levels, paths = level, [totals_path, path]
    for length in range(2, longest + 1):
        if level.isEmpty():
            break
        more = counted(rows, length, frequent(levels)).where(F.col("a") >= least)
        level, path = written(more.select("lang", F.lit(length).alias("words"), "phrase", "a"), "phrases")
        levels, paths = levels.union(level), [*paths, path]
    return levels, totals, paths


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` collocations of (text, lang).

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
    pieces into words at blanks and tabs. A phrase of 2 to `longest` words that
    occurs a >= `least` times is a candidate. Its score is the least, over its cuts
    into two parts that occur l and r times, of floor(1000 a n / (l r)), n being
    the words of the language; among equal cuts the first counts. A candidate goes
    if a longer one holds it and occurs as often. Ranks are by score, then a, both
    descending, then phrase by its UTF-8 bytes.

    A null text is empty; a null lang is the language `und`. Repeated rows count each
    time. No words, no rows. Products are decimals of 38 digits: exact for counts
    below 10^17, and an error beyond. Words are whole, however long.
    """
    levels, totals, _ = phrases(docs, least, longest)
    candidates = levels.where("words > 1")
    parts = F.split("phrase", " ")
    cuts = candidates.withColumn("w", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("right"))
    left = levels.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = levels.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    whole = "cast({} as decimal(18, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {whole.format('a')} * {whole.format('n')}) div ({whole.format('l')} * {whole.format('r')})")
    scored = (cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
              .select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
              .groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")))
    longer = candidates.where("words > 2").withColumn("w", parts).select("lang", "a", F.explode(F.array(
        F.concat_ws(" ", F.slice("w", F.lit(1), F.col("words") - 1)), F.concat_ws(" ", F.slice("w", F.lit(2), F.col("words") - 1)))).alias("phrase"))
    # What holds a phrase and occurs as often also holds, between the two, one a word longer that does.
    kept = scored.join(longer.distinct(), ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
