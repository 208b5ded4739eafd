"""Collocations against brute force, and the trie against a plain counter."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidepanel.llm import collocations
from tidepanel.llm.hattrie import HatTrie


def plain(rows, least, longest, top):
    counts = defaultdict(Counter)
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            for m in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {(p[i:j], a) for p, a in held.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p)}
        kept = []
        for p, a in held.items():
            if (p, a) in inside:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(count, seed=1):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "é", "ab", "ba", "x1", "\x1c", " "]
    marks = [" ", " ", " ", "  ", "\t", ", ", "\n", "; "]
    return [("".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(0, 60))), draw.choice(["en", "en", "de", None, "und"])) for _ in range(count)]


def test_matches_brute_force(spark):
    rows = [*texts(200), (None, "en"), ("", "de"), ("...,", None), ("new york city " * 40, "en")]
    docs = spark.createDataFrame([(i, *r, 1, 2, 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int, a int, phrase int")
    for least, longest, top in ((3, 5, 10_000), (5, 3, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, top).collect())
        assert got == plain(rows, least, longest, top) and got


def test_bounds_change_nothing(spark):
    rows = [*texts(120, 2), (" ".join(t for t, _ in texts(60, 3)), "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("coalesce(lang, 'und') lang", "text")
    for length in (1, 2, 4):
        want = {tuple(r) for r in collocations.counted(docs, length).collect()}
        got = {tuple(r) for r in collocations.counted(docs, length, memory=40, vocabulary=5, chunk=50).collect()}
        assert got == want and want


def test_filter_prunes_and_keeps_all_frequent(spark):
    docs = spark.createDataFrame(texts(200, 4), "text string, lang string").selectExpr("coalesce(lang, 'und') lang", "text")
    words = collocations.counted(docs, 1).where("a >= 150")
    known = collocations.frequent(words)
    want = {r.phrase for r in words.where("lang = 'en'").collect()}
    hashes = lambda found: collocations.word_hashes([w.encode() for w in found])[:, None]
    assert known.holds(b"en", hashes(sorted(want))).all()
    assert not known.holds(b"en", hashes(f"never seen {i}" for i in range(200))).any()
    pairs = {r.phrase for r in collocations.counted(docs, 2, known).where("lang = 'en'").collect()}
    assert pairs and {w for p in pairs for w in p.split(" ")} <= want


def test_trie_bursts_and_spills():
    draw = np.random.default_rng(5)
    trie, want = HatTrie(3, burst=16), Counter()
    got = Counter()

    def take(keep):
        for rows, counts in trie.spill(keep):
            for row, n in zip(rows.tolist(), counts.tolist(), strict=True):
                got[tuple(row)] += n

    for _ in range(30):
        rows, counts = np.unique(draw.integers(0, 9, (100, 3)), axis=0, return_counts=True)
        want.update({tuple(r): n for r, n in zip(rows.tolist(), counts.tolist(), strict=True)})
        trie.add(rows, counts)
        if trie.entries > 200:
            take(100)
            assert trie.entries <= 100
    take(0)
    assert got == want and trie.entries == 0


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("?!", "en")], "text string, lang string")).collect() == []


def test_each_token_is_looked_up_once():
    asked = Counter()

    class Word(bytes):
        def __hash__(self):
            asked[bytes(self)] += 1
            return hash(bytes(self))

    names, hashes = [], []
    words = collocations.Words(b"en", collocations.Frequent(), names, hashes)
    other = collocations.Words(b"de", collocations.Frequent(), names, hashes)
    assert words.of([b"a", collocations.END, b"b", b"a"]).tolist() == [0, -1, 1, 0]
    assert other.of([b"b"]).tolist() == [2] and words.of([b"c", b"b"]).tolist() == [3, 1]
    assert words.of([]).tolist() == [] and names == [b"a", b"b", b"b", b"c"] and sum(map(len, hashes)) == 4
    tokens = [Word(b"w%d" % (i % 7)) for i in range(700)]
    assert words.of(tokens).tolist() == [4 + i % 7 for i in range(700)]
    assert sum(asked.values()) <= len(tokens) + 7 * 2
