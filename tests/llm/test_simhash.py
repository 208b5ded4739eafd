"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash

from tidepanel.llm import bktree, graph, simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius):
    parent = list(range(len(rows)))

    def up(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= radius:
                parent[up(i)] = up(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[up(i)] = min(best.get(up(i), doc), doc)
    return [best[up(i)] for i in range(len(rows))]


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(d.doc_id, plain_print(d.text)) for d in docs.collect()]
    want = {(d, f"{fp:016x}", c) for (d, fp), c in zip(rows, plain_components(rows, 2), strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want
    assert len({c for _, _, c in want}) < len(want) - 10


def test_dense_crowd_over_several_trees(spark):
    draw = random.Random(2)
    center = draw.getrandbits(64)
    prints = {center}
    while len(prints) < 300:
        prints.add(center ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(1, 5))) & (1 << 64) - 1)
    prints |= {draw.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, tree=16)
    root = {r.node: r.root for r in graph.components(found, "a", "b").collect()}
    got = [root.get(p, p) for p in signed]
    assert got == plain_components([(p, p & (1 << 64) - 1) for p in signed], 2)


def test_forest_finds_all_within_radius():
    draw = np.random.default_rng(3)
    values = np.unique(draw.integers(0, 1 << 12, 400).astype(np.uint64))
    forest = bktree.Forest(values, np.zeros(len(values), np.int64))
    pairs = {(int(q), int(v)) for who, node in forest.within(values, np.zeros(len(values)), 2) for q, v in zip(who, node, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert pairs == want


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, None, 1), (None, "", 1), (3, "  \n", 1), (7, "a b", 1), (7, "a b", 1), (9, "A  b", 1), (None, "solo text", 1)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(out) == 7
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {3}
    assert [r.component_id for r in out if r.doc_id in (7, 9)] == [7, 7, 7]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert simhash.fingerprint(b"a b c d " * 50000) == plain_print("a b c d " * 50000)
