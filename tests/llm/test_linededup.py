"""Deleted lines against brute force."""

import random

from tidepanel.llm import linededup


def brute(rows, least):
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r))
    flat = []  # (row, line, squeezed) of lines with words; a break between texts
    for r in order:
        text = rows[r][1]
        flat += [(r, i, " ".join(x.split())) for i, x in enumerate(text.split("\n")) if x.split()] if text is not None else []
        flat.append(None)
    gone = {r: set() for r in range(len(rows))}
    for i in range(len(flat)):
        best = 0
        for j in range(i):
            n = 0
            while i + n < len(flat) and flat[i + n] and flat[j + n] and flat[i + n][2] == flat[j + n][2]:
                n += 1
            best = max(best, n)
        if sum(len(flat[i + n][2].split()) for n in range(best)) >= least:
            for n in range(best):
                gone[flat[i][0]].add(flat[i + n][1])
    out = []
    for r, (doc, text, *_) in enumerate(rows):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines, cut = text.split("\n"), gone[r]
        words = [i for i, x in enumerate(lines) if x.split()]
        for a, b in zip(words, words[1:]):  # lines without words go with a run around them
            if a in cut and b in cut:
                cut |= set(range(a, b))
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut)))
    return sorted(out, key=str)


def run(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, n_lines int").coalesce(1)
    got = linededup.deduplicated(docs, least).select("doc_id", "text", "n_lines", "n_deleted").collect()
    return sorted(map(tuple, got), key=str)


def test_random_line_sequences(spark):
    draw = random.Random(3)
    for least in (1, 4):
        rows = [(i, "\n".join(draw.choice(["a b", "c", "d e f", " c ", "", "g", "a  b"]) for _ in range(draw.randrange(0, 25))), 0, 0) for i in range(25)]
        rows += [(100 + i, "\n".join(f"u{i} {n}" for n in range(9)), 0, 0) for i in range(3)] + [rows[3], (None, rows[4][1], 0, 0), (7, None, 0, 0)]
        assert run(spark, rows, least) == brute(rows, least)


def test_long_copies_and_self_repeats(spark):
    long = "\n".join(f"line number {i} of it" for i in range(37))
    rows = [(2, long, 0, 0), (1, "x\n" + long + "\ny", 0, 0), (3, long[:200], 0, 0), (4, "\n".join(["same line again"] * 20), 0, 0), (5, "", 0, 0)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, linededup.deduplicated(docs).select("doc_id", "text", "n_lines", "n_deleted").collect()), key=str)
    assert got == brute([(d.doc_id, d.text) for d in docs.collect()], linededup.MIN_WORDS)
    assert any(r[3] for r in got)


def test_nothing_repeats_and_empty_table(spark):
    assert run(spark, [(1, "a b c d e\nf", 0, 0)], 1) == [(1, "a b c d e\nf", 2, 0)]
    assert run(spark, [(1, None, 0, 0)], 1) == [(1, None, 0, 0)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.deduplicated(docs).collect() == []
