"""Contamination against brute force."""

import hashlib
import random
import re

from tidepanel.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wanted = []
    for item, text, *_ in items:
        w = words(text)
        wanted += [("null" if item is None else str(item), w[i:i + 10]) for i in range(max(len(w) - 9, 1)) if w]
    out = []
    for doc, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for name, window in wanted:
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names.add(name)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def test_random_texts(spark):
    draw = random.Random(1)
    text = lambda n: " ".join(draw.choice("the of and To x1 é".split()) for _ in range(n))
    items = [(i, text(draw.choice([1, 2, 4, 5, 9, 10, 11, 14])), 0) for i in range(25)] + [(3, "?", 0), (None, "of é of", 0), (99, None, 0)]
    items += [(50, "a b c d e f g h i j k", 0), (50, "a b c d e f g h i j k", 0), (51, "A, b c d e f g h i j", 0)]
    docs = [(i, text(draw.randrange(0, 60)), 0, 0) for i in range(60)] + [(7, "x a b c d e f g h i j k a b c d e f g h i j", 0, 0)] * 2
    docs += [(None, None, 0, 0), (8, "", 0, 0), (9, "a b c d e f g h i " * 3000 + "j", 0, 0)]
    made = (spark.createDataFrame(docs, "doc_id long, text string, words int, pos int"), spark.createDataFrame(items, "item_id long, text string, n int"))
    want = brute(docs, items)
    assert sorted((tuple(r) for r in decontaminate.digest(*made).collect()), key=str) == want
    blocks = decontaminate.contamination(*made, block=7).select("doc_id", "n_hit", "n_items").collect()
    assert sorted(map(tuple, blocks), key=str) == sorted(((d, h, i) for d, _, h, i, _, _ in want), key=str)
    kept = decontaminate.decontaminated(*made).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.digest(docs, items).collect()] == [(2, 0, 0)]
    assert decontaminate.digest(docs.limit(0), items).collect() == []
    assert decontaminate.decontaminated(docs, items).count() == 1
