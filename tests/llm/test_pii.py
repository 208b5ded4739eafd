"""Spans against plain regular expressions over the whole text."""

import random
import re

from tidepanel.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and sum(
                    int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


def base(text):
    return [s for s in pii.find(text) if s[1] in pii.BASE]


def test_random_texts_match_plain_patterns():
    draw = random.Random(5)
    parts = ["@", "a", "b.c", ".", "-", "+", "1", "12", "255", "256", " ", "4111 1111 1111 1111", "+49 (30) 123-4567 89", "x@y.z",
             "1.2.3.4", "٣", "é", "_", "%", "iban ", "http://", "00", "(", "\n", "4111111111111111", "İ"]
    for _ in range(20000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert base(text) == plain(text), text


def test_tables_match_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for doc, found in zip(docs.collect(), pii.detect(docs).collect(), strict=True):
        assert doc.doc_id == found.doc_id
        assert [(f.start, f.kind, f.end) for f in found.found if f.kind in pii.BASE] == plain(doc.text)


def test_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, ssn 078-05-1120; see https://me:pw@host.org/x. and http://a.org/~jo and http://a.org/x"
    found = [(k, text[s:e]) for s, k, e in pii.find(text)]
    assert ("account", "GB82 WEST 1234 5698 7654 32") in found and ("account", "078-05-1120") in found
    assert ("url", "https://me:pw@host.org/x") in found and ("url", "http://a.org/~jo") in found
    assert not any(v == "http://a.org/x" for _, v in found)


def test_long_runs_and_nulls(spark):
    assert base("1" * 100000) == [] and base("1." * 50000 + "1") != []
    rows = [(None, None, "x"), (1, "", "x"), (1, "a@b.cd", "x"), (1, "a@b.cd", "x")]
    out = pii.digest(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in out] == [(None, 0, ""), (1, 0, ""), (1, 1, "email:0:6"), (1, 1, "email:0:6")]
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert pii.masked(spark.createDataFrame([(1, "to a@b.cd.")], "doc_id long, text string")).first().text == "to [email]."
