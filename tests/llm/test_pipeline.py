"""The corpus pipeline: every stage by its own input, and the entry module without it."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from tidepanel.llm import bpe
from tidepanel.llm.common import written

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_columns_and_counts(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    for name in names[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes
    counts = [stages[n].count() for n in ("documents", *names)]
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2] and counts[4] == counts[5]
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"].collect())


def shingle_set(text):
    """Five-word shingles of a text, written anew; a shorter text is one shingle."""
    words = re.findall(rb"[^ \t-\r]+", text.encode().lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_keeps_one_of_each_group(stages):
    rows = stages["line_dedup"].collect()
    sets = [shingle_set(r.text) for r in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[up(i)] = up(j)
    best = {}
    for i, r in enumerate(rows):
        best[up(i)] = min(best.get(up(i), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == sorted(best.values())


def test_last_stage_decodes_to_the_text(stages):
    codec = bpe.encoder(bpe.vocabulary_path())
    texts = {r.doc_id: r.text for r in stages["decontaminate"].collect()}
    for r in stages["bpe"].collect():
        assert codec.decode(bpe.packed(r.ids)) == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_repeats_and_nulls_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", None, None, None),
            (None, None, None, None, None), (None, "", "en", "s", 0), (2, "other words stand here now", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0 for r in kept)) == [0, 1, 2]
    out = corpus_pipeline.line_dedup(spark, docs, SF).collect()
    assert len(out) == 6 and sum(r.text == "a b c d e f" for r in out) == 1
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name


def test_entry_works_without_the_subpackage(tmp_path):
    (tmp_path / "tidepanel").mkdir()
    for p in (ROOT / "tidepanel").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tidepanel" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    (tmp_path / "entry.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import entry; names = entry.queries(); assert len(names) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
