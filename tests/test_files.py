"""Files as they are: zipped dumps, line files, appends, and audits of what was published."""

import zipfile

from pyspark.sql import functions as F

from tidepanel.session import discard, staged
from tidepanel.sources import panel


def test_archives_round_trip(spark, tmp_path):
    rows = [("a-1", i, f"{i},x{i}") for i in range(25_000)] + [("b-1", 2, "z"), ("b-1", 1, "y"), ("b-1", 3, "")]
    lines = spark.createDataFrame(rows, "archive string, position bigint, line string")
    for header in (None, "open_time,px"):
        path = str(tmp_path / f"zips-{header is None}")
        told = {r.archive: r.lines for r in panel.write_archives(lines, path, header).collect()}
        assert told == {"a-1": 25_000, "b-1": 3}
        back = panel.zipped_lines(spark, path, "open_time")
        assert back.rdd.getNumPartitions() == 2
        got = [tuple(r) for r in back.collect()]
        assert sorted(got) == sorted((a, t) for a, _, t in rows if t)
        assert [t for a, t in got if a == "b-1"] == ["y", "z"]


def test_archives_are_compressed_and_the_same_each_time(spark, tmp_path):
    rows = [("a", i // 5, f"{i // 5},8,0.0001000{i % 5}") for i in range(30_000)]
    files = []
    for parts in (2, 7):
        lines = spark.createDataFrame(rows, "archive string, position bigint, line string").repartition(parts, "line")
        path = str(tmp_path / f"zips-{parts}")
        assert panel.write_archives(lines, path).first().lines == 30_000
        files.append(f"{path}/a.zip")
    with zipfile.ZipFile(files[0]) as archive:
        member = archive.infolist()[0]
        assert member.compress_type == zipfile.ZIP_DEFLATED and 4 * member.compress_size < member.file_size
        assert archive.read(member).decode() == "".join(f"{t}\n" for _, _, t in sorted(rows, key=lambda r: r[1:]))
    assert open(files[0], "rb").read() == open(files[1], "rb").read()


def test_json_lines_and_what_is_none(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "?", "b": "y"}',), ('{"a": 2',), ("",), ('{"b": "z"}',)], "value string").write.text(path)
    rows, refused = panel.json_lines(spark, path, "a bigint, b string")
    assert sorted(tuple(r) for r in rows.collect() if r.a) == [(1, "x")] and {r.b for r in rows.collect()} == {"x", "z"}
    assert sorted(r.line for r in refused.collect()) == ['{"a": "?", "b": "y"}', '{"a": 2']


def test_appends_compare_nulls_and_fields(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id bigint, a string, b string"
    grow = lambda *rows: sorted(r.id for r in panel.append_to_log(spark, path, spark.createDataFrame(rows, schema), "id").collect())
    assert grow((1, "x", None), (2, None, None)) == []
    assert grow((1, "x", None), (2, None, "y"), (3, None, None)) == [2]
    assert grow((1, None, "x"), (3, None, None)) == [1]
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "x", None), (2, None, None), (3, None, None)]


def test_an_append_is_judged_in_one_pass(spark, tmp_path, monkeypatch):
    path, made = str(tmp_path / "log"), []
    monkeypatch.setattr(panel, "staged", lambda df, label: made.append(label) or staged(df, label))
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, a string")
    assert panel.append_to_log(spark, path, rows, "id").count() == 0
    assert panel.append_to_log(spark, path, rows.withColumn("a", F.lit("x")), "id").collect() == [(2, "x")]
    assert made == ["news", "news"] and spark.read.parquet(path).count() == 2


def test_audit_of_published_files(spark, tmp_path):
    path = str(tmp_path / "dataset")
    rows = spark.createDataFrame([(k, i) for k in "abcd" for i in range(5)], "k string, i int")
    files = {r.file[2]: r.file for r in panel.publish_with_manifest(rows, path, ["k"]).collect()}
    assert sorted(files) == list("abcd") and panel.audit(spark, path).collect() == []
    discard(spark, f"{path}/{files['b']}")
    other = str(tmp_path / "other")
    spark.range(3).coalesce(1).write.parquet(other)
    panel.move_into(spark, other, f"{path}/{files['c']}")
    spark.range(3).coalesce(1).write.parquet(f"{path}/k=e")
    assert {(r.file[2], r.reason) for r in panel.audit(spark, path).collect()} == {("b", "missing"), ("c", "mismatched"), ("e", "unlisted")}
