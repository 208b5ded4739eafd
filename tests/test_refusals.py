"""Refused payload rows: each reason, nulls, and what another page recovers."""

from pyspark.sql import Row

from tidepanel.sources import payloads, refusals


def test_candles_by_field_and_shape(spark):
    sound = '["1","1","2","1","1","5","5","9","1"]'
    pages = [
        ("a", '{"code":"0","data":[%s,["2","x","2","1","1","5","5","9","1"],["3","1","2","1","1","5","5","9"]]}' % sound),
        ("b", '{"code":"1","data":[%s]}' % sound), ("c", "no json"), ("d", None), ("e", '{"code":"0","data":[]}'),
    ]
    rows = payloads.array_candles(
        spark.createDataFrame(pages, "name string, payload string"), "payload", interval_ns=10, availability_lag_ns=1, keep=["name"])
    got = refusals.refused_fields(rows, ["name", "open_time_ns"], refusals.CANDLE_FIELDS).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("a", 2_000_000, "open"), ("a", 3_000_000, "shape"), ("b", 1_000_000, "shape"),
        ("c", None, "open_time_ns"), ("d", None, "open_time_ns"), ("e", None, "open_time_ns")], key=str)


def test_books_by_side(spark):
    level = '[["1.0","2.0"]]'
    texts = [
        f'{{"lastUpdateId":1,"T":5,"bids":{level},"asks":{level}}}', f'{{"lastUpdateId":2,"T":5,"bids":[["0","1"]],"asks":null}}',
        f'{{"lastUpdateId":3,"T":5,"bids":{level},"asks":[["1","-1"]]}}', f'{{"lastUpdateId":4,"bids":{level},"asks":[]}}', "",
    ]
    rows = payloads.rest_depth(spark.createDataFrame([(x,) for x in texts], "m string"), "m", [])
    got = {r.sequence: r.reason for r in refusals.refused_books(rows, ["sequence"]).collect()}
    assert got == {2: "bids", 3: "asks", 4: "header", None: "bids"}


def test_recovery_by_another_page(spark):
    schema = "k int, v int, malformed boolean"
    rows = spark.createDataFrame([(1, None, True), (1, None, True), (1, 7, False), (1, 7, False), (2, None, True), (2, 4, True), (None, None, True)], schema)
    got = refusals.recovered(rows, ["k"], ["v"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "v", 2, True), (2, "v", 1, False), (2, "shape", 1, False), (None, "v", 1, False)], key=str)
    assert set(got[0].asDict()) == set(Row("k", "reason", "copies", "recovered"))
    assert refusals.recovered(rows.limit(0), ["k"], ["v"]).collect() == []
