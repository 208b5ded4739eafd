"""Reports of one job."""

from tidepanel.catalog.reports import reports
from tidepanel.catalog.tables import Tables


def test_a_job_of_several_reports_runs_once(spark):
    tables, runs = Tables(spark, "/root/testdata/sf0.001"), []

    def job():
        runs.append(1)
        return spark.range(2), spark.range(3)

    for _ in range(2):
        assert [r.count() for r in reports(tables, ["two-rows", "three-rows"], job)] == [2, 3]
    assert runs == [1]
