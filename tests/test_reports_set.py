"""Report sets take effect at once: torn runs are invisible, and numbers can't be taken twice."""

import pytest

from fieldloom import commits
from fieldloom.sources import reports


def built(spark, n):
    return {name: spark.range(n + k).withColumnRenamed("id", name) for k, name in enumerate(reports.REPORTS["validation"])}


def test_a_set_replaces_the_one_before(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    with pytest.raises(FileNotFoundError):
        reports.committed(spark, folder)
    assert reports.commit("validation", built(spark, 3), folder) == {"checks": 3, "overlaps": 4, "cluster_consistency": 5}
    reports.commit("validation", built(spark, 10), folder, {"at": "now"})
    assert reports.open_report(spark, folder, "overlaps").count() == 11
    assert reports.committed(spark, folder)["metadata"] == {"at": "now"} and reports.committed(spark, folder)["rows"]["checks"] == 10
    with pytest.raises(KeyError):
        reports.open_report(spark, folder, "absent")
    assert reports.sweep(spark, folder) == 1 and reports.open_report(spark, folder, "checks").count() == 10


def test_a_torn_run_is_invisible(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    reports.commit("validation", built(spark, 3), folder)
    torn = built(spark, 20)
    torn["cluster_consistency"] = torn["cluster_consistency"].selectExpr("raise_error('the disk is full') AS x")
    with pytest.raises(Exception, match="disk is full"):
        reports.commit("validation", torn, folder)
    assert reports.open_report(spark, folder, "checks").count() == 3
    with pytest.raises(ValueError, match="declared"):
        reports.commit("validation", {"checks": torn["checks"]}, folder)
    assert reports.sweep(spark, folder) == 1
    reports.commit("validation", built(spark, 4), folder)
    assert reports.open_report(spark, folder, "checks").count() == 4


def test_numbers_are_taken_once(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    commits.put(spark, folder, 1, {"a": 1})
    with pytest.raises(commits.Taken):
        commits.put(spark, folder, 1, {"a": 2})
    commits.put(spark, folder, 2, {"a": "é"})
    assert commits.last(spark, folder) == (2, {"a": "é"})
    commits.trim(spark, folder)
    assert commits.last(spark, folder) == (2, {"a": "é"}) and commits.last(spark, f"{folder}/none") is None
