"""Lineage, naming and SQL functions on edge rows."""

from pyspark.sql import functions as F

from fieldloom.functions import sql, text
from fieldloom.operators import checks, lineage


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_a_leaf_id_goes_before_a_file_name_group(spark):
    images = rows(spark, [(p, "c") for p in "abcdef"], "path string, class_name string")
    leaf = rows(spark, [("a", "L1"), ("b", ""), ("c", None), ("e", "L2")], "path string, leaf_id string")
    named = rows(spark, [("a", "N1"), ("b", "N2"), ("c", "N3"), ("d", "")], "path string, filename_group string")
    got = {r.path: (r.group_key, r.group_source, r.fate) for r in lineage.group_lineage(images, leaf, named, rows(spark, [("e",), ("e",)], "path string")).collect()}
    assert got == {"a": ("L1", "leaf_id", "eligible"), "b": ("N2", "tomato_filename_group", "eligible"), "c": ("N3", "tomato_filename_group", "eligible"), "d": (None, None, "quarantined"), "e": (None, None, "duplicate"), "f": (None, None, "quarantined")}


def test_an_image_without_a_leaf_needs_a_reviewed_cluster(spark):
    images = rows(spark, [(p, "c") for p in "abcd"], "path string, class_name string")
    one = lambda *p: rows(spark, [(x,) for x in p], "path string")
    members = rows(spark, [("b", 1), ("c", 2), ("d", 1)], "path string, cluster_id long")
    got = lineage.cluster_quarantine(images, rows(spark, [("a", "L")], "path string, leaf_id string"), members, rows(spark, [(1,), (1,)], "cluster_id long"), one("a"), one("a", "d"))
    assert {r.path: (r.group_source, r.reasons) for r in got.collect()} == {
        "a": ("leaf_id", ["cross_class_exact_hash_conflict", "cross_class_phash_conflict"]),
        "b": ("reviewed_phash_cluster", []),
        "c": (None, ["no_leaf_id_match_and_no_approved_cluster"]),
        "d": ("reviewed_phash_cluster", ["cross_class_phash_conflict"]),
    }


def test_collisions_and_large_groups(spark):
    values = rows(spark, [("A", "x"), ("B", "x"), ("A", "y"), ("A", "y"), ("B", None), ("A", None)], "class_name string, v string")
    assert [tuple(r) for r in lineage.class_collisions(values, "v").collect()] == [("x", ["A", "B"])]
    groups = rows(spark, [("big", 50), ("small", 2), ("fine", 60)], "group_key string, images long")
    got = checks.large_groups(groups, rows(spark, [("fine",), ("gone",), ("small",)], "group_key string"), 40)
    assert sorted(map(tuple, got.collect())) == [("big", 50, "large_but_not_approved"), ("gone", 0, "approved_but_absent")]


def test_what_a_file_name_shows(spark):
    names = ["raw/GH_HL Leaf 12.3.JPG", "a/0A1B2C3D-0000-4000-8000-0123456789ab___GHLB Leaf 3 Day 12.jpg", "IMG_7.png", None]
    df = rows(spark, [(n,) for n in names], "path string").select(*[c.alias(k) for k, c in text.name_flags(F.col("path")).items()])
    got = [tuple(r) for r in df.collect()]
    assert got == [(True, False, True, False, False), (False, True, False, True, False), (False, False, False, False, True), (None,) * 5]


def test_functions_in_sql_text(spark):
    assert "response_sections" in sql.register(spark) and sql.register(spark)
    got = spark.sql("SELECT s.* FROM VALUES ('x\\n## Diagnosis: Rust\\nSEVERITY - high ') AS t(r), LATERAL response_sections(r) AS s ORDER BY place").collect()
    assert [tuple(r) for r in got] == [(1, "DIAGNOSIS", "Rust"), (2, "SEVERITY", "high")]
    assert spark.sql("SELECT * FROM response_sections('no section here')").count() == 0 and spark.sql("SELECT * FROM response_sections(NULL)").count() == 0
    assert tuple(spark.sql("SELECT * FROM blight_leaf('a/ghlb2 Leaf 5.1 Day 3.JPG')").first()) == (True, "GHLB2", 5, 1, 3, "tlb::GHLB2::Leaf5")
    assert tuple(spark.sql("SELECT * FROM healthy_leaf('b/other.jpg')").first()) == (False, None, None, None)
    row = spark.sql("SELECT leaf_key('0a1b2c3d-0000-4000-8000-0123456789ab___GH Leaf '), file_stem('A.B.jpg'), severity_of('rather HIGH'), severity_of(''), hamming_distance(7, 2), whole_percent(0.985)").first()
    assert tuple(row) == ("gh leaf", "a.b", "high", "medium", 2, "99%")
    assert "Python" not in spark.sql("SELECT * FROM response_sections('a')")._jdf.queryExecution().executedPlan().toString()
