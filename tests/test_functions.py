"""Text, date and number functions on single values."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalars, text
from fieldloom.operators import provenance


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"]) if values else spark.range(1)
    return df.select(column.alias("r")).first().r


def test_sections(spark):
    r = one(spark, text.parsed_response(F.col("t")), t="DIAGNOSIS: Healthy plant\nSEVERITY: Healthy\nCONFIDENCE: 80\nTREATMENT: none\nPREVENTION: none")
    assert (r.diagnosis, r.severity, r.confidence, r.treatment, r.prevention, r.expert_advice) == ("Healthy plant", "healthy", 80, "none", "none", None)


def test_empty_section_runs_into_the_next(spark):
    r = one(spark, text.parsed_response(F.col("t")), t="DIAGNOSIS:\n\nSEVERITY: High")
    assert r.diagnosis == "SEVERITY: High" and r.severity == "medium"


def test_text_without_sections(spark):
    r = one(spark, text.parsed_response(F.col("t")), t="short\nA line that is long enough to count.")
    assert r.diagnosis == "A line that is long enough to count." and r.confidence == 75 and r.treatment == text.DEFAULT_TREATMENT
    assert one(spark, text.parsed_response(F.col("t")), t="x" * 15).diagnosis == "x" * 15


def test_tags(spark):
    assert one(spark, text.tags(F.col("q"), F.col("c"), F.col("k")), q="Pest and FUNGAL pest", c="Tomato", k="pest") == ["pest", "tomato", "fungal"]
    assert one(spark, text.tags(F.col("q"), F.col("c"), F.col("k")), q="", c="", k="soil") == ["soil"]


@pytest.mark.parametrize("name,key,sub", [("GH_HL Leaf 12.3.JPG", "th::Leaf12", 3), ("0a1b2c3d-0000-4000-8000-0123456789ab___gh_hl leaf 7 .jpeg", "th::Leaf7", None), ("IMG_1.jpg", None, None)])
def test_healthy_names(spark, name, key, sub):
    r = one(spark, text.healthy_name(F.col("p")), p=f"a/{name}")
    assert (r.group_key, r.sub_index) == (key, sub)


@pytest.mark.parametrize("name,key,day", [("GHLB2 Leaf 5.1 Day 12.JPG", "tlb::GHLB2::Leaf5", 12), ("ghlb2es Leaf 5.jpg", "tlb::GHLB2ES::Leaf5", None), ("GHLB_PS  Leaf 8.jpg", "tlb::GHLB_PS::Leaf8", None)])
def test_blight_names(spark, name, key, day):
    r = one(spark, text.blight_name(F.col("p")), p=name)
    assert (r.group_key, r.day_number) == (key, day)


def test_small_text_functions(spark):
    v = lambda c, **k: one(spark, c, **k)
    assert v(text.first_underscore(F.col("x")), x="crop_disease_x") == "crop disease_x"
    assert v(text.stem(F.col("x")), x=" A.b.JPG") == "a.b"
    assert v(text.safe_filename(F.col("x")), x="../a\x00b.png") == "ab.png"
    assert v(text.safe_filename(F.col("x")), x="dir/") == "upload"
    assert v(text.extension(F.col("x")), x="a.B.PNG") == ".png" and v(text.extension(F.col("x")), x="a") == ""
    assert v(text.percent(F.lit(0.125))) == "13%"
    assert v(text.unquoted(F.col("x")), x='"key"') == "key"
    assert v(text.join_given(" ", F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == "a b"


def test_months_back_runs_over(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, scalars.months_back(at("2024-08-31 10:20:30"), 6)) == dt.datetime(2024, 3, 2, 10, 20, 30)
    assert one(spark, scalars.months_back(at("2024-07-15 00:00:00"), 6)) == dt.datetime(2024, 1, 15)


@pytest.mark.parametrize("seconds,said", [(5, "just now"), (60, "1m ago"), (3599, "59m ago"), (86399, "23h ago"), (604799, "6d ago"), (604800, "2024-01-01")])
def test_time_ago(spark, seconds, said):
    then = dt.datetime(2024, 1, 1)
    assert one(spark, scalars.time_ago(F.lit(then), F.lit(then + dt.timedelta(seconds=seconds)))) == said


def test_numbers(spark):
    v = lambda c, **k: one(spark, c, **k)
    arr = lambda *x: F.array(*map(F.lit, x))
    assert v(scalars.last_n(arr(1, 2, 3), 5)) == [1, 2, 3] and v(scalars.last_n(arr(1, 2, 3), 2)) == [2, 3]
    assert v(scalars.argmax(arr(1.0, 3.0, 3.0))) == 1
    assert [(t["index"], t.value) for t in v(scalars.top_k(arr(0.2, 0.5, 0.2, 0.1), 3))] == [(1, 0.5), (0, 0.2), (2, 0.2)]
    assert len(v(scalars.top_k(arr(0.2, 0.8), 9))) == 2 and len(v(scalars.top_k(arr(0.2, 0.8), 0))) == 1
    assert sum(v(scalars.softmax(arr(1.0, 2.0, 1000.0)))) == pytest.approx(1)
    assert v(scalars.hamming(F.lit(0b1010), F.lit(0b0110))) == 2
    assert v(scalars.sign_bits(arr(1.0, -1.0, 2.0))) == 0b101
    assert [v(scalars.bin_right(F.lit(x), 10)) for x in (0.0, 0.1, 0.11, 1.0)] == [0, 0, 1, 9]
    assert v(scalars.toggled(arr("a", "b"), F.lit("a"))) == ["b"] and v(scalars.toggled(arr("a"), F.lit("b"))) == ["a", "b"]
    assert v(scalars.inverted(F.create_map(F.lit("0"), F.lit("x")))) == {"x": "0"}
    assert [v(scalars.leading_int(F.lit(x))) for x in ("20abc", " -3", "abc", "")] == [20, -3, None, None]
    assert [v(scalars.flag(F.lit(x), True)) for x in ("YES", " 1", "no", "")] == [True, True, False, True]
    assert v(scalars.listed(F.lit('["a","b"]'))) == ["a", "b"] and v(scalars.listed(F.lit("a, b,"))) == ["a", "b"]
    assert v(scalars.ratio(F.lit(1), F.lit(0))) is None and v(scalars.ratio0(F.lit(1), F.lit(0))) == 0.0


def body(**change):
    p = {"class_name": "Tomato Late Blight", "class_index": 2, "model_confidence": 0.98, "accepted": True, "uncertain": False, "message": ""}
    tops = [{"class_name": "Tomato Late Blight", "class_index": 2, "model_confidence": c} for c in (0.1, 0.9, 0.3, 0.2)]
    b = {"status": "success", "prediction": p | change, "top_predictions": tops, "confidence_policy": {"method": "maximum_softmax_probability", "threshold": 0.5, "label": "model confidence", "production_calibrated": False}, "limitations": ["x"] * 12}
    return json.dumps(b)


def test_upstream_bodies(spark):
    rows = [(1, body()), (2, body(class_index=3)), (3, body(uncertain=True)), (4, "not json"), (5, body(model_confidence=1.5))]
    out = {r.id: r for r in provenance.normalised_upstream(spark.createDataFrame(rows, "id int, body string")).collect()}
    assert [out[k].valid for k in range(1, 6)] == [True, False, False, False, False]
    assert [t.modelConfidence for t in out[1].topPredictions] == [0.9, 0.3, 0.2] and len(out[1].limitations) == 10
    assert (out[1].crop, out[1].condition, out[1].healthy) == ("Tomato", "Late Blight", False)


@pytest.mark.parametrize("second,custom,said", [(False, True, "custom-ml"), (True, True, "combined"), (False, False, "gemini")])
def test_provider(spark, second, custom, said):
    assert one(spark, provenance.persisted_provider(F.lit(second), F.lit(custom))) == said
