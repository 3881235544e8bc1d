"""The pipeline's stages on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import random

import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, doc long, sig long, component long, rest string, y int"


def odd_rows():
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    near = words(100)
    rows = [(1, None), (2, ""), (3, " \n "), (None, None), (None, ""), (4, words(60)), (4, words(70)), (5, near), (6, near + " tail"), (None, near), (7, words(150_000)), (8, "x"), (8, "x"), (9, "tick " * 5000)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, 2, 3, "r", 4) for i, t in rows], COLUMNS)


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, step):
    rows = odd_rows()
    docs = table(spark, rows)
    got = step(spark, docs, DATA)
    out = [r.asDict() for r in got.collect()]
    if name != "byte_level_bpe":
        assert got.columns == docs.columns
        assert all(r["doc"] == 1 and r["sig"] == 2 and r["component"] == 3 and r["rest"] == "r" and r["y"] == 4 for r in out)
    if name in ("toxicity", "benchmark_decontamination"):
        assert len(out) == len(rows)
    if name == "simhash_near_dedup":
        assert sorted((r["doc_id"], (r["text"] or "")[:9]) for r in out) == sorted((i, (t or "")[:9]) for i, t in [rows[0], rows[5], rows[6], rows[7], rows[10], rows[11], rows[13]])
    if name == "substring_dedup":
        cut = {5: "", 6: "tail", 9: ""}
        want = [(i, "" if i is None and t else cut.get(i, t)) for i, t in rows]
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(want, key=str)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)
    if name == "byte_level_bpe":
        assert len(out) == len(rows) and sorted(r["n_tokens"] for r in out)[:4] == [0, 0, 0, 0]
    none = step(spark, docs.limit(0), DATA)
    assert none.count() == 0
