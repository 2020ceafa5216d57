from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelens.llm.mixing import bounded_cells, calibrated_cells, mixture, reached_shares, sample_mixture
from tests.conftest import local_frame

CELLS = [("a", "en", 0, 800), ("a", "de", 0, 100), ("b", "en", 1, 50), ("b", "de", 1, 50), ("b", "en", 0, 40)]
DDL = "source string, lang string, topic int, tokens long"


def test_raking_meets_the_targets(spark):
    cells = local_frame(spark, CELLS, DDL)
    targets = {
        "source": local_frame(spark, [("a", 3.0), ("b", 1.0)], "source string, share double"),
        "lang": local_frame(spark, [("en", 0.6), ("de", 0.4)], "lang string, share double"),
        "topic": local_frame(spark, [(0, 0.8), (1, 0.2)], "topic int, share double"),
    }
    keep = 0.2
    got = bounded_cells(spark, cells, targets, keep).toPandas()
    got["weight"] = got.tokens * got.probability
    total = keep * sum(c[3] for c in CELLS)
    assert got.groupby("source").weight.sum()["a"] == pytest.approx(0.75 * total, rel=1e-3)
    assert got.groupby("lang").weight.sum()["de"] == pytest.approx(0.4 * total, rel=1e-3)
    assert got.groupby("topic").weight.sum()[1] == pytest.approx(0.2 * total, rel=1e-3)


@pytest.mark.parametrize("keep", [0.1, 0.5, 0.9, 1.0])
def test_calibration_meets_the_budget(spark, keep):
    weighted = local_frame(
        spark,
        [("a", "en", 0, 800, 300.0), ("b", "en", 0, 100, 400.0), ("c", "en", 0, 100, 300.0)],
        DDL + ", weight double",
    )
    got = calibrated_cells(spark, weighted, keep).toPandas()
    assert (got.probability * got.tokens).sum() == pytest.approx(keep * 1000)
    assert got.probability.max() <= 1


def test_documents_with_nulls(spark, documents):
    rows = [(1, None), (2, ""), (None, "some words here"), (3, "wordwordword and more"), (3, "wordwordword and more")]
    got = mixture(spark, documents(rows, lang=None)).collect()
    assert len(got) == 5
    by_text = {r["doc_id"]: r for r in got}
    assert by_text[1]["source"] == "(none)" and by_text[1]["tokens"] == 0 and by_text[1]["topic"] == 0
    assert len({r["sampled"] for r in got if r["doc_id"] == 3}) == 1
    assert mixture(spark, documents([])).collect() == []


def test_sample_follows_the_probabilities(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("alphabet word "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 30)).alias("source"),
        F.lit("en").alias("lang"),
        F.lit("extra").alias("weight"),
    )
    whole = mixture(spark, docs).toPandas()
    kept = sample_mixture(spark, docs)
    assert kept.columns == docs.columns
    assert kept.count() == whole.sampled.sum()
    hot = whole[whole.source == "hot"]
    assert hot.probability.iloc[0] < 1 and whole[whole.source != "hot"].probability.min() == 1
    assert hot.sampled.mean() == pytest.approx(hot.probability.iloc[0], abs=0.03)


def shares_of(cells, name):
    got = cells.toPandas()
    given = (got.tokens * got.probability).groupby(got[name]).sum()
    return given / given.sum()


def test_bounded_raking_meets_targets_that_fill_cells(spark):
    cells = local_frame(
        spark, [("a", "en", 0, 800), ("a", "de", 0, 100), ("b", "en", 0, 80), ("b", "de", 0, 20), ("c", "en", 0, 50)], DDL
    )
    targets = {
        "source": local_frame(spark, [("a", 0.82), ("b", 0.18)], "source string, share double"),
        "lang": local_frame(spark, [("en", 0.78), ("de", 0.22)], "lang string, share double"),
    }
    keep = 500 / 1050
    got = bounded_cells(spark, cells, targets, keep)
    for name, value, share in [("source", "b", 0.18), ("source", "c", 0), ("lang", "de", 0.22)]:
        assert shares_of(got, name)[value] == pytest.approx(share, abs=1e-3)
    frame = got.toPandas()
    assert frame.probability.max() <= 1
    assert (frame.probability * frame.tokens).sum() == pytest.approx(500, rel=1e-3)
    told = {(r["dimension"], r["value"]): r for r in reached_shares(got).collect()}
    assert told["source", "b"]["target"] == pytest.approx(0.18)
    assert told["source", "b"]["reached"] == pytest.approx(0.18, abs=1e-3)
    assert told["lang", "de"]["largest_keep"] == pytest.approx(120 / 0.22 / 1050)


def test_targets_beyond_the_tokens_are_told(spark):
    rows = [("hot", "en", 0, 2000), *[(f"s{i}", "en", 0, 100) for i in range(10)]]
    got = bounded_cells(spark, local_frame(spark, rows, DDL), keep=0.8)
    told = {r["value"]: r for r in reached_shares(got).collect() if r["dimension"] == "source"}
    assert told["hot"]["target"] == pytest.approx(0.309, abs=1e-3)
    assert told["hot"]["reached"] == pytest.approx(1400 / 2400)  # all others are kept whole
    assert told["s1"]["largest_keep"] == pytest.approx(0.482, abs=1e-3)
    at_most = bounded_cells(spark, local_frame(spark, rows, DDL), keep=told["s1"]["largest_keep"])
    assert shares_of(at_most, "source")["hot"] == pytest.approx(told["hot"]["target"])


def test_raking_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("pricelens.llm.mixing.MOST_ROUNDS", 1)
    monkeypatch.setattr("pricelens.llm.mixing.SETTLED", 0.0)
    with pytest.raises(RuntimeError, match="not settled"):
        bounded_cells(spark, local_frame(spark, CELLS, DDL))
