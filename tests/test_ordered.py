"""Distributed ranks, quantiles, lags and running sums against pandas and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.operators import ordered, shapes

CHUNKS = [1, 5]


@pytest.fixture(scope="module")
def sample() -> pd.DataFrame:
    """2000 keys: one metric with a third of its values equal, one with NULLs, one constant."""
    draw = np.random.default_rng(5)
    hot = np.where(draw.random(2000) < 0.34, 0.0, draw.random(2000).round(2))
    gaps = pd.Series(draw.normal(size=2000))
    gaps[draw.random(2000) < 0.2] = None
    return pd.DataFrame({"k": range(2000), "hot": hot, "gaps": gaps, "flat": 1.5})


@pytest.fixture(scope="module")
def frame(spark, sample):
    rows = [
        (int(r.k), float(r.hot), None if pd.isna(r.gaps) else float(r.gaps), r.flat)
        for r in sample.itertuples()
    ]
    return spark.createDataFrame(rows, "k bigint, hot double, gaps double, flat double").cache()


@pytest.mark.parametrize("chunks", CHUNKS)
def test_percentile_ranks(area, frame, sample, chunks):
    metrics = ["hot", "gaps", "flat"]
    got = (
        ordered.percentile_ranks(area, frame, ["k"], metrics, chunks)
        .toPandas()
        .set_index("k")
        .sort_index()
    )
    assert len(got) == len(sample)
    for metric in metrics:
        want = sample[metric].rank(method="average", pct=True)
        np.testing.assert_allclose(
            got[f"{metric}_rank"].astype(float), want, rtol=0, atol=1e-12, equal_nan=True
        )
        assert set(got[f"{metric}_distinct"]) == {sample[metric].nunique()}


@pytest.mark.parametrize("chunks", CHUNKS)
def test_exact_quantiles(area, frame, sample, chunks):
    points = {"p05": 0.05, "median": 0.5, "p90": 0.9, "top": 1.0}
    for metric in ("hot", "gaps", "flat"):
        row = ordered.exact_quantiles(area, frame, [], metric, points, chunks).first()
        for name, p in points.items():
            assert row[name] == pytest.approx(sample[metric].quantile(p), abs=1e-12)


def test_grouped_quantiles(area, frame, sample):
    grouped = frame.withColumn("g", F.col("k") % 3)
    got = ordered.exact_quantiles(area, grouped, ["g"], "gaps", {"m": 0.5}, 4).collect()
    want = sample.groupby(sample.k % 3).gaps.median()
    assert {r.g: pytest.approx(r.m) for r in got} == want.to_dict()


@pytest.mark.parametrize("chunks", CHUNKS)
def test_running_before(area, frame, sample, chunks):
    staged = area.put_in_order("running", frame, "hot", "k", chunks=chunks)
    got = (
        ordered.running_before(staged, [], ["hot", "k"], place=F.lit(1), total=F.col("hot"))
        .orderBy("hot", "k")
        .toPandas()
    )
    want = sample.sort_values(["hot", "k"])
    assert got.place.tolist() == list(range(len(sample)))
    np.testing.assert_allclose(got.total, want.hot.cumsum() - want.hot, atol=1e-9)


@pytest.mark.parametrize("chunks", CHUNKS)
def test_previous_value_of_a_hot_group(spark, area, chunks):
    """One customer holds a third of the rows, all of them on three days."""
    draw = np.random.default_rng(9)
    rows = []
    for i in range(900):
        customer = "hot" if i % 3 == 0 else f"c{draw.integers(60)}"
        rows.append((customer, int(draw.integers(3)), i, int(draw.integers(2))))
    data = pd.DataFrame(rows, columns=["c", "d", "o", "flag"]).sort_values(["c", "d", "o"])
    table = spark.createDataFrame(rows, "c string, d int, o int, flag int")
    staged = area.put_in_order("hot", table, "c", "d", "o", chunks=chunks)
    if chunks > 1:
        assert staged.where("c = 'hot'").select("chunk").distinct().count() > 1
    got = ordered.previous_value(staged, ["c"], ["d", "o"], "flag", 0)
    got = got.orderBy("c", "d", "o").toPandas()
    want = data.groupby("c").flag.shift(1).fillna(0).astype(int)
    assert got.previous_flag.tolist() == want.tolist()


def test_histogram_matches_numpy(frame, sample):
    got = shapes.histogram(frame, F.col("hot"), 25).orderBy("bin").collect()
    counts, edges = np.histogram(sample.hot, bins=25)
    assert [r.rows for r in got] == counts.tolist()
    np.testing.assert_allclose([r.lower for r in got], edges[:-1], atol=1e-12)


def test_histogram_of_a_constant(frame):
    got = shapes.histogram(frame, F.col("flat"), 4).orderBy("bin").collect()
    assert [r.rows for r in got] == [2000, 0, 0, 0]


def test_density_counts_every_point(frame, sample):
    got = shapes.density(frame, F.col("hot"), F.col("gaps"), 6)
    known = sample.dropna()
    counts, _, _ = np.histogram2d(known.hot, known.gaps, bins=6)
    assert {(r.x_bin, r.y_bin): r.rows for r in got.collect()} == {
        (x, y): int(counts[x, y]) for x in range(6) for y in range(6) if counts[x, y]
    }


@pytest.mark.parametrize("size", [6, 7])
def test_collapse_tail(spark, size):
    table = spark.createDataFrame([(f"a{i}", float(10 - i)) for i in range(size)], "l string, v double")
    got = {r.l: r.v for r in shapes.collapse_tail(table, "l", "v").collect()}
    if size == 6:
        assert len(got) == 6
    else:
        assert got == {"a0": 10, "a1": 9, "a2": 8, "a3": 7, "a4": 6, "Other actions": 9}


def test_top_per_group(spark):
    table = spark.createDataFrame([("g", i) for i in range(9)] + [("h", 1)], "g string, v int")
    got = shapes.top_per_group(table, ["g"], [F.col("v").desc()], 5).collect()
    assert sorted((r.g, r.v) for r in got) == [("g", i) for i in range(4, 9)] + [("h", 1)]


def test_round_columns_ignores_absent(spark):
    table = spark.createDataFrame([(1.005, 2.345)], "a double, b double")
    row = shapes.round_columns(table, {"a": 1, "z": 2}).first()
    assert (row.a, row.b) == (1.0, 2.345)


@pytest.mark.parametrize("entries,bracket", [(4096, 0.003), (8, 0.0), (8, 0.05)])
def test_selected_quantiles(spark, area, monkeypatch, entries, bracket):
    """Also with a coarse sketch whose brackets miss, so that whole groups are ordered."""
    monkeypatch.setattr(ordered, "SKETCH_ENTRIES", entries)
    monkeypatch.setattr(ordered, "BRACKET", bracket)
    rng = np.random.default_rng(3)
    values = {
        "smooth": rng.normal(size=5000),
        "hot": np.where(rng.random(4000) < 0.7, 0.0, rng.random(4000)),
        "ties": rng.integers(0, 6, 3000).astype(float),
        "pair": np.array([1.0, 2.0]),
        "one": np.array([5.0]),
    }
    frame = pd.DataFrame({"g": np.repeat(list(values), [len(v) for v in values.values()]),
                          "v": np.concatenate(list(values.values()))})
    frame = spark.createDataFrame(frame).union(spark.sql("SELECT 'none', CAST(NULL AS DOUBLE)"))
    points = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r["g"]: r for r in ordered.selected_quantiles(area, frame, ["g"], "v", points).collect()}
    assert set(got) == set(values)
    for g, v in values.items():
        want = np.quantile(v, list(points.values()))
        assert [got[g][n] for n in points] == pytest.approx(want, abs=1e-12)
    whole = ordered.selected_quantiles(area, frame.where("g = 'smooth'"), [], "v", points).first()
    assert [whole[n] for n in points] == pytest.approx(np.quantile(values["smooth"], list(points.values())))


def test_selection_orders_only_what_is_near(spark, area):
    frame = spark.range(200_000).select(F.col("id").cast("double").alias("v"))
    staged = []

    class Watched:
        def put(self, name, table, near=None):
            found = area.put(name, table, near)
            staged.append((name, found.count()))
            return found

        def put_in_order(self, name, table, *order, chunks=None):
            found = area.put_in_order(name, table, *order, chunks=chunks)
            staged.append((name, found.count()))
            return found

    row = ordered.selected_quantiles(Watched(), frame, [], "v", {"mid": 0.5}).first()
    assert row["mid"] == 99_999.5
    assert max(n for _, n in staged) < 4_000


def test_selected_quantiles_of_nothing(spark, area):
    empty = spark.range(0).select(F.col("id").cast("double").alias("v"))
    assert ordered.selected_quantiles(area, empty, [], "v", {"mid": 0.5}).collect() == [(None,)]
