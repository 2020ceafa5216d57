"""Bundles that appear as a whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelens.sources import generations as G


def tables(spark, n):
    return {
        "a": spark.range(n),
        "b": spark.range(n).withColumn("x", F.lit("é, \"q\"")),
        "c": spark.range(2 * n),
    }


def test_newest_generation_is_read_as_a_whole(spark, tmp_path):
    folder = str(tmp_path)
    assert G.current(spark, folder) is None
    with pytest.raises(FileNotFoundError, match="no finished bundle"):
        G.read_published(spark, folder)
    first = G.publish_bundle(tables(spark, 3), folder, ["csv", "parquet"])
    assert (first.version, first.rows) == (1, {"a": 3, "b": 3, "c": 6})
    second = G.publish_bundle(tables(spark, 5), folder)
    assert second.version == 2 and G.current(spark, folder) == second
    got = G.read_published(spark, folder)
    assert {n: t.count() for n, t in got.items()} == {"a": 5, "b": 5, "c": 10}
    with pytest.raises(FileNotFoundError, match="version 2"):
        G.read_published(spark, folder, kind="csv")
    with pytest.raises(FileNotFoundError, match="version 2"):
        G.read_published(spark, folder, ["z"])


def test_failure_in_the_third_table_leaves_the_old_bundle(spark, tmp_path):
    folder = str(tmp_path)
    kept = G.publish_bundle(tables(spark, 3), folder, ["parquet", "csv"])
    broken = tables(spark, 9)
    broken["c"] = broken["c"].withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        G.publish_bundle(broken, folder, ["parquet", "csv"])
    assert G.current(spark, folder) == kept
    for kind in ("parquet", "csv"):
        got = G.read_published(spark, folder, kind=kind)
        assert {n: t.count() for n, t in got.items()} == {"a": 3, "b": 3, "c": 6}
    removed = G.prune(spark, folder, keep=1)
    assert len(removed) == 1 and kept.generation not in removed
    assert G.read_published(spark, folder)["c"].count() == 6


def test_table_that_lost_rows_is_not_published(spark, tmp_path, monkeypatch):
    folder, save = str(tmp_path), G.save

    def losing(table, place, name, kind):
        save(table if kind == "parquet" else table.limit(1), place, name, kind)

    monkeypatch.setattr(G, "save", losing)
    with pytest.raises(G.IncompleteBundle, match="a.csv has 1 rows of 3"):
        G.publish_bundle(tables(spark, 3), folder, ["csv", "parquet"])
    assert G.current(spark, folder) is None


def test_empty_tables_and_prune(spark, tmp_path):
    folder = str(tmp_path)
    for n in (0, 1, 2):
        G.publish_bundle({"a": spark.range(n)}, folder)
    assert len(G.prune(spark, folder, keep=2)) == 1
    assert G.read_published(spark, folder)["a"].count() == 2
    with pytest.raises(ValueError):
        G.prune(spark, folder, keep=0)
    with pytest.raises(ValueError):
        G.publish_bundle({}, folder)
