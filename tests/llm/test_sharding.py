from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from pricelens.llm.sharding import contiguous_shards, write_shards


def plain(rows: list[tuple], shards: int, extra: int = 16) -> set[tuple]:
    """(id, size, crc, shard, slot) by one running sum."""
    data = [((t or "").encode(), i) for i, t in rows]
    data.sort(key=lambda r: (hashlib.md5(r[0]).digest(), r[1] is not None, r[1] or 0))
    total = sum(len(d) + extra for d, _ in data)
    before, slots, out = 0, [0] * shards, set()
    for d, i in data:
        size = len(d) + extra
        shard = min((2 * before + size) * shards // max(2 * total, 1), shards - 1)
        out.add((i, size, zlib.crc32(d), shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def result(frame) -> set[tuple]:
    rows = [(r["id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mixed(n: int) -> list[tuple]:
    rng = random.Random(n)
    hot = "copy " * 20
    rows: list[tuple] = [(i, hot if i % 3 == 0 else "é" * rng.randrange(200)) for i in range(n)]
    return [*rows, (None, "no name"), (n + 1, None), (n + 2, "")]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_same_as_one_running_sum(spark, documents, shards):
    rows = mixed(500)
    got = result(contiguous_shards(spark, documents(rows).repartition(9), shards))
    assert got == plain(rows, shards)
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_a_group_of_copies_is_cut_only_by_targets(spark, documents):
    rows = mixed(600)
    text = {i: t for i, t in rows}
    got = result(contiguous_shards(spark, documents(rows), 10))
    hot = {r[3] for r in got if r[0] is not None and text[r[0]] == "copy " * 20}
    assert hot == set(range(min(hot), max(hot) + 1)) and len(hot) > 2


def test_many_chunks_give_the_same_shards(spark, documents):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = mixed(300)
        assert result(contiguous_shards(spark, documents(rows), 11)) == plain(rows, 11)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_a_very_long_text_takes_whole_targets(spark, documents):
    rows = [(1, "x" * 3_000_000), *[(i, f"t{i}") for i in range(2, 30)]]
    got = result(contiguous_shards(spark, documents(rows), 5))
    assert got == plain(rows, 5)


def test_repeated_rows_each_have_a_slot(spark, documents):
    rows = [(1, "same")] * 30
    frame = contiguous_shards(spark, documents(rows), 3)
    assert sorted((r["shard"], r["slot"]) for r in frame.collect()) == [(s, k) for s in range(3) for k in range(10)]


def test_empty_table_and_sizes_of_nothing(spark, documents):
    assert contiguous_shards(spark, documents([])).collect() == []
    got = contiguous_shards(spark, documents([(1, None), (2, "")]), 4, row_bytes=0)
    assert [r["size"] for r in got.collect()] == [0, 0]
    with pytest.raises(ValueError):
        contiguous_shards(spark, documents([]), 0)


def test_files_hold_every_row_in_slot_order(spark, documents, tmp_path):
    rows = mixed(200)
    docs = documents(rows).withColumn("shard", documents([(0, "")]).select("key").limit(1).scalar())
    path = str(tmp_path / "out")
    summary = {r["shard"]: (r["rows"], r["bytes"]) for r in write_shards(spark, docs, path, 6).collect()}
    read = spark.read.parquet(path)
    got = {(r["document"]["doc_id"], r["size"], r["shard"], r["slot"]) for r in read.collect()}
    want = {(i, size, shard, slot) for i, size, _, shard, slot in plain(rows, 6)}
    assert got == want and sum(n for n, _ in summary.values()) == len(rows)
    assert all(summary[s][1] == sum(r[1] for r in want if r[2] == s) for s in summary)
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).select("slot").collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))
