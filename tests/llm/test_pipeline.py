from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from pricelens.llm import exact, mixing, near, packing, quality
from pricelens.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
DOCUMENT = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
)
LABEL = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, written and read again as the next stage's documents."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs)
    return found


def ids(frame) -> Counter:
    return Counter(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns(spark, kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing",
    ]
    columns = table(spark, FOLDER, "documents").columns
    assert all(frame.columns == columns for frame in kept[:-1])


def test_each_stage_does_what_its_operator_decides(spark, kept):
    docs = table(spark, FOLDER, "documents")
    model = quality.fit_quality(docs, table(spark, FOLDER, "labels"))
    good = quality.score_quality(docs, model).where("predicted = 1")
    assert ids(kept[0]) == ids(good) and 0 < sum(ids(good).values()) < docs.count()
    # Plain Python: of equal texts the largest id.
    best: dict[str, int] = {}
    for r in kept[0].collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert ids(kept[1]) == Counter(best.values())
    assert ids(kept[1]) == ids(
        exact.exact_groups(spark, kept[0], keep="largest").where("kept").withColumnRenamed("id", "doc_id")
    )
    assert ids(kept[2]) == ids(near.near_duplicates(spark, kept[1]).where("kept"))
    assert ids(kept[3]) == ids(mixing.mixture(spark, kept[2]).where("sampled"))
    assert set(ids(kept[4])) == set(ids(kept[3]))


def test_run_chains_the_stages(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.columns == kept[4].columns
    assert Counter(map(tuple, got.select(names).collect())) == Counter(
        map(tuple, kept[4].select(names).collect())
    )
    tokens = sum(r["length"] for r in got.collect())
    sequences = got.select("sequence_id").distinct().count()
    assert -(-tokens // packing.SEQUENCE) <= sequences <= -(-tokens // packing.SEQUENCE) + 2


def write(folder, documents, labels):
    pq.write_table(pa.Table.from_pylist(documents, DOCUMENT), f"{folder}/documents.parquet")
    pq.write_table(pa.Table.from_pylist(labels, LABEL), f"{folder}/labels.parquet")


def test_empty_tables_pass_through(spark, tmp_path):
    write(tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_and_repeated_rows(spark, tmp_path):
    row = {"doc_id": 1, "text": "a few words that make a text", "lang": "en", "source": "s", "n_chars": 5}
    documents = [row, row, {**row, "doc_id": None}, dict.fromkeys(DOCUMENT.names), {**row, "doc_id": 3, "text": ""}]
    write(tmp_path, documents, [])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels nothing is rejected; one text, and one row of the empty texts, are left
    # to the sample, which decides by the document alone.
    assert len(got) <= 2 and {r["doc_id"] for r in got} <= {1, 3}


def test_registered():
    names = list(contract.queries())
    for n in range(1, 11):
        assert len([name for name in names if name.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in contract.oracle_sql()
