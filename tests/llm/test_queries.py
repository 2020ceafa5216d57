"""Registered queries against their SQL, and against plain Python where SQL cannot say it."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from pricelens.llm.queries import ORACLES, QUERIES
from pricelens.llm.tables import table
from tools.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.fixture(scope="module")
def texts(spark) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in table(spark, FOLDER, "documents").collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_its_oracle(spark, connection, name):
    assert difference(spark, connection, name, FOLDER) == ""


def test_repeated_spans_by_brute_force(spark, texts):
    count: dict[bytes, int] = defaultdict(int)
    data = {i: t.encode() for i, t in texts.items()}
    for d in data.values():
        for s in range(len(d) - 399):
            count[hashlib.md5(d[s : s + 400]).digest()] += 1
    rows = QUERIES["op2_repeated_spans"](spark, FOLDER).collect()
    assert len(rows) == len(data)
    removed = 0
    for r in rows:
        d = data[r["doc_id"]]
        gone = np.zeros(len(d), dtype=bool)
        for s in range(len(d) - 399):
            if count[hashlib.md5(d[s : s + 400]).digest()] > 1:
                gone[s : s + 400] = True
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone])
        runs = int((gone & ~np.append(False, gone[:-1])).sum())
        want = (len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
        removed += r["n_removed"]
    assert removed > 0


def test_packing_by_the_other_tokenizer(spark, texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in QUERIES["op9_packing"](spark, FOLDER).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]].tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] <= 2048 and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids)


def test_scores_cover_every_document(spark, texts):
    for name in ("op7_toxicity", "op8_quality"):
        rows = QUERIES[name](spark, FOLDER).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_entry_knows_all_queries():
    assert set(QUERIES) < set(contract.queries()) and set(ORACLES) < set(contract.oracle_sql())
