from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

from pricelens.llm.ship import send_package
from tests.conftest import local_frame


@pytest.fixture(scope="session", autouse=True)
def package_sent(spark: SparkSession) -> None:
    send_package(spark)


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) rows, with a column whose name clashes."""

    def make(rows: list[tuple], lang: str | None = "en") -> DataFrame:
        full = [(i, t, lang, None if t is None else "src0", 0, "x") for i, t in rows]
        ddl = "doc_id long, text string, lang string, source string, n_chars long, key string"
        return local_frame(spark, full, ddl)

    return make
