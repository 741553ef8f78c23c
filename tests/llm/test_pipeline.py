"""The registered queries against their SQL, and the pipeline's stages against plain versions."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402
import oracle  # noqa: E402
from conftest import SMALL  # noqa: E402
from saleswright.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    assert oracle.difference(registry.QUERIES[name](spark, SMALL), oracle.connect(SMALL), registry.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op13_truncation_peeling"}))  # its nodes are counted by its SQL
def test_a_row_for_each_input_or_answer(spark, name):
    number = int(name[2:].split("_")[0])
    read = lambda table: spark.read.parquet(f"{SMALL}/{table}.parquet")
    if number == 11:
        wanted = read("conversations").select("conv_id").distinct().count()
    else:
        rows = read("embeddings" if number in (1, 6, 12) else "documents").count()
        wanted = {6: 5 * -(-rows // 50), 12: 20 * -(-rows // 20)}.get(number, rows)
    assert registry.QUERIES[name](spark, SMALL).count() == wanted


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.DOCUMENTS).withColumns({c: F.lit(c) for c in ("size", "score", "_runs", "copies", "ids")})


def test_stages(spark, docs):
    table, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, table, SMALL)
        if name != "bpe_encode":
            assert found.columns == docs.columns
        table = found.cache()
        sizes[name] = table.count()
    wordless = sum(not any(c.isalpha() for c in r[1] or "") for r in cases.documents())
    assert sizes["language_id"] == len(cases.documents()) - wordless - 1 == sizes["line_dedup"]  # number 15 mixes scripts: far from all
    assert sizes["simhash_dedup"] < sizes["line_dedup"] and sizes["source_mix"] == sizes["bpe_encode"] > 0


def test_stages_of_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) > 0.8 * len(texts) and all(r["doc_id"] in texts for r in rows)
    taken = [r["doc_id"] for r in rows]
    assert max(map(taken.count, set(taken))) <= 2
