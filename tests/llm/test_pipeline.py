import os

import pytest

import __spark_entry__
import corpus_pipeline

TABLES = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@needs_tables
def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_tables
def test_stages_keep_columns_and_take_effect(spark):
    docs = first = spark.read.parquet(f"{TABLES}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, TABLES))
        assert docs.columns == first.columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] and sizes[4] != sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert {r["doc_id"] for r in last.collect()} <= {r["doc_id"] for r in docs.collect()}


def test_stages_of_awkward_and_no_rows(spark, docs, no_docs, tmp_path, labels):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, rows, str(tmp_path))
            assert found.columns == rows.columns
            assert found.count() >= 0
        corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count()


@needs_tables
@pytest.mark.parametrize("name", ["op5_fingerprints", "op6_mixing", "op7_near_duplicates"])
def test_query_equals_sql(spark, name):
    from parity.compare import connect

    from stationflow.llm.queries import ORACLES, QUERIES

    found = connect(TABLES).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    ours = QUERIES[name](spark, TABLES)
    assert sorted(ours.columns) == sorted(columns)

    def cells(rows):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows)

    assert cells(ours.select(columns).collect()) == cells(found.fetchall())
