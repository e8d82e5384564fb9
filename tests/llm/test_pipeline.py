from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from attempt_grid.llm.queries import ORACLE, QUERIES
from attempt_grid.llm.substring_dedup import remove_repeated_passages
from tests.llm.test_license_scan import NOTICES
from tests.llm.test_vectors import ODD, clustered
from tests.llm.test_vectors import SCHEMA as VECTORS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def check_sql(spark, name, folder):
    import duckdb

    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    cursor = connection.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    frame = QUERIES[name](spark, str(folder))
    found, expected = list(map(tuple, frame.collect())), cursor.fetchall()
    assert frame.columns == names and sorted(found, key=repr) == sorted(expected, key=repr)
    return found


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert check_sql(spark, name, SF)


def test_sql_on_odd_tables(spark, broken, rows, tmp_path):
    more = [(2000 + i, text, None, None, 0) for i, (text, _, _) in NOTICES.items()]
    broken.unionAll(spark.createDataFrame([*rows, *more], broken.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = spark.createDataFrame([*clustered(), *ODD], VECTORS)
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert any(r[6] for r in check_sql(spark, "op4_license_scan", tmp_path))
    check_sql(spark, "op5_embedding_near_dedup", tmp_path)
    check_sql(spark, "op10_vantage_point_neighbours", tmp_path)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(t.columns == docs.columns for t in tables[:-1])
    texts = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]
    assert set(texts[4]) == set(texts[3]) == set(texts[2]) <= set(texts[1]) <= set(texts[0])
    removed = {r.doc_id: r.n_removed for r in remove_repeated_passages(tables[2]).collect()}
    for i, text in texts[3].items():
        assert (text == texts[2][i]) == (removed[i] == 0)
        assert len(text.split()) <= len(texts[2][i].split())
    pieces = tables[-1].collect()
    assert {p.doc_id for p in pieces} == set(texts[4])
    assert sum(p.length for p in pieces if p.start == 0) <= sum(p.length for p in pieces)


def test_one_of_each_group_stays(spark, broken, texts):
    kept = corpus_pipeline.near_duplicates(spark, broken, SF).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and ids.count(0) == 1
    assert sum(r.doc_id is None for r in kept) == 2
    blank = {i for i in range(12) if not (texts[i] or "").split()}
    assert len(blank & set(ids)) == 1


def test_stages_on_odd_documents(spark, broken, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, broken, SF).count() >= 1
        assert stage(spark, no_docs, SF).count() == 0
