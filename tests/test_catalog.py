"""Every query against its SQL, and the relational operators on small tables."""

import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compliq import audit, catalog
from compliq.operators import instructions
from compliq.sources import documents
from compliq.streaming import audits
from tests.helpers import spec

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    def value(x):
        if pd.isna(x):
            return None
        return round(float(x), 6) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql(spark, sf):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        assert catalog.QUERIES[name](spark, sf).count() > 0


def test_compiled_audits_need_neither_python_nor_a_shuffle(spark, sf, monkeypatch):
    monkeypatch.setattr(documents, "spread", lambda df: df)
    plan = catalog.q_audit(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_small_tables_are_spread_and_large_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert "Exchange" in documents.spread(docs, per_task=1000)._jdf.queryExecution().executedPlan().toString()
    assert documents.spread(docs, per_core=10) is docs


def test_sections_that_nest(spark):
    text = "# A\n\na\n\n## B\n\nb\n\n### C\n\nc\n\n# D\n\nd\n"
    docs = documents.from_text(spark.createDataFrame([(1, text)], "doc_id long, text string"), "md")
    blocks = [b for r in docs.collect() for b in r.blocks]
    assert [(b.position, b.until) for b in blocks if b.kind == "heading"] == [(1, 7), (3, 7), (5, 7), (7, documents.NO_END)]
    assert [b.section for b in blocks] == ["A", "A", "B", "B", "C", "C", "D", "D"]
    rule = spec(("word_count", {"exact": 4, "exclude_sections": ["B"]}))
    assert [(r.status, r.n) for r in audit.audit(docs, rule).collect()] == [("PASS", 4)]


def test_markers(spark):
    files = spark.createDataFrame([("a", "x\nTODO y\r\n@mark.skip\nno"), ("b", "")], "path string, text string")
    assert {r.path: (r.n, list(r.evidence)) for r in instructions.markers(files).collect()} == {"a": (2, ["line 2: TODO y", "line 3: @mark.skip"]), "b": (0, [])}


def test_a_stream_of_documents(spark, sf, tmp_path):
    docs = catalog.read(spark, sf, "documents").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = audits.audit_stream(audits.read_documents(spark, str(tmp_path / "in"), per_batch=1), spec(("word_count", {"min": 100}), ("forbidden_text", {"value": "idiot"})))
    q = audits.sink(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 * docs.count()
    rolled = audits.compliance_by_window(out.select(F.timestamp_seconds(F.col("doc_id").cast("long") * 60).alias("ts"), "status"))
    assert rolled.agg(F.sum("decided")).first()[0] == out.count()
