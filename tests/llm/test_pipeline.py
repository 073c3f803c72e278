"""The pipeline and the registered queries."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from motorlytics.llm import queries
from motorlytics.llm.common import stored

SF_SMALL = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, ids string, packed string, `score` double"


@pytest.fixture(scope="module")
def odd_documents(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i, text(30 + i), "en", "s", None, "a", "b", 0.5) for i in range(12)]
    rows += [(20, rows[0][1], "en", "s", 5, "a", "b", 0.5), (21, None, None, None, None, None, None, None), (22, "", "en", "s", 0, "a", "b", 0.5),
             (None, text(50), "en", "s", 1, "a", "b", 0.5), (23, text(9000), "en", "s", 1, "a", "b", 0.5)]
    return spark.createDataFrame(rows, KIND)


def test_stages_on_odd_documents(spark, odd_documents):
    docs = odd_documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stored(stage(spark, docs, SF_SMALL), "pipeline-test")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert done.columns == odd_documents.columns, name
            assert done.schema == docs.schema or {f.name: f.dataType for f in done.schema} == {f.name: f.dataType for f in docs.schema}
        if name == "ngram_jaccard_join":
            left = {r.doc_id for r in done.collect()}
            assert 20 not in left and left >= {i for i in range(12)} & {r.doc_id for r in docs.collect()}
        docs = done
    assert {"token_ids", "n_tokens"} <= set(docs.columns)


def test_stages_on_no_documents(spark, odd_documents):
    docs = odd_documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "pipeline-test")
        assert docs.count() == 0


def test_run_drops_leaks_and_copies(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    leaked = {r.doc_id for r in docs.join(F.broadcast(items.select(F.col("text").alias("item"))), F.col("text").contains(F.col("item"))).select("doc_id").collect()}
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count() and not leaked & set(ids)


def test_registered_queries(spark):
    found = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in found and set(queries.ORACLE) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle_twins(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_token_columns_replace_columns_of_their_name(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x", 7), (2, None, None, None)], "doc_id long, text string, Token_Ids string, n_tokens int")
    done = corpus_pipeline.bpe_encoding(spark, docs, "")
    done.write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    assert done.columns == ["doc_id", "text", "token_ids", "n_tokens"]
    assert [(r.doc_id, r.text, r.n_tokens, len(r.token_ids)) for r in got] == [(1, "a b", got[0].n_tokens, 4 * got[0].n_tokens), (2, "", 0, 0)]
    assert got[0].n_tokens > 0
