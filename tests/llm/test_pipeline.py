"""The registered queries over the driver tables, and the pipeline's stages."""

import importlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from parley import llm
from tools.check import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(llm.load()[0]))
def test_query(spark, name):
    df = llm.load()[0][name](spark, FOLDER)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in df.select(cols).collect()), key=repr)
    assert ours
    if name in llm.load()[1]:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        found = db.execute(llm.load()[1][name])
        names = [d[0] for d in found.description]
        at = [names.index(c) for c in cols]
        assert ours == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_stages_keep_the_columns(spark, docs):
    given = docs.select("doc_id", "text", "lang", "source", "score")
    at = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, FOLDER)
        assert out.columns == given.columns, name
        at = spark.createDataFrame(out.collect(), given.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER).collect()
    assert last and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)
    texts = [r["text"] for r in at.collect()]
    assert texts.count(None) == 0


def test_run(spark):
    assert importlib.import_module("corpus_pipeline").run(spark, FOLDER).count() > 0
