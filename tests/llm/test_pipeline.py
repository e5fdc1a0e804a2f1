"""The pipeline's stages over small tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from keystrata.llm import registry

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, piece string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    passage, rows, labels = words(90, 1), [], []
    for i in range(160):
        text = words(70, 100 + i)
        if i % 5 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i in (11, 12):
            text = text[:100] + " " + passage + " " + text[100:]
        if i == 31:
            text = rows[30][1]
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text), "p"))
        labels.append((i, int(i % 5 > 0)))
    rows += [(None, None, None, None, None, None), (900, "", "en", "s1", 0, "p"), rows[7]]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        results.append(docs)
    for r in results[:-1]:
        assert r.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
    kept = {r.doc_id for r in results[0].collect()}
    assert not {i for i in range(0, 160, 5)} & kept and len(kept) > 110
    one = [r.doc_id for r in results[1].collect()]
    assert 31 not in one and one.count(7) == 1
    cut = {r.doc_id: r for r in results[2].collect()}
    assert words(90, 1)[50:-50] not in cut[11].text + cut[12].text and cut[11].n_chars == len(cut[11].text)
    assert sorted(cut, key=str) == sorted(one, key=str)
    sizes = sum(len(r.text.split()) for r in results[2].collect())
    mixed = sum(len(r.text.split()) for r in results[3].collect())
    assert abs(mixed - 1.5 * sizes) < 0.1 * sizes
    assert results[4].where("sequence_id is null").count() == 0 and results[4].groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_columns_of_any_name_pass_through(spark, folder):
    names = "score predicted held_out size source_size target taken epochs picked kept spans n_bytes node a b fp _a _text prints finer_spans piece length".split()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "n_chars", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    rows = docs.collect()
    assert len(rows) > 100 and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names if r.doc_id is not None)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    import tempfile

    where = tempfile.mkdtemp()
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        assert docs.count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_registry_names():
    names = [n for n in registry.queries()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
