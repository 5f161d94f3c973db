"""The stages against what each should do to its own input, and SQL oracles of the operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import decontaminate, queries, simhash, toxicity


def test_stages_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        held[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "sharding":
            assert docs.columns == columns
    out = {name: spark.read.parquet(str(tmp_path / name)) for name, _ in corpus_pipeline.STAGES}
    score = toxicity.scored(held["toxicity"], spark.read.parquet(f"{sf}/labels.parquet"))
    assert out["toxicity"].count() == score.where("predicted = 0").count()
    groups = simhash.similar_documents(held["simhash_near_dedup"])
    assert sorted(out["simhash_near_dedup"].select("doc_id").collect()) == sorted(groups.select("component_id").distinct().collect())
    leaks = decontaminate.contaminated_pairs(held["decontamination"], spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct()
    assert leaks.count() + out["decontamination"].count() == held["decontamination"].count()
    assert out["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert out["sharding"].count() == out["mixing"].count()


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_oracle(name, spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = queries.QUERIES[name](spark, path)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=key) == sorted(([r[names.index(c)] for c in columns] for r in cursor.fetchall()), key=key)
