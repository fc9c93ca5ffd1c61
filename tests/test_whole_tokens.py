"""All tokens of a document, beside the first ones that h1_raw_tokens shows."""

from pyspark.sql import functions as F

from entigraph.plans import catalog

SF = "/root/testdata/sf0.001"


def test_all_tokens_reach_behind_the_twentieth(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = catalog.QUERIES["h1_all_tokens"](spark, SF)
    counts = {r.doc_id: r.n for r in catalog.QUERIES["h1_raw_tokens"](spark, SF).collect()}
    got = {r.doc_id: (r.n, r.last) for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()}
    assert got == {d: (k, k - 1) for d, k in counts.items() if k} and len(counts) == n and max(counts.values()) > 20
