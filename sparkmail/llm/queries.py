"""The ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.llm import oracles

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def digest(found: DataFrame, spans: str, kinds: list[str]) -> DataFrame:
    """Spans as counts of the base kinds, a digest of the base spans and a text of all spans."""
    from sparkmail.llm.spans import shown

    def of(*wanted):
        return F.filter(F.col(spans), lambda s: s.kind.isin(*wanted))

    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
                        F.sha2(shown(of(*kinds)), 256).alias("base_sha256"), shown(F.col(spans)).alias("spans"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op1_url_filter(spark, sf_dir):
    from sparkmail.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_top_k(spark, sf_dir):
    from sparkmail.llm.topk import scaled, top_k

    vectors = scaled(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return top_k(vectors.where(F.col("id") % 20 == 0), vectors, k=20)


@query
def op3_secret_scan(spark, sf_dir):
    from sparkmail.llm.secret_scan import BASE, find_secrets

    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return digest(found, "spans", [r.kind for r in BASE])


@query
def op4_pii(spark, sf_dir):
    from sparkmail.llm.pii import BASE, find_pii

    return digest(find_pii(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id"), "spans", list(BASE))


@query
def op5_language(spark, sf_dir):
    from sparkmail.llm.language import fit_profiles, held_out, identify

    docs = read(spark, sf_dir, "documents")
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))), "text", "lang")
    return identify(docs, profiles).withColumnRenamed("id", "doc_id")


@query
def op6_token_count(spark, sf_dir):
    from sparkmail.llm.token_count import count_tokens

    found = count_tokens(read(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json")
    return found.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op7_html_text(spark, sf_dir):
    from sparkmail.llm.html_text import extract

    return extract(read(spark, sf_dir, "pages"))


@query
def op8_near_dup(spark, sf_dir):
    from sparkmail.llm.near_dup import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


@query
def op9_pack(spark, sf_dir):
    from sparkmail.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", length=1024)


@query
def op10_decontaminate(spark, sf_dir):
    from sparkmail.llm.decontaminate import decontaminate

    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op11_periodic_runs(spark, sf_dir):
    from sparkmail.llm.runs import periodic_runs

    found = periodic_runs(read(spark, sf_dir, "documents"), loop=True, texts=False).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query
def op12_quality_rules(spark, sf_dir):
    from sparkmail.llm.quality_rules import fit_references, judge_quality

    docs = read(spark, sf_dir, "documents")
    return judge_quality(docs, fit_references(docs)).withColumnRenamed("id", "doc_id")


@query
def op13_merkle_manifest(spark, sf_dir):
    from sparkmail.llm.merkle import merkle_manifest

    docs = read(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    tampered = F.when(odd, F.col("text")).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return merkle_manifest(docs, claim={"text": tampered}).drop("proof").withColumnRenamed("id", "doc_id")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in oracles.ORACLE.items() if k in QUERIES}
