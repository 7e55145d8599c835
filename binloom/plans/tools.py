"""Simulations, the k-mer front end, streaming insert."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators import arrange, flat, kmers, simulate, tree
from binloom.plans.common import hashed
from binloom.plans.functions import KMERS, SEQUENCE, sequences_of
from binloom.session import shared_folder, table, written
from binloom.streaming.insert import WordStore


def fpr_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Whether each variant keeps the rate of 0.05, with a margin of three standard errors."""
    rate, asked = F.col("rate"), F.col("asked")
    return simulate.fpr_check(spark).select("variant", "bin_size", "asked", (rate <= 0.05 + 3 * F.sqrt(F.lit(0.05 * 0.95) / asked)).alias("kept"))


def hash_collision_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Collisions expected, and whether the mean of those seen is near."""
    near = F.abs(F.col("mean_collisions") - F.col("expected")) <= 3 * F.sqrt(F.col("expected") / 8)
    return simulate.hash_collisions(spark).select("bin_size", F.round("expected", 4).alias("expected"), near.alias("near"))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """(name, id): the distinct names with a number each, from 0."""
    return written(arrange.ranked(df.filter(F.col(name).isNotNull()).select(name).distinct(), [], [F.col(name)], "id"), "numbers")


def kmer_search_documents(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of a language whose documents hold 90 % of the pairs of characters of an evaluation item."""
    documents = table(spark, d, "documents").filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    names = _numbered(documents, "lang")
    values = kmers.pairs_of(documents.join(names, "lang"), "id").distinct()
    asked = kmers.pairs_of(table(spark, d, "eval_items"), "item_id").withColumnRenamed("user_bin_id", "query_id")
    index = tree.build(values, tree.FilterConfig(disable_estimate_union=True))
    asked = written(tree.ratio_thresholds(asked, 0.9), "asked")
    found = tree.verified(tree.count(index, asked, "threshold"), values, asked, "threshold")
    return found.join(names.withColumnRenamed("id", "user_bin_id"), "user_bin_id").select(F.col("query_id").alias("item_id"), "lang", "cnt")


def _sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """k-mers of a sequence for each supplier, and as queries those of a part of it."""
    texts = sequences_of(table(spark, d, "supplier"), "s_suppkey", 3)
    part = texts.withColumn("text", F.expr("substring(text, 11, 40)"))
    return kmers.bins_of(texts, "s_suppkey", k=8), kmers.queries_of(part, "s_suppkey", k=8)


def function_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of each user bin when a function makes three of each part key."""

    def values(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: [k, 2 * k, -k])

    lines = table(spark, d, "lineitem")
    return flat.exact_counts(kmers.values_of(lines, "l_suppkey", "l_partkey", values))


def kmer_search(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose sequence holds 70 % of the 8-mers of a part of a sequence."""
    values, asked = _sequences(spark, d)
    index = tree.build(values, tree.FilterConfig(disable_estimate_union=True))
    asked = written(tree.ratio_thresholds(asked, 0.7), "asked")
    return tree.verified(tree.count(index, asked, "threshold"), values, asked, "threshold").select("query_id", "user_bin_id")


def kmer_count(spark: SparkSession, d: str) -> DataFrame:
    """Queries by supplier: how many of the 8-mers it holds."""
    values, asked = _sequences(spark, d)
    index = tree.build(values, tree.FilterConfig(disable_estimate_union=True))
    return tree.count_verified(index, values, asked)


def streamed_words(spark: SparkSession, d: str) -> DataFrame:
    """Users by type of event, inserted as a stream: bits set in each bin."""
    run = f"{shared_folder(spark)}/binloom-stream-{uuid.uuid4().hex}"
    ids = _numbered(table(spark, d, "events"), "event_type").withColumnRenamed("id", "user_bin_id")
    bins = ids.count()
    schema = table(spark, d, "events").schema
    # A file source wants a folder; the glob keeps it to this table.
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("event_type", F.col("user_id").alias("value"))
    store = WordStore(spark, f"{run}/words", bins, 4999)
    store.start(stream.join(ids, "event_type"), f"{run}/checkpoint").awaitTermination()
    return flat.fill_rate(store.current().words).join(ids, F.col("bin") == F.col("user_bin_id")).select("event_type", "bits")


QUERIES = {f.__name__: f for f in (fpr_simulation, hash_collision_simulation, function_values, kmer_search_documents, kmer_search, kmer_count, streamed_words)}

_SIZE_OF = "ceil(-({n} * 2.0::DOUBLE) / ln(1 - exp(ln(0.05::DOUBLE) / 2)))"
_SPLIT = "(ln(1 - exp(ln(0.05::DOUBLE) / 2)) / ln(1 - exp(ln(1 - exp(ln(1 - 0.05::DOUBLE) / 4)) / 2)))"
_ASKED = f"""
    s AS (SELECT s_suppkey AS key, {SEQUENCE.format(digits="md5(s_suppkey::VARCHAR) || md5('x' || s_suppkey::VARCHAR) || md5('xx' || s_suppkey::VARCHAR)")} AS text FROM supplier),
    {KMERS.format(k=8, source="s")},
    held AS (SELECT DISTINCT key AS b, v FROM kmer),
    asked AS (SELECT key AS q, v FROM kmer WHERE i BETWEEN 11 AND 43),
    lim AS (SELECT q, floor(count(*) * 0.7::DOUBLE) AS t FROM asked GROUP BY 1),
    counted AS (SELECT q, b, count(*) AS cnt FROM asked JOIN held USING (v) GROUP BY 1, 2)
"""

SQL = {
    "fpr_simulation": f"""
        SELECT variant, size::BIGINT AS bin_size, 4096 - 500 AS asked, variant <> 'split' AS kept FROM (VALUES
            ('single', {_SIZE_OF.format(n=500)}), ('split', {_SIZE_OF.format(n=125)}), ('split_corrected', ceil({_SIZE_OF.format(n=125)} * {_SPLIT}))) t(variant, size)
    """,
    "hash_collision_simulation": f"""
        WITH z AS (SELECT {_SIZE_OF.format(n=1000)} AS m), i AS (SELECT unnest(generate_series(1, 999)) AS i)
        SELECT m::BIGINT AS bin_size, round(sum(exp(2 * ln(1 - exp(-2.0::DOUBLE * i / m)))), 4) AS expected, true AS near FROM z CROSS JOIN i GROUP BY m
    """,
    "function_values": """
        SELECT l_suppkey AS user_bin_id, count(DISTINCT v) AS cardinality
        FROM (SELECT l_suppkey, unnest([l_partkey, 2 * l_partkey, -l_partkey]) AS v FROM lineitem) GROUP BY 1
    """,
    "kmer_search": f"WITH {_ASKED} SELECT q AS query_id, b AS user_bin_id FROM counted JOIN lim USING (q) WHERE cnt >= t",
    "kmer_count": f"WITH {_ASKED} SELECT q AS query_id, b AS user_bin_id, cnt FROM counted",
    "streamed_words": f"""
        WITH held AS (SELECT DISTINCT event_type AS b, user_id AS v FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL),
        {hashed("held", "SELECT 4999::BIGINT", 2)}
        SELECT b AS event_type, count(DISTINCT pos) AS bits FROM held JOIN pos USING (v) GROUP BY 1
    """,
    "kmer_search_documents": """
        WITH l AS (SELECT lang, text, unnest(generate_series(1, length(text) - 1)) AS i FROM documents WHERE lang IS NOT NULL AND length(text) >= 2),
        held AS (SELECT DISTINCT lang, 4 * unicode(substr(text, i::BIGINT, 1)) + unicode(substr(text, i::BIGINT + 1, 1)) AS v FROM l),
        e AS (SELECT item_id, text, unnest(generate_series(1, length(text) - 1)) AS i FROM eval_items WHERE length(text) >= 2),
        asked AS (SELECT item_id, 4 * unicode(substr(text, i::BIGINT, 1)) + unicode(substr(text, i::BIGINT + 1, 1)) AS v FROM e),
        lim AS (SELECT item_id, floor(count(*) * 0.9::DOUBLE) AS t FROM asked GROUP BY 1)
        SELECT item_id, lang, cnt FROM (SELECT item_id, lang, count(*) AS cnt FROM asked JOIN held USING (v) GROUP BY 1, 2) JOIN lim USING (item_id) WHERE cnt >= t
    """,
}
