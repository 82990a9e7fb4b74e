"""Registered queries over sources and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.functions import scalars as S
from hearthlog.sources import html_records
from hearthlog.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def html_cards(spark, sf_dir):
    """Everything the page helper finds, as counts."""
    p = html_records.pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text")))
    return p.select("page_id", "title", "h1", F.size("links").alias("n_links"), F.size("media").alias("n_media"), F.size("rows").alias("n_rows"), F.size("cards").alias("n_cards"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def html_titles(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query()
def shape_signature(spark, sf_dir):
    v = F.try_parse_json("props")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.schema_of_variant(v).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query("SELECT 'activity:event:' || event_id AS id, event_type AS activity_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS occurred_at FROM events")
def stream_ledger_available_now(spark, sf_dir):
    """The ledger of the events table, taken in by a stream that stops when it has all."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parque[t]")
    folder = ingest.shared_folder(spark, f"stream-ledger-{uuid.uuid4().hex}")
    prepare = lambda b: b.select(F.concat(F.lit("activity:event:"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("activity_type"), S.iso(F.col("ts")).alias("occurred_at"))
    ingest.run_available(stream, f"{folder}/rows", f"{folder}/checkpoint", prepare)
    return ingest.committed(spark, f"{folder}/rows", ["id"])
