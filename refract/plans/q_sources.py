"""Registered queries: sources, row identity, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from refract.functions import text as TX
from refract.plans import sqlx as Q
from refract.plans.catalog import register
from refract.session import scratch_path
from refract.sources import files, tables

# Reference workload constants (fixed values): article rows 0..486 of the
# link list, and the first 20 records of a bulk perspective file.
RECORDS_START, RECORDS_END = 0, 486
MAX_RECORDS = 20


def _arts(spark, sf):
    return tables.articles(tables.read_table(spark, sf, "documents"))


@register("article_index", """
SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS article_index
FROM documents""")
def article_index(spark, sf):
    docs = tables.read_table(spark, sf, "documents").select("doc_id", "source")
    return tables.index_rows(docs, ["doc_id"], "article_index")


@register("row_range", f"""
SELECT doc_id AS article_index, {Q.first_line('text')} AS title, source AS link,
       length(text)::BIGINT AS n_chars
FROM documents WHERE doc_id >= {RECORDS_START} AND doc_id < {RECORDS_END}""")
def row_range(spark, sf):
    return (tables.row_range(_arts(spark, sf), RECORDS_START, RECORDS_END)
            .select("article_index", "title", "link",
                    F.length("content").cast("long").alias("n_chars")))


@register("first_n", f"""
SELECT doc_id AS article_index, {Q.first_line('text')} AS title, source AS link
FROM documents ORDER BY doc_id LIMIT {MAX_RECORDS}""")
def first_n(spark, sf):
    return tables.first_n(_arts(spark, sf), MAX_RECORDS).select("article_index", "title", "link")


@register("multi_source_union", f"""
WITH u AS (
  SELECT 0 AS source_ord, doc_id AS rec_key, text FROM documents
  UNION ALL
  SELECT 1 AS source_ord, item_id AS rec_key, text FROM benchmark)
SELECT source_ord, rec_key, {Q.first_line('text')} AS title,
       row_number() OVER (ORDER BY source_ord, rec_key) - 1 AS article_index
FROM u""")
def multi_source_union(spark, sf):
    docs = tables.read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("rec_key"), "text")
    bench = tables.read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("rec_key"), "text")
    out = tables.concat_sources([docs, bench], "rec_key")
    return out.select("source_ord", "rec_key", TX.first_line("text").alias("title"),
                      "article_index")


_ROUNDTRIP_SCHEMA = T.StructType([
    T.StructField("article_index", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("sentences", T.ArrayType(T.StringType())),
])

_ROUNDTRIP_SQL = f"""
SELECT doc_id AS article_index, {Q.first_line('text')} AS title, source AS link,
       md5(text) AS content_md5, len({Q.sentences('text')})::BIGINT AS n_sentences,
       md5(array_to_string({Q.sentences('text')}, chr(10))) AS sentences_md5
FROM documents"""


def _roundtrip_frame(spark, sf):
    return _arts(spark, sf).select("article_index", "title", "link", "content",
                                   TX.sentences("content").alias("sentences"))


def _roundtrip_report(df):
    return df.select("article_index", "title", "link",
                     F.md5("content").alias("content_md5"),
                     F.size("sentences").cast("long").alias("n_sentences"),
                     F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"))


@register("csv_roundtrip", _ROUNDTRIP_SQL)
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv_roundtrip")
    files.write_csv(_roundtrip_frame(spark, sf), path)
    return _roundtrip_report(files.read_csv(spark, path, _ROUNDTRIP_SCHEMA))


@register("json_roundtrip", _ROUNDTRIP_SQL)
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json_roundtrip")
    files.write_json(_roundtrip_frame(spark, sf), path)
    return _roundtrip_report(files.read_json(spark, path, _ROUNDTRIP_SCHEMA))


@register("json_array_roundtrip", _ROUNDTRIP_SQL)
def json_array_roundtrip(spark, sf):
    """Files of one JSON array each, as a bulk export gives them."""
    path = scratch_path(spark, "json_arrays")
    files.write_json_arrays(_roundtrip_frame(spark, sf), path)
    return _roundtrip_report(files.read_json(spark, path, _ROUNDTRIP_SCHEMA, multi_line=True))


@register("link_list_csv", f"""
SELECT source AS link, {Q.first_line('text')} AS title FROM documents""")
def link_list_csv(spark, sf):
    """A link list (link, title) written as delimited text -- titles may
    hold quotes and commas -- and read back with an explicit schema."""
    path = scratch_path(spark, "link_list")
    links = tables.read_table(spark, sf, "documents").select(
        F.col("source").alias("link"), TX.first_line("text").alias("title"))
    links.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_link_list(spark, path)
