"""Readers, writers and import steps on copies of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainsift.operators.materialize import checkpoint_folder
from grainsift.operators.profile import missing_by_column
from grainsift.registry import register
from grainsift.registry.views import PEOPLE_COLUMNS, PEOPLE_CTE, each, people, table
from grainsift.sources import readers, writers

_BY_SEGMENT = """SELECT c_mktsegment, count(*) AS n, CAST(count(DISTINCT c_name) AS BIGINT) AS names,
round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment"""


def _new_folder(spark: SparkSession, suffix: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/copy-{uuid.uuid4().hex}{suffix}"


def _by_segment(df: DataFrame) -> DataFrame:
    return df.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.countDistinct("c_name").alias("names"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("src_csv", _BY_SEGMENT)
def src_csv(spark, sf):
    folder = _new_folder(spark, ".csv")
    writers.write_csv(table(spark, sf, "customer"), folder)
    return _by_segment(readers.read_csv(spark, folder))


@register("src_csv_text", """
SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS text_length, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines
FROM documents""")
def src_csv_text(spark, sf):
    folder = _new_folder(spark, ".csv")
    writers.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "text"), folder)
    back = readers.read_csv(spark, folder)
    return back.select("doc_id", "lang", F.length("text").alias("text_length"), F.size(F.split("text", "\n", -1)).alias("n_lines"))


@register("src_na_normalize", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def src_na_normalize(spark, sf):
    token = F.when(F.col("c_custkey") % 2 == 0, F.lit("N/A")).otherwise(F.lit("null"))
    return readers.na_normalize(table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, token).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("balance")))


@register("src_json", _BY_SEGMENT)
def src_json(spark, sf):
    folder = _new_folder(spark, ".json")
    table(spark, sf, "customer").write.json(folder)
    return _by_segment(readers.read_json(spark, folder))


@register("src_dispatch", _BY_SEGMENT)
def src_dispatch(spark, sf):
    return _by_segment(readers.read_table(spark, f"{sf}/customer.parquet"))


@register("src_size")
def src_size(spark, sf):
    return readers.dataset_size(spark, f"{sf}/lineitem.parquet")


@register("src_encoding_probe", """
SELECT 'customer' AS source, 'UTF-8' AS encoding, CAST(count(*) AS BIGINT) AS n_rows FROM customer
UNION ALL SELECT 'documents', 'ISO-8859-1', CAST(count(*) AS BIGINT) FROM documents""")
def src_encoding_probe(spark, sf):
    plain, western = _new_folder(spark, ".csv"), _new_folder(spark, ".csv")
    table(spark, sf, "customer").select("c_custkey", "c_name").write.option("header", True).csv(plain)
    words = table(spark, sf, "documents").select("doc_id", "text")
    words.write.options(header=True, encoding="ISO-8859-1", escape='"').csv(western)
    frames = []
    for name, folder in (("customer", plain), ("documents", western)):
        encoding = readers.detect_encoding(spark, folder)
        read = readers.read_csv(spark, folder, infer=False, encoding=encoding)
        frames.append(read.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("source"), F.lit(encoding).alias("encoding"), "n_rows"))
    return frames[0].union(frames[1])


@register("src_first_match")
def src_first_match(spark, sf):
    folder = _new_folder(spark, "")
    for name in ("b", "a"):
        writers.write_csv(table(spark, sf, "nation"), f"{folder}/{name}")
    return readers.first_matching_file(spark, folder)


@register("src_flatten_nested", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n_values FROM embeddings")
def src_flatten_nested(spark, sf):
    flat = readers.flatten_nested(table(spark, sf, "embeddings"))
    return flat.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).alias("n_values"))


@register("src_limit", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000")
def src_limit(spark, sf):
    return readers.first_rows(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@register("src_import_summary", """
SELECT count(*) AS n_rows, 6 AS n_columns,
'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_names,
'orders.parquet' AS file_name FROM orders""")
def src_import_summary(spark, sf):
    return readers.import_summary(table(spark, sf, "orders"))


@register("sink_csv", _BY_SEGMENT)
def sink_csv(spark, sf):
    folder = _new_folder(spark, "-" + writers.cleaned_name("customer file.csv"))
    writers.write_csv(table(spark, sf, "customer"), folder)
    return _by_segment(readers.read_csv(spark, folder))


MISSING_SQL = f"WITH {PEOPLE_CTE} " + each(
    "SELECT '@' AS column_name, count(*) AS n_rows, count(*) - count(@) AS missing_count, "
    "round((count(*) - count(@)) / CAST(count(*) AS DOUBLE), 4) AS missing_fraction FROM people", PEOPLE_COLUMNS)


@register("sink_report_json", MISSING_SQL)
def sink_report_json(spark, sf):
    folder = _new_folder(spark, ".json")
    writers.write_report_json(missing_by_column(people(spark, sf).drop("row_id")), folder)
    return readers.read_json(spark, folder)
