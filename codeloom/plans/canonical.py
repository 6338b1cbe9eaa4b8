"""The code model (files, symbols, edges, bindings, vectors) as views of the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, size, hash, content) from documents."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(path.alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("hash"), F.col("text").alias("content"), "doc_id")


FILES_SQL = "SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, lang AS language, n_chars AS size, sha256(text) AS hash, text AS content, doc_id FROM documents"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols from part: an id, a two-word name, a kind, a language, a file and a span of lines each."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "_"), F.lit(".ts"))
    return p.select(
        F.col("p_partkey").alias("key"),
        F.md5(F.concat_ws(":", F.col("p_partkey").cast("string"), "p_name")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("language"),
        path.alias("file_path"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + F.col("p_partkey") % 17).cast("int").alias("end_line"),
        F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("signature"),
    )


SYMBOLS_SQL = """SELECT p_partkey AS key, md5(concat(p_partkey, ':', p_name)) AS id, p_name AS name, p_type AS kind, p_brand AS language,
    concat('src/', lower(p_type), '/', replace(p_name, ' ', '_'), '.ts') AS file_path, p_size AS start_line,
    CAST(p_size + p_partkey % 17 AS INTEGER) AS end_line, concat(p_type, ' ', p_name, ' ', p_brand) AS signature FROM part"""


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between symbols from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "calls").when(F.col("l_returnflag") == "A", "uses").otherwise("references")
    return li.select(F.col("l_partkey").alias("from_key"), F.col("l_suppkey").alias("to_key"), kind.alias("kind"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("order_key"), F.round(1 - F.col("l_discount"), 4).alias("confidence"))


RELATIONSHIPS_SQL = "SELECT l_partkey AS from_key, l_suppkey AS to_key, CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'uses' ELSE 'references' END AS kind, l_linenumber AS line, l_orderkey AS order_key, round(1 - l_discount, 4) AS confidence FROM lineitem"
