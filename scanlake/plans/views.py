"""How the given tables stand for code-security data: files, findings, logs, edges.

Every view covers the whole table; nothing is filtered by id, sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


WIDE_WORK = ("documents", "pages", "lineitem", "orders", "events")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in WIDE_WORK else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input comes in fewer pieces than there are cores (a file with one row group).

    A table of many files already has more pieces than cores and is left alone. Filters and column
    pruning still reach the scan, since both pass through a repartition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a corpus: one scan per source, path = source/lang/doc_id.ext."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("scan_id"), F.concat_ws("/", "source", F.concat("doc_id", F.lit("."), "lang")).alias("path"),
        F.col("text").alias("content"), "doc_id")


FILES_SQL = ("select source as scan_id, source || '/' || doc_id || '.' || lang as path, text as content, doc_id "
             "from documents")


_PAGE_TAIL = ("case length(html) % 4 when 0 then 'system(\"x\" + user)' when 1 then 'fetch(req.query.u)' "
              "when 2 then 'db.query(\"select \" + input)' else 'readFile(params.p)' end")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as text files, each with one more line of code whose shape follows the page's length."""
    return table(spark, sf, "pages").select(
        F.lit("site").alias("scan_id"), F.concat("page_id", F.lit(".html")).alias("path"), F.concat_ws("\n", "html", F.expr(_PAGE_TAIL)).alias("content"))


PAGES_SQL = f"select 'site' as scan_id, page_id || '.html' as path, html || chr(10) || {_PAGE_TAIL} as content from pages"


def code_files(spark: SparkSession, sf: str, extension: str, head: str, statement, tail: str = "") -> DataFrame:
    """One generated source file per order: one statement per line item, in a total order.

    ``statement`` maps the line-item columns to one statement (text with line breaks).
    """
    li = table(spark, sf, "lineitem").withColumn("stmt", statement)
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "stmt"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda x: x.stmt), "\n")
    parts = [F.lit(head + "\n")] if head else []
    parts.append(body)
    if tail:
        parts.append(F.lit("\n" + tail))
    return li.groupBy("l_orderkey").agg(F.concat(*parts).alias("content")).select(
        F.lit("repo").alias("scan_id"), F.concat(F.lit("src/f"), "l_orderkey", F.lit(extension)).alias("path"), "content", "l_orderkey")


NUMBERED_SQL = """numbered as (
  select *, row_number() over (partition by l_orderkey
           order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as n
  from lineitem)"""
