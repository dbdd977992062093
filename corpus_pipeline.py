"""The corpus pipeline: each stage works on all that the one before it kept and writes what it keeps.

1. ``toxicity``: documents that the classifier rejects go.
2. ``simhash_dedup``: one document of each group of near copies stays, the one with the smallest id.
3. ``decontamination``: documents that hold a benchmark passage go.
4. ``secret_scan``: secrets in the text are replaced by a mark; ``n_chars`` follows.
5. ``sentencepiece``: documents become token ids.

Decisions fall on rows (id and text together), so rows without an id are judged like others and rows that share an id apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanlake.llm import codec, decontam, secret_scan, simhash, toxicity
from scanlake.llm.tables import table
from scanlake.scale import ensure_checkpoint_dir
from scanlake.session import ship


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, never null: rows of one key have one id and one text. Keys are ordered like the ids, rows without an id last."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return docs.withColumn(name, F.concat(F.coalesce(number, F.lit("~")), F.coalesce(F.md5("text"), F.lit("~")))), name


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not among those of ``dropped``."""
    return docs.join(dropped.select(key).distinct(), key, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text is not toxic; null and empty texts score like silence. Rows without an id are judged like others."""
    ship(spark)
    rows, key = keyed(docs)
    scored = toxicity.score(rows, table(spark, sf_dir, "labels"), carry=(key,))
    return without(rows, key, scored.filter("predicted = 1")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, without an id only where no row of the group has one.

    Null and empty texts are one group (fingerprint zero). Of rows alike in id and text the one with the smallest other columns stays.
    """
    ship(spark)
    rows, key = keyed(docs)
    kept = without(rows, key, simhash.near_copies(rows, id_col=key).filter(f"{key} <> component_id"))
    again = kept.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    single = kept.join(again, key, "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark passage; null and empty texts hold none."""
    ship(spark)
    rows, key = keyed(docs)
    return without(rows, key, decontam.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key)).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets marked; ``n_chars`` of a null text stays as it is."""
    ship(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows, repeated ones too; a null text reads as empty."""
    ship(spark)
    return codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: A trained classifier and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this run wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a Parquet table in the shared checkpoint folder, gone once the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
