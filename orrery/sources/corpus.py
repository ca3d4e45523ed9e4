"""Readers and writers: filings as text files, golden sets, run files, the passage index."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "note string, questions array<struct<id:string,category:string,question:string,tickers:array<string>,source_files:array<string>,sections:array<string>,absent:array<string>,probe:string,expect_fiscal_years:array<int>,note:string>>"


def read_filings(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """(source_file, raw) of the text files of a folder, undecodable bytes replaced; with ``names``, of these files only, all
    of which must be there."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    df = df.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    if names is not None:
        wanted = spark.createDataFrame([(n,) for n in names], "source_file string")
        gone = wanted.join(df.select("source_file"), "source_file", "left_anti").limit(20).collect()
        if gone:
            raise FileNotFoundError(", ".join(sorted(r.source_file for r in gone)))
        df = df.join(F.broadcast(wanted), "source_file", "left_semi") if len(names) <= 10_000 else df.join(wanted, "source_file", "left_semi")
    return df


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a golden set, one a row; a file of another shape fails."""
    return spark.read.schema(GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("questions").alias("q")).select("q.*")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(file, run VARIANT, config, generated_at): evaluation runs, newest first; files that are no JSON objects, and the
    copies named latest.json and summary.json, are passed over."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    run = raw.where(~F.col("file").isin("latest.json", "summary.json")).withColumn("run", F.try_parse_json("value"))
    run = run.withColumn("config", F.try_variant_get("run", "$.config", "string")).withColumn("generated_at", F.try_variant_get("run", "$.generated_at", "string"))
    return run.where("config is not null").drop("value").orderBy(F.desc("generated_at"), "file")


def write_index(chunks: DataFrame, path: str, recreate: bool = False) -> None:
    """Passages as Parquet by ticker, sorted by year; without ``recreate`` only the tickers at hand are replaced. A folder
    that holds other files is refused."""
    spark = chunks.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p) and (foreign := [s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("ticker=", "_", "."))]):
        raise PermissionError(f"not an index: {foreign[:3]}")
    out = chunks.repartition("ticker", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("ticker", "fiscal_year").write.mode("overwrite").partitionBy("ticker")
    (out if recreate else out.option("partitionOverwriteMode", "dynamic")).parquet(path)


def reconciled(sent: DataFrame, landed: DataFrame, key: str = "source_file") -> DataFrame:
    """(key, sent, landed) where the counts differ."""
    a, b = sent.groupBy(key).agg(F.count("*").alias("sent")), landed.groupBy(key).agg(F.count("*").alias("landed"))
    return a.join(b, key, "full").na.fill(0, ["sent", "landed"]).where("sent <> landed")


def read_summary(spark: SparkSession, path: str, run_files: list[str]) -> DataFrame:
    """One row, or none if the file is missing, is no JSON object, or lacks a headline or findings: the summary (VARIANT), whether
    its figures were verified (not, if that is not stated), and whether it is stale, of other runs than ``run_files``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "summary variant, verified boolean, stale boolean")
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    get = lambda at, kind: F.try_variant_get("v", at, kind)
    files, want = F.coalesce(get("$.run_files", "array<string>"), F.array().cast("array<string>")), F.array(*map(F.lit, run_files)).cast("array<string>")
    stale = (F.size(F.array_except(files, want)) > 0) | (F.size(F.array_except(want, files)) > 0)
    whole = (F.coalesce(get("$.summary.headline", "string"), F.lit("")) != "") & (F.coalesce(F.size(get("$.summary.findings", "array<variant>")), F.lit(0)) > 0)
    return v.where(whole).select(F.try_variant_get("v", "$.summary", "variant").alias("summary"), F.coalesce(get("$.verification.verified", "boolean"), F.lit(False)).alias("verified"), stale.alias("stale"))


def _put(spark: SparkSession, path: str, text: str, replace: bool) -> None:
    """A small text file, written by the driver in one piece."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p) and not replace:
        raise FileExistsError(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_run(spark: SparkSession, folder: str, run: DataFrame) -> str:
    """The document of one evaluation (one row) as stamp--config.json, which is never overwritten, and as latest.json."""
    row = run.select(F.to_json(F.struct(*run.columns)).alias("j"), "config", F.col("generated_at").cast("string").alias("at")).first()
    stamp, slug = re.sub("[^0-9T]", "", row["at"]), re.sub("[^a-z0-9]+", "-", row["config"].lower()).strip("-")
    _put(spark, f"{folder}/{stamp}--{slug}.json", row["j"], False)
    _put(spark, f"{folder}/latest.json", row["j"], True)
    return f"{stamp}--{slug}.json"


def write_golden(spark: SparkSession, path: str, questions: DataFrame, note: str = "") -> None:
    """A golden set, a table written by hand of at most 10,000 questions, as one JSON file."""
    rows = [r.j for r in questions.orderBy("id").limit(10_001).select(F.to_json(F.struct(*questions.columns)).alias("j")).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10000 questions")
    _put(spark, path, json.dumps({"note": note, "questions": [json.loads(r) for r in rows]}, indent=2, ensure_ascii=False), True)


def write_summary(spark: SparkSession, path: str, document: dict) -> None:
    _put(spark, path, json.dumps(document, indent=2, ensure_ascii=False, default=str), True)


def index_count(spark: SparkSession, path: str, source_files: list[str] | None = None) -> int:
    """The passages of an index, of all files or of some; 0 where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(s.isDirectory() for s in fs.listStatus(p)):
        return 0
    df = spark.read.parquet(path)
    return (df if source_files is None else df.where(F.col("source_file").isin(source_files))).count()


def bootstrapped(spark: SparkSession, path: str, chunks: DataFrame) -> bool:
    """Writes the index if there is none or it is empty; whether it did."""
    if index_count(spark, path):
        return False
    write_index(chunks, path, recreate=True)
    return True


def indexed_tickers(spark: SparkSession, path: str) -> DataFrame:
    """The tickers of an index, from the names of its folders alone."""
    return spark.read.parquet(path).select("ticker").distinct()


def index_row(chunks: DataFrame, vector: Column, terms: Column) -> DataFrame:
    """The rows of an index: the point's id, both representations, and the passage as it is, as ``payload``."""
    from orrery.operators.ingest import point_id

    return chunks.select(point_id(F.col("source_file"), F.col("chunk_index")).alias("point_id"), vector.alias("dense"), terms.alias("sparse"), F.struct(*chunks.columns).alias("payload"))


def passages(points: DataFrame) -> DataFrame:
    """The passages of an index's rows, with the columns that they were written with."""
    return points.select("payload.*")
