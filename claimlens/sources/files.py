"""Flow tables from CSV and parquet files, metric rows and annotation files, and write-once run folders."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Identity and time columns that would leak the label.
LEAKAGE = ("Flow ID", "Source IP", "Src IP", "Destination IP", "Dst IP", "Source Port", "Src Port", "Destination Port", "Dst Port", "Timestamp", "Fwd Header Length.1", "SimillarHTTP", "Unnamed: 0")
META = ("raw_label", "attack_class", "label", "target_class")
METRIC_ROW = "instance_id string, layer string, metric string, value double, k int, component string, delta_space string, `grouping` map<string,string>"
HUMAN = "batch_id string, annotator string, exported_utc string, annotations array<struct<item_id:string,feature:string,text_asserts_direction:string,hedged:boolean,added:boolean>>"


class DataUnavailable(FileNotFoundError):
    """The processed table of a dataset is not there."""


def strip_columns(df: DataFrame) -> DataFrame:
    """IO-02: names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all CSV files below ``folder`` in order of name."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return sorted(r["path"] for r in names.collect())


def finite(c: str) -> Column:
    value = F.col(f"`{c}`").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias(c)


def load_flow_csv(spark: SparkSession, folder: str, max_rows: int | None = None, drop_leakage: bool = True, rows_per_file: int | None = None) -> DataFrame:
    """IO-01: every CSV file below a folder as one table of finite numeric features.

    Files join by column name; ``rows_per_file`` takes every n-th row of a longer
    file, ``max_rows`` whole files in name order and then the head of the last.
    Row order inside a file is the reader's. Names do not differ by case here, so the
    label as read is ``raw_label``.
    """
    paths = csv_files(spark, folder)
    if not paths:
        raise DataUnavailable(f"no CSV file below {folder}")
    made = None
    for n, path in enumerate(paths):
        one = strip_columns(spark.read.option("header", "true").csv(path)).withColumn("file_", F.lit(n)).withColumn("row_", F.monotonically_increasing_id())
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    by_file = Window.partitionBy("file_")
    if rows_per_file is not None:
        size = F.count("*").over(by_file)
        stride = F.when(size > rows_per_file, F.ceil(size / F.lit(rows_per_file))).otherwise(1)
        place = F.row_number().over(by_file.orderBy("row_")) - 1
        made = made.withColumn("at_", place).withColumn("stride_", stride).filter((F.col("at_") % F.col("stride_") == 0) & (F.floor(F.col("at_") / F.col("stride_")) < rows_per_file)).drop("at_", "stride_")
    if drop_leakage:
        made = made.drop(*LEAKAGE)
    features = [c for c in made.columns if c not in (*META, "Label", "file_", "row_")]
    attack = F.trim("Label")
    typed = made.select("file_", "row_", F.col("Label").alias("raw_label"), attack.alias("attack_class"), (F.upper(attack) != "BENIGN").cast("int").alias("label"), *[finite(c) for c in features])
    clean = typed.na.drop(subset=features)
    if max_rows is not None:
        clean = clean.orderBy("file_", "row_").limit(max_rows)
    return clean.drop("file_", "row_")


def feature_columns(df: DataFrame) -> list[str]:
    """PF-07."""
    return [c for c in df.columns if c not in META]


def load_processed(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """IO-03: ``<root>/<dataset>/features.parquet`` or an error that says what to do."""
    path = f"{root}/{dataset}/features.parquet"
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise DataUnavailable(f"{path} is missing; run the correction pipeline of {dataset} first") from error


LOADERS = {"csv": load_flow_csv, "processed": load_processed}


def get_loader(name: str):
    """IO-04."""
    return LOADERS[name]


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """IO-05: metric rows of a run."""
    return spark.read.schema(METRIC_ROW).json(path)


def load_human(spark: SparkSession, path: str) -> DataFrame:
    """IO-09: an exported annotation file as rows."""
    doc = spark.read.schema(HUMAN).option("multiLine", "true").json(path)
    return doc.select("batch_id", "annotator", "exported_utc", F.posexplode("annotations").alias("pos", "a")).select("batch_id", "annotator", "exported_utc", "pos", "a.*")


def load_llm(spark: SparkSession, path: str, annotator: str) -> DataFrame:
    """IO-09, IO-11: a pass as JSON lines or one array, with or without a code fence or byte order mark."""
    whole = spark.read.text(path, wholetext=True)
    bare = F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"(?m)^\s*```\w*\s*$", ""))
    lines = F.when(bare.startswith("["), bare).otherwise(F.concat(F.lit("["), F.array_join(F.filter(F.split(bare, r"\r?\n"), lambda x: F.trim(x) != ""), ","), F.lit("]")))
    kind = "array<struct<item_id:string,claims:array<struct<feature:string,dir:string,hedged:boolean>>>>"
    return whole.select(F.lit(annotator).alias("annotator"), F.posexplode(F.from_json(lines, kind)).alias("pos", "x")).select("annotator", "pos", "x.*")


def load_annotations(spark: SparkSession, path: str, annotator: str = "pass") -> DataFrame:
    """IO-10: either format as (annotator, item_id, feature, label)."""
    if path.endswith(".jsonl"):
        return load_llm(spark, path, annotator).select("annotator", "item_id", F.explode("claims").alias("c")).select("annotator", "item_id", F.col("c.feature").alias("feature"), F.col("c.dir").alias("label"))
    return load_human(spark, path).select("annotator", "item_id", "feature", F.col("text_asserts_direction").alias("label"))


def zip_files(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """IO-07, JN-11: rows of two files side by side by position; different lengths or keys are an error."""
    numbered = []
    for name, df in (("l", left), ("r", right)):
        rows = df.rdd.zipWithIndex().map(lambda x: (x[1], x[0]))
        numbered.append(df.sparkSession.createDataFrame(rows, f"i long, {name} {df.schema.simpleString()}"))
    met = numbered[0].join(numbered[1], "i", "full")
    same = F.coalesce(F.col(f"l.{key}") == F.col(f"r.{key}"), F.lit(False))
    return met.select("i", F.when(same, F.col("l")).otherwise(F.raise_error(F.lit("the files are not aligned"))).alias("l"), "r")


def rounded(value: object, digits: int = 10) -> object:
    """IO-17: floats inside nested lists and objects rounded."""
    if isinstance(value, float):
        return round(value, digits)
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    return [rounded(v, digits) for v in value] if isinstance(value, (list, tuple)) else value


def sorted_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """IO-06: one JSON object with sorted keys for each row, in order."""
    return df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_once(df: DataFrame, path: str) -> None:
    """IO-14: a table that is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def check_output(path: Path, result: dict) -> bool:
    """IO-15: whether a stored result equals the one made again."""
    return path.read_text() == json.dumps(rounded(result), sort_keys=True, indent=1)
