"""JSON documents: metrics files and training logs (IO8-IO10).

Metrics documents are one nested struct per run; training logs are
``{"log_history": [...]}`` documents whose entries carry varying keys.
Many files are read in one job; the run name comes from the file path.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corefkit.functions.text import timestamp_text
from corefkit.operators.metrics import matrix, report_struct

# The keys of the published metrics documents.
CLASS_STRUCT = "struct<precision:double,recall:double,`f1-score`:double,support:double>"
METRICS_SCHEMA = (
    "classification_report struct<`Not Coreferent`:" + CLASS_STRUCT + ",Coreferent:" + CLASS_STRUCT
    + ",accuracy:double,`macro avg`:" + CLASS_STRUCT + ",`weighted avg`:" + CLASS_STRUCT + ">, "
    "confusion_matrix array<array<bigint>>, "
    "additional_metrics struct<true_positives:bigint,false_positives:bigint,true_negatives:bigint,"
    "false_negatives:bigint,invalid_count:bigint,invalid_rate:double,total_samples:bigint>, "
    "timestamp string, model_info struct<base_model:string,adapter_path:string>, model_path string, tag string"
)


def run_name(path_col: Column | None = None, folder: bool = False) -> Column:
    """File name without folder and extension, or the name of its folder, from ``_metadata.file_path``."""
    p = path_col if path_col is not None else F.col("_metadata.file_path")
    return F.element_at(F.split(p, "/"), -2) if folder else F.regexp_extract(p, r"([^/]+?)(\.json)?$", 1)


def metrics_document(report: DataFrame, tag: Column | None = None, base_model: str | None = None,
                     adapter_path: str | None = None, model_path: str | None = None,
                     clock: Column | datetime.datetime | None = None) -> DataFrame:
    """IO8 one document per row of a report with invalid counts, with what model made the predictions.

    Documents are stamped with ``clock`` if given (the same at every run), else with the time of the run.
    """
    text = lambda x: F.lit(x).cast("string")
    info = F.when(F.lit(base_model is not None), F.struct(text(base_model).alias("base_model"), text(adapter_path).alias("adapter_path")))
    return report.select(
        report_struct(report).alias("classification_report"), matrix(report).alias("confusion_matrix"),
        F.struct(F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
                 F.col("tn").alias("true_negatives"), F.col("fn").alias("false_negatives"),
                 "invalid_count", "invalid_rate", "total_samples").alias("additional_metrics"),
        timestamp_text(clock=clock).alias("timestamp"), info.alias("model_info"), text(model_path).alias("model_path"),
        (text(None) if tag is None else tag).alias("tag"))


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO8 metrics documents as JSON (one object per row)."""
    df.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """IO10 many metrics documents into one table (explicit schema, no inference).

    Keys with blanks and hyphens (``macro avg``, ``f1-score``) need backticks.
    """
    r = spark.read.schema(METRICS_SCHEMA)
    if multiline:
        r = r.option("multiLine", "true")
    return r.json(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_training_logs(spark: SparkSession, path: str | list[str], multiline: bool = True,
                       run_col: str | None = None, run_from_folder: bool = False,
                       schema: StructType | str | None = None) -> DataFrame:
    """IO9 ``log_history`` entries as rows; absent keys are NULL.

    ``multiline`` reads pretty-printed ``trainer_state.json`` files (one
    document per file); with ``False`` each line is one document. The run
    is ``run_col`` when the documents carry one, else the name of the file, or
    of its folder. Without a ``schema`` the documents are read once more to find it.
    """
    r = spark.read.option("multiLine", "true" if multiline else "false")
    docs = (r.schema(schema) if schema is not None else r).json(path)
    run = F.col(run_col) if run_col else run_name(F.col("_metadata.file_path"), run_from_folder)
    return docs.select(run.alias("run_id"), F.inline("log_history"))
