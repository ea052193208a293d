"""Run metrics on disk: JSON, one folder per tokenizer and scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphloom.functions.metrics import METRICS

EPOCH_SCHEMA = ("epoch int, split string, "
                + ", ".join(f"{m} double" for m in METRICS)
                + ", train_loss double, val_loss double, lr double")
TEST_SCHEMA = "split string, " + ", ".join(f"{m} double" for m in METRICS)


def write_runs(records: DataFrame, path: str) -> None:
    """Write records by ``tokenizer`` and ``scorer``; only the runs given are replaced."""
    (records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("tokenizer", "scorer").json(path))


def read_runs(spark: SparkSession, path: str, test: bool = False) -> DataFrame:
    """Read what :func:`write_runs` wrote; fields missing in older records are null."""
    schema = TEST_SCHEMA if test else EPOCH_SCHEMA
    return spark.read.schema(f"{schema}, tokenizer string, scorer string").json(path)


def read_result_files(spark: SparkSession, path: str, test: bool = False) -> DataFrame:
    """Read single-file results ``[test_]metrics_<tokenizer>_<scorer>.json``.

    Each file is one array of epoch records, or one test record; missing fields are
    null.  The run's keys come from the file name.
    """
    prefix, schema = ("test_metrics", TEST_SCHEMA) if test else ("metrics", EPOCH_SCHEMA)
    pattern = rf"/{prefix}_([^_/]+)_([^_/]+)\.json$"
    rows = (spark.read.schema(schema).option("multiLine", True)
            .option("pathGlobFilter", f"{prefix}_*.json").json(path))
    name = F.col("_metadata.file_path")
    return rows.select(*rows.columns, F.regexp_extract(name, pattern, 1).alias("tokenizer"),
                       F.regexp_extract(name, pattern, 2).alias("scorer"))
