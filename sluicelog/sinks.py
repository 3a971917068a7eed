"""Writers of results. All but ``to_local_csv`` write from the executors."""

import csv
import json

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    """Nested and vector columns as JSON text, which CSV can hold."""

    def flat(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, VectorUDT):
            return F.to_json(vector_to_array(c)).alias(f.name)
        return F.to_json(c).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c

    return df.select(*[flat(f) for f in df.schema])


def to_csv(df: DataFrame, path: str, header: bool = False, single_file: bool = False) -> None:
    """CSV files in a folder; ``single_file`` is for results known to be small."""
    out = _flat(df)
    (out.coalesce(1) if single_file else out).write.csv(path, header=header)


def to_local_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header on the driver's disk, row by row: the driver holds one partition at a time."""
    out = _flat(df)
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(out.columns)
        for row in out.toLocalIterator():
            writer.writerow(row)


def to_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, in one file and in order: for top-N and other bounded results."""
    to_csv(df, path, header=True, single_file=True)


def save(df: DataFrame, path: str, n: int = -1) -> None:
    """The table as CSV with a header, or ``n`` of its rows if ``n`` is not negative."""
    to_csv(df if n < 0 else df.limit(n), path, header=True)


def to_labelled(df: DataFrame, path: str, features: str = "features", prediction: str = "prediction") -> None:
    """Clustered rows: the columns by name, then the features as JSON, then the label; no header."""
    rest = sorted(c for c in df.columns if c not in (features, prediction))
    values = vector_to_array(F.col(features)) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features)
    _flat(df.select(*rest, values.alias(features), prediction)).write.csv(path)


def to_visits(df: DataFrame, path: str) -> None:
    """Page visits as lines ``time client page checkpoint...`` with ``-`` for a missing one."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]
    df.select(F.concat_ws(" ", *shown).alias("value")).write.text(path)


def to_model(df: DataFrame, path: str) -> None:
    """A learned table as JSON lines, to be read back by ``read_model``; its schema lies beside it."""
    df.write.json(path)
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.schema")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``to_model`` wrote, in its own types, to be applied to another day's data."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path.rstrip('/')}.schema").first().value))
    return spark.read.schema(schema).json(path)
