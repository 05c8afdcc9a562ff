"""Sources and sinks of numeric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def read_csv(spark: SparkSession, path: str, numeric: Sequence[str], keys: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """A CSV file with a header as doubles (keys as strings), by name; raises if a key repeats or a value is missing."""
    head = spark.read.option("header", True).csv(path)
    picked = [c for c in head.columns if c in (*numeric, *keys) and c not in exclude]
    schema = StructType([StructField(c, DoubleType()) if c in numeric else head.schema[c] for c in head.columns])
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path).select(*picked)
    if keys and not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows repeat a key of {list(keys)}")
    return df


def read_zipped_csv(spark: SparkSession, path: str, member: str, numeric: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A CSV member of ZIP archives: archives are read by Spark, opened and parsed on the executors."""
    import csv
    import io
    import zipfile

    import pyarrow as pa

    names = [*keys, *numeric]

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    reader, rows = csv.DictReader(io.TextIOWrapper(f, "utf-8")), []
                    for r in reader:
                        rows.append([r[k] for k in keys] + [float(r[c]) for c in numeric])
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join([f"`{k}` string" for k in keys] + [f"`{c}` double" for c in numeric]))


def from_matrix(spark: SparkSession, x, y, names: Sequence[str], target: str = "y", row_id: str = "_row_id") -> DataFrame:
    """A small in-memory matrix with a target and a row id."""
    import pandas as pd

    frame = pd.DataFrame(x, columns=list(names)).astype(float)
    frame[target] = [float(v) for v in y]
    frame.insert(0, row_id, range(len(frame)))
    return spark.createDataFrame(frame)


def to_matrix(df: DataFrame, columns: Sequence[str], order: Sequence[str]):
    """The columns as a NumPy matrix in the order of the keys: for results small enough for the driver."""
    return df.orderBy(*order).select(*[F.col(f"`{c}`") for c in columns]).toPandas().to_numpy(float)


def group_ids(df: DataFrame, columns: Sequence[str], alias: str = "group_id") -> DataFrame:
    """The same id for rows that agree in the columns."""
    return df.withColumn(alias, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
