"""Readers and writers. All paths are Spark's, so any store that the session knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def read_matrix_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Headerless numbers, one row a line; what is no number is missing."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return spark.read.schema(schema).option("header", "false").csv(path)


def write_scores_csv(df: DataFrame, path: str, outputs: list[str], widths: dict[str, int] | None = None) -> None:
    """Outputs with six decimals under a header; a wide output is name_0, name_1 and so on.

    Its width is what the graph declared (a scored frame's columns carry it)
    or what widths says; a row of another width is an error, a missing one is
    as many empty fields.
    """
    text = lambda c: F.when(c.isNotNull(), F.format_string("%.6f", c))
    cols = []
    for n in outputs:
        if isinstance(df.schema[n].dataType, T.ArrayType):
            width = (widths or {}).get(n, df.schema[n].metadata.get("width"))
            if width is None:
                raise ValueError(f"output {n} is an array of no declared width")
            fits = F.col(n).isNull() | (F.size(n) == width)
            held = F.when(fits, F.col(n)).otherwise(F.raise_error(F.lit(f"a row of {n} is not {width} wide")))
            cols += [text(F.get(held, F.lit(i))).alias(f"{n}_{i}") for i in range(width)]
        else:
            cols.append(text(F.col(n)).alias(n))
    df.select(*cols).write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
