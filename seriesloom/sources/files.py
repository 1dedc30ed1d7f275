"""CSV in and out, schema discovery and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Time formats tried in turn on string columns.
TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "yyyy-MM",
]


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None):
    """Return (DataFrame, None), or (None, message) when the file cannot be read."""
    try:
        reader = spark.read.option("header", True)
        return (reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)), None
    except Exception as error:
        return None, str(error)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, order_by: str, rows: int = 10) -> DataFrame:
    return df.orderBy(order_by).limit(rows)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def parse_time(name: str):
    """String column as a timestamp, null where no known format fits."""
    return F.coalesce(*[F.try_to_timestamp(F.col(name), F.lit(fmt)) for fmt in TIME_FORMATS]).cast("timestamp_ntz")


def detect_time_column(df: DataFrame) -> str | None:
    """First column, in order, of which every value reads as a time; numbers never count."""
    timed = (T.TimestampType, T.TimestampNTZType, T.DateType)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    bad = {}
    if texts:
        counts = [
            F.count_if(F.col(c).isNotNull() & parse_time(c).isNull()).alias(f"bad{j}") for j, c in enumerate(texts)
        ] + [F.count(c).alias(f"seen{j}") for j, c in enumerate(texts)]
        row = df.agg(*counts).first()
        bad = {c: row[f"bad{j}"] > 0 or row[f"seen{j}"] == 0 for j, c in enumerate(texts)}
    for field in df.schema.fields:
        if isinstance(field.dataType, timed) or bad.get(field.name) is False:
            return field.name
    return None
