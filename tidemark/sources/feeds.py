"""Message and depth files: discovery, conversion from CSV to Parquet, loading.

A day of a symbol is two headerless CSV files of the same number of rows, ``SYMBOL_DATE_start_end_message_K.csv`` and
``..._orderbook_K.csv``: row i of the second is the K-level book after message i. In Parquet a row's place is stored as ``seq``, and
days are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.depth import seeds
from ..plans.scratch import ship
from ..schema import MESSAGE_SCHEMA, depth_columns, depth_schema

# Fixed value: the pattern of the file names.
NAME = r"([A-Z.]+)_(\d{4}-\d{2}-\d{2})_(\d+)_(\d+)_(message|orderbook)_(\d+)\.csv$"
CSV_COLUMNS = ("time", "type", "order_id", "size", "price", "direction")


def find_days(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, trade_date, levels, messages and depth (paths) of the days of which both files are there. An empty file counts as missing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    part = lambda i: F.regexp_extract("path", NAME, i)
    named = files.select("path", part(1).alias("symbol"), part(2).alias("trade_date"), part(5).alias("kind"), part(6).cast("int").alias("levels")).where("kind <> ''")
    of = lambda kind, name: named.where(F.col("kind") == kind).groupBy("symbol", "trade_date", "levels").agg(F.min("path").alias(name))
    return of("message", "messages").join(of("orderbook", "depth"), ["symbol", "trade_date", "levels"])


def find_day(spark: SparkSession, folder: str, symbol: str, trade_date: str, levels: int) -> DataFrame:
    """The one day; FileNotFoundError if either file is missing."""
    day = find_days(spark, folder).where((F.col("symbol") == symbol) & (F.col("trade_date") == trade_date) & (F.col("levels") == levels))
    if day.isEmpty():
        raise FileNotFoundError(f"{symbol} {trade_date} with {levels} levels in {folder}")
    return day


def parse_time(text: Column) -> Column:
    """Decimal seconds as text to integer nanoseconds, exactly; further digits are cut off. NULL for anything else."""
    whole, fraction = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    return F.try_to_number(whole, F.lit("999999999999")).cast("bigint") * 1_000_000_000 + F.rpad(F.substring(fraction, 1, 9), 9, "0").try_cast("bigint")


def _rows(days: DataFrame, column: str, n_columns: int) -> DataFrame:
    """symbol, trade_date, seq and the text columns c0 .. of every file: a file is read by one task, batch by batch, in the order of its rows."""
    names = [f"c{i}" for i in range(n_columns)]
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.StringType()), T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in names]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv, fs

        for b in batches:
            for symbol, date, path in zip(*[c.to_pylist() for c in b.columns]):
                files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                at = 0
                with files.open_input_stream(place) as stream:
                    try:
                        rows = csv.open_csv(stream, csv.ReadOptions(column_names=names), convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False))
                    except pa.ArrowInvalid as e:
                        if "Empty CSV" in str(e):
                            continue
                        raise
                    for x in rows:
                        n = x.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([symbol] * n, pa.string()), pa.array([date] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), *x.columns], schema.fieldNames()
                        )
                        at += n

    ship(days.sparkSession)
    paths = days.select("symbol", "trade_date", F.regexp_replace(column, "^file:/(?!/)", "file:///").alias("path"))
    return paths.repartition(F.col("path")).mapInArrow(read, schema)


def read_messages(days: DataFrame) -> DataFrame:
    """Typed messages of the days: symbol, trade_date and the columns of ``MESSAGE_SCHEMA``."""
    raw = _rows(days, "messages", len(CSV_COLUMNS))
    kinds = [f.dataType for f in MESSAGE_SCHEMA.fields[2:]]
    return raw.select("symbol", "trade_date", "seq", parse_time(F.col("c0")).alias("ts_ns"), *[F.trim(F.col(f"c{i}")).cast(t).alias(c) for i, (c, t) in enumerate(zip(CSV_COLUMNS[1:], kinds), 1)])


def read_depth(days: DataFrame, levels: int) -> DataFrame:
    """Typed depth rows of the days that have ``levels`` levels."""
    cols = depth_columns(levels)
    raw = _rows(days.where(F.col("levels") == levels), "depth", len(cols))
    return raw.select("symbol", "trade_date", "seq", *[F.trim(F.col(f"c{i}")).cast(f.dataType).alias(f.name) for i, f in enumerate(depth_schema(levels).fields)])


def _stored_days(spark: SparkSession, path: str) -> DataFrame:
    """symbol, trade_date of the days that a converted table already has."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = T.StructType([*MESSAGE_SCHEMA.fields[:1], T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.StringType())])
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema).select("symbol", "trade_date")
    return spark.read.schema(schema).parquet(path).select("symbol", "trade_date").distinct()


def convert(days: DataFrame, out: str, levels: int, force: bool = False, row_group_bytes: int = 64 << 20) -> None:
    """Write messages and depth as Parquet, partitioned by symbol and date. Day by day and table by table, what exists is kept, or replaced with ``force``; other days stay.

    row_group_bytes: at most so many bytes in a row group, the unit that a later scan is divided into. The number of levels is kept as metadata of every depth column.
    """
    spark, own = days.sparkSession, days.where(F.col("levels") == levels)
    for name, read in (("messages", read_messages), ("depth", lambda d: read_depth(d, levels))):
        path = f"{out}/{name}_{levels}"
        new = own if force else own.join(_stored_days(spark, path), ["symbol", "trade_date"], "left_anti")
        rows = read(new)
        rows = rows.select(*[F.col(c).alias(c, metadata={"levels": levels}) if "_px_" in c or "_sz_" in c else F.col(c) for c in rows.columns])
        how = rows.write.option("compression", "snappy").option("parquet.block.size", row_group_bytes).partitionBy("symbol", "trade_date")
        (how.mode("overwrite").option("partitionOverwriteMode", "dynamic") if force else how.mode("append")).parquet(path)


def load_messages(spark: SparkSession, out: str, levels: int) -> DataFrame:
    schema = T.StructType([*MESSAGE_SCHEMA.fields, T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.StringType())])
    return spark.read.schema(schema).parquet(f"{out}/messages_{levels}")


def load_depth(spark: SparkSession, out: str, levels: int) -> DataFrame:
    schema = T.StructType([T.StructField("seq", T.LongType()), *depth_schema(levels).fields, T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.StringType())])
    return spark.read.schema(schema).parquet(f"{out}/depth_{levels}")


def load_seeds(spark: SparkSession, out: str, levels: int) -> DataFrame:
    return seeds(load_depth(spark, out, levels), levels)


def save(df: DataFrame, path: str) -> None:
    """Write a result by the extension of ``path``: .csv with a header, else Parquet."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
