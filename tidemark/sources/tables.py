"""Bars, instruments and signals: schemas, readers, adapters and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from tidemark.functions.columns import code, day_of, number

BAR_SCHEMA = StructType([StructField("instrument", StringType()), StructField("session", DateType()), *[StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume", "change_pct", "per", "pbr")]])
#: Names that deliveries may use for the columns of bars.
ALIASES = {
    "instrument": ("instrument", "ticker", "code", "symbol", "종목코드"),
    "session": ("session", "date", "Date", "날짜"),
    "open": ("open", "Open", "시가"),
    "high": ("high", "High", "고가"),
    "low": ("low", "Low", "저가"),
    "close": ("close", "Close", "종가"),
    "volume": ("volume", "Volume", "거래량"),
    "change_pct": ("change_pct", "Change_pct", "등락률"),
    "per": ("per", "PER"),
    "pbr": ("pbr", "PBR"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(df: DataFrame, fill_fundamentals: bool = True) -> DataFrame:
    """Columns under any known name as bars; text is parsed, what can't be is null."""
    there = {k: next((a for a in names if a in df.columns), None) for k, names in ALIASES.items()}
    out = []
    for field in BAR_SCHEMA:
        c = there[field.name]
        if c is None:
            x = F.lit(None).cast(field.dataType)
        elif field.name == "instrument":
            x = code(F.col(f"`{c}`"))
        elif field.name == "session":
            x = F.col(f"`{c}`").cast("date") if dict(df.dtypes)[c] in ("date", "timestamp") else day_of(F.col(f"`{c}`"))
        else:
            x = number(F.col(f"`{c}`"))
        if fill_fundamentals and field.name in ("per", "pbr"):
            x = F.coalesce(x, F.lit(0.0))
        out.append(x.alias(field.name))
    return df.select(*out)


def from_epoch_millis(df: DataFrame) -> DataFrame:
    """Rows (instrument, timestamp in ms, open … volume) as bars."""
    return normalised(df.withColumn("session", F.to_date(F.timestamp_millis("timestamp"))).drop("timestamp"))


def read_bars_csv(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """CSV with a header, every column text first, so no code loses its zeros."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("mode", "PERMISSIVE")
    raw = reader.csv(path)
    clean = [c.lstrip("﻿").strip() for c in raw.columns]
    return normalised(raw.toDF(*clean))


def read_bars(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    reader = spark.read
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by market, sorted by instrument and session within files; partitions
    that the rows touch are replaced as a whole by the commit protocol."""
    cols = ["market"] if "market" in bars.columns else []
    out = bars.repartition(*cols, "instrument") if cols else bars.repartition("instrument")
    writer = out.sortWithinPartitions("instrument", "session").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*cols) if cols else writer).parquet(path)


def write_by_day(df: DataFrame, path: str, day: str = "session") -> None:
    """Partitioned into year, month and day folders."""
    out = df.withColumn("y", F.date_format(day, "yyyy")).withColumn("m", F.date_format(day, "MM")).withColumn("d", F.date_format(day, "dd"))
    out.write.mode("overwrite").partitionBy("y", "m", "d").parquet(path)


def write_csv(df: DataFrame, path: str, order: list | None = None, byte_order_mark: bool = False) -> None:
    """CSV with a header, range-partitioned by the order if one is given."""
    out = df.orderBy(*order) if order else df
    if byte_order_mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def sorted_signals(signals: DataFrame) -> DataFrame:
    """Newest day first, then by ticker; the day as text."""
    return signals.orderBy(F.desc("today"), "ticker").withColumn("today", F.date_format("today", "yyyy-MM-dd"))


def codes_in_names(files: DataFrame, name: str = "path", today: str | None = None, by: str | None = None) -> DataFrame:
    """Six-digit codes in brackets in file names, each once, in order of first position.

    ``files``: (pos, path). With ``today`` (yyyyMMdd), only names that hold it. With ``by``,
    each code once for each value of that column.
    """
    rows = files.where(F.col(name).contains(today)) if today else files
    keys = [by] if by else []
    found = rows.select("pos", *keys, F.regexp_extract(F.col(name), r"[\[\(](\d{6})[\]\)]", 1).alias("code")).where("code <> ''")
    return found.groupBy("code", *keys).agg(F.min("pos").alias("pos")).select("code", "pos")


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand: price is the unit price of a sale, volume the quantity sold."""
    sales = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    priced = sales.join(parts, sales.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("instrument"),
        F.to_date("l_shipdate").alias("session"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        "l_quantity",
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"),
    )
    market = F.when(F.pmod(F.regexp_extract("instrument", r"(\d+)$", 1).try_cast("int"), F.lit(2)) == 0, "even").otherwise("odd")
    return priced.groupBy("instrument", "session").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume")
    ).select("instrument", "session", market.alias("market"), "open", "high", "low", "close", "volume")


def instruments(bars: DataFrame) -> DataFrame:
    """The instrument dimension: name and market, codes padded."""
    return bars.groupBy("instrument").agg(F.first("market", ignorenulls=True).alias("stock_market")).select("instrument", F.concat(F.lit("stock "), "instrument").alias("stock_name"), F.lower("stock_market").alias("stock_market"))
