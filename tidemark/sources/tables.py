"""Readers and writers: time-ranged scans, CSV ingest, immutable artifacts, event views."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import CONTRACTS, Contract

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as trades: symbol, transact_time (ms), agg_trade_id, price, quantity, is_buyer_maker."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.floor(F.unix_micros(ts) / 1000).alias("transact_time"),
        F.col("event_id").alias("agg_trade_id"),
        F.col("value").alias("price"),
        (1 + F.get_json_object("props", "$.k").cast("long")).alias("quantity"),
        (F.col("event_id") % 2 == 0).alias("is_buyer_maker"),
    )


def scan(spark: SparkSession, root: str, contract: str | Contract, symbol: str | None = None, start: str | None = None, end: str | None = None, cast_prices: bool = True, folder: str = "day") -> DataFrame:
    """A table with a contract between two dates, both whole days; day (or month, yyyy-MM) and symbol folders are pruned.

    An empty or missing range is an empty frame with the contract's columns.
    """
    c = CONTRACTS[contract] if isinstance(contract, str) else contract
    fields = [*c.schema.fields, T.StructField("symbol", T.StringType()), T.StructField(folder, T.DateType() if folder == "day" else T.StringType())]
    fields = list({f.name: f for f in fields}.values())
    df = spark.read.schema(T.StructType(fields)).parquet(root)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    of = (lambda date: F.lit(date).cast("date")) if folder == "day" else (lambda date: F.lit(date[:7]))
    if start is not None:
        df = df.where(F.col(folder) >= of(start))
    if end is not None:
        df = df.where(F.col(folder) <= of(end))
    if dict(df.dtypes)[c.time] == "bigint" and (start or end):
        low = F.unix_millis(F.lit(start or "0001-01-01").cast("timestamp"))
        high = F.unix_millis(F.lit(end or "9999-12-30").cast("timestamp")) + DAY_MS - 1
        df = df.where(F.col(c.time).between(low, high))
    return df.withColumns({n: F.col(n).cast(t) for n, t in c.casts.items()}) if cast_prices and c.casts else df


def scan_bars(spark: SparkSession, root: str, contract: str | Contract, step: str | None = None, **where) -> DataFrame:
    """scan, and coarser bars where a step (``15m``, ``1h``, ...) above the contract's own is asked for; buckets that lack a bar go."""
    from ..operators.bars import STEPS, resample

    c = CONTRACTS[contract] if isinstance(contract, str) else contract
    df = scan(spark, root, c, **where)
    if step is None or STEPS[step] == c.step_ms:
        return df
    if c.step_ms is None or STEPS[step] % c.step_ms:
        raise ValueError(f"{c.name} cannot be resampled to {step}")
    return resample(df, STEPS[step], c.step_ms)


def split_months(spark: SparkSession, root: str, contract: str | Contract, to: str) -> None:
    """A table in month folders as one in day folders (of its time column), symbol by symbol."""
    c = CONTRACTS[contract] if isinstance(contract, str) else contract
    df = scan(spark, root, c, cast_prices=False, folder="month").drop("month")
    df.withColumn("day", F.to_date(F.timestamp_millis(c.time))).repartition("symbol", "day").sortWithinPartitions(c.time).write.partitionBy("symbol", "day").parquet(to)


def write_by_day(df: DataFrame, root: str, time: str = "close_time", mode: str = "errorifexists") -> None:
    """One folder for each UTC day of a time column in ms."""
    df.withColumn("day", F.to_date(F.timestamp_millis(time))).repartition("day").sortWithinPartitions(time).write.mode(mode).partitionBy("day").parquet(root)


def read_csv(spark: SparkSession, path: str, contract: str | Contract) -> DataFrame:
    """Text columns, then casts: strict for columns that must not be null, else null where they do not parse. A header row goes."""
    c = CONTRACTS[contract] if isinstance(contract, str) else contract
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in c.schema.fields])).csv(path)
    first = c.schema.fieldNames()[0]
    raw = raw.where(F.lower(F.trim(first)) != first.lower())

    def typed(f: T.StructField):
        if isinstance(f.dataType, T.BooleanType):
            return (F.lower(F.trim(f.name)) == "true").alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.col(f.name)
        return (F.col(f.name).cast(f.dataType) if f.name in c.non_null else F.col(f.name).try_cast(f.dataType)).alias(f.name)

    return raw.select(*[typed(f) for f in c.schema.fields])


def parse_create_time(column: str = "create_time"):
    return F.unix_millis(F.to_timestamp(column, "yyyy-MM-dd HH:mm:ss"))


def config_hash(config: dict, length: int = 16) -> str:
    """Of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:length]


def _folder(root: str, stage: str, config: dict, symbol: str, resolution: str) -> str:
    return f"{root.rstrip('/')}/{stage}/config_hash={config_hash(config)}/symbol={symbol}/resolution={resolution}"


def write_artifact(df: DataFrame, root: str, stage: str, config: dict, symbol: str, resolution: str, expected: T.StructType | None = None) -> str:
    """An immutable partition with its schema and configuration beside it; one that exists raises."""
    from ..operators.quality import schema_violations

    if expected is not None and (wrong := schema_violations(df, expected)):
        raise ValueError(f"the schema does not hold: {wrong}")
    path = _folder(root, stage, config, symbol, resolution)
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    about = spark.createDataFrame([(json.dumps(config, sort_keys=True), df.schema.json())], "config string, schema string")
    about.coalesce(1).write.mode("errorifexists").json(f"{root.rstrip('/')}/{stage}/_about/config_hash={config_hash(config)}/symbol={symbol}/resolution={resolution}")
    return path


def read_artifact(spark: SparkSession, root: str, stage: str, config: dict, symbol: str, resolution: str) -> DataFrame:
    """With the schema it was written with."""
    where = f"{root.rstrip('/')}/{stage}/_about/config_hash={config_hash(config)}/symbol={symbol}/resolution={resolution}"
    schema = T.StructType.fromJson(json.loads(spark.read.schema("config string, schema string").json(where).first().schema))
    return spark.read.schema(schema).parquet(_folder(root, stage, config, symbol, resolution))


def scan_artifacts(spark: SparkSession, root: str, stage: str, schema: T.StructType) -> DataFrame:
    """All partitions of a stage, with config_hash, symbol and resolution as columns to prune by."""
    keys = [T.StructField(k, T.StringType()) for k in ("config_hash", "symbol", "resolution")]
    return spark.read.schema(T.StructType([*schema.fields, *keys])).option("basePath", f"{root.rstrip('/')}/{stage}").parquet(f"{root.rstrip('/')}/{stage}/config_hash=*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def record_experiment(log: DataFrame, entry: DataFrame, key: str = "experiment_id") -> DataFrame:
    """The entry as the log's next row; columns that one side lacks are null."""
    following = log.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias(key))
    return log.unionByName(entry.crossJoin(F.broadcast(following)), allowMissingColumns=True)
