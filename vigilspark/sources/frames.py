"""Frame sources and sinks: files with event time, sessions with error budgets, idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.functions import ids, scalars


def read_contract(spark: SparkSession, path: str, name: str, source: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Rows of a contract, and those that could not be read (JSON only; Parquet has its schema)."""
    if source == "json":
        schema = schemas.contract(name).add("_corrupt", "string")
        lines = spark.read.text(path).where("trim(value) <> ''")
        df = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
        return df.where("_corrupt is null").drop("_corrupt"), df.where("_corrupt is not null")
    return schemas.assert_contract(spark.read.parquet(path), name), spark.createDataFrame([], "_corrupt string")


def stream_contract(spark: SparkSession, path: str, name: str, source: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """A stream of a contract's rows; files_per_trigger bounds what waits between source and operators without loss."""
    return spark.readStream.schema(schemas.contract(name)).option("maxFilesPerTrigger", files_per_trigger).format(source).load(path)


def event_time(captured: Column, pts_seconds: Column, container: Column) -> Column:
    """Capture time plus presentation time, else the container's time; neither is an error of the row."""
    return F.coalesce(F.timestamp_micros(F.unix_micros(captured) + F.round(pts_seconds * 1e6).cast("long")), container)


def resolved_times(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = frames.withColumn("event_time", event_time(F.col("capture_time"), F.col("pts_seconds"), F.col("container_time")))
    return out.where("event_time is not null"), out.where("event_time is null").withColumn("error_code", F.lit("no_event_time"))


def newest(frames: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """A full queue that drops its oldest: the newest `most` frames of each session, and those dropped."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("arrival")))
    marked = frames.withColumn("_n", n)
    return marked.where(F.col("_n") <= most).drop("_n"), marked.where(F.col("_n") > most).drop("_n")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their parsed key, format and verdict; content beyond the header is not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_extract("path", "(tenants/.*)$", 1)
    parsed = scalars.parse_key(key)
    return files.select("path", "modificationTime", "length", parsed.alias("key"), F.substring("content", 1, 64).alias("header")).withColumn("format", scalars.media_format(F.col("header")))


def append_new(batch: DataFrame, path: str, key: str, order: str) -> int:
    """Append the batch's rows whose key the target lacks; a replay appends nothing. Returns their number.

    Of rows of one key the first by `order` counts; rows without a key are told apart by their content.
    """
    spark = batch.sparkSession
    text = F.to_json(F.struct(*sorted(batch.columns)))
    identity = F.coalesce(F.col(key).cast("string"), F.sha2(text, 256))
    turn = F.row_number().over(Window.partitionBy("_identity").orderBy(order, "_text"))
    first = batch.withColumns({"_identity": identity, "_text": text}).withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_text")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(conf).exists(p):
        first = first.join(spark.read.parquet(path).select(identity.alias("_identity")), "_identity", "left_anti")
    first = first.drop("_identity").persist()
    try:
        n = first.count()
        if n:
            first.write.mode("append").parquet(path)
        return n
    finally:
        first.unpersist()


def fact_rows(facts: DataFrame) -> DataFrame:
    """Facts as rows of the log: typed key columns, the rest as JSON, and the day they are partitioned by."""
    own = [c for c in facts.columns if c not in ("key", "event_time")]
    return facts.select(*(F.col(f"key.{c}").alias(c) for c in ("tenant_id", "venue_id", "session_id", "camera_id", "configuration_version_id", "track_id", "semantic_context")), "event_time", F.to_json(F.struct(*own)).alias("payload"), ids.utc_date(F.col("event_time")).alias("event_date"))


def event_rows(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Event rows: envelope fields as columns, payload as it is, and the scope of the fact (event_id, key) that made the event, never of its payload."""
    scope = facts.select("event_id", *(F.col(f"key.{c}").alias(c) for c in ("tenant_id", "venue_id", "session_id", "camera_id")))
    own = ("event_id", "event_type", "schema_version", "event_time", "produced_at", "correlation_id", "causation_id", "source", "payload")
    return events.select(*own).join(scope, "event_id")


def envelopes(events: DataFrame) -> DataFrame:
    """What a stream publishes of each event: its id and the envelope as compact JSON."""
    return events.select(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))
