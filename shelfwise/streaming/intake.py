"""Incremental intake: a stream of new files through the batch operators, stopped when nothing new is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.staging import drop, shared_dir, staged
from shelfwise.plans import intake, scoring
from shelfwise.streaming.versions import Table, VersionedStore

FILES = "path string, content string, pixels bigint, bitrate bigint"
LIBRARY = Table("key string, path string, target string, film_id bigint, pixels bigint, bitrate bigint", ("key",))
OUTCOMES = Table("path string, film_id bigint, confidence int, note string, target string, wanted bigint, outcome string, batch bigint", ("path",))
MOVES = Table("path string, batch bigint, place int, op string, source string, `to` string", ("path", "batch", "place"))


def classified(rows: DataFrame) -> DataFrame:
    """Each file with its class and whether it goes in by itself."""
    kind = scoring.duration_class(F.col("value"))
    return rows.select("event_id", "user_id", kind.alias("kind"), F.when(scoring.duration_severity(kind) == "ok", "auto").otherwise("review").alias("action"))


def take_in(spark: SparkSession, source: str, store: str | None = None, checkpoint: str | None = None, schema: str | None = None) -> DataFrame:
    """Reads what is new at `source` (a file or folder of Parquet) since the last call with the same `checkpoint`, and appends
    it, classified, to `store`; returns the store. A batch that is tried again replaces what it wrote before, so each file is
    in once. `schema` is needed where the folder holds no file yet; without any the store is empty."""
    store = store or f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    checkpoint = checkpoint or f"{store}-state"
    fields = spark.createDataFrame([], schema).schema if schema else spark.read.parquet(source).schema
    folder, _, name = source.rstrip("/").rpartition("/")
    single = name.endswith(".parquet")
    stream = spark.readStream.schema(fields)
    stream = stream.option("pathGlobFilter", name).parquet(folder) if single and _is_file(spark, source) else stream.parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        classified(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    kept = classified(spark.createDataFrame([], fields)).schema
    return spark.read.schema(kept).parquet(store) if _exists(spark, store) else spark.createDataFrame([], kept)


def film_store(spark: SparkSession, folder: str) -> VersionedStore:
    """The state of an intake: the library by target, the last outcome of each file, and the moves of all batches."""
    return VersionedStore(spark, folder, {"library": LIBRARY, "outcomes": OUTCOMES, "moves": MOVES})


def take_batch(store: VersionedStore, files: DataFrame, films: DataFrame, number: int, source: str = "intake", **options) -> bool:
    """One batch of files (FILES) into the store: planned against the library as earlier batches left it, and committed with the
    library after it. False, and nothing changes, if the batch is in. Of files of one path the first by its columns counts;
    files without a path are left out."""
    if store.committed(source, number):
        return False
    first = files.where("path is not null").select("path", F.struct("content", "pixels", "bitrate").alias("f")).groupBy("path").agg(F.min("f").alias("f")).select("path", "f.*")
    decided = staged(intake.planned(first, films, store.read("library"), **options).withColumn("batch", F.lit(number).cast("long")), "intake")
    gone_in = decided.where(F.col("outcome").isin("install", "replace"))
    rows = {
        "library": gone_in.select("key", "path", "target", F.col("film_id").cast("long"), "pixels", "bitrate"),
        "outcomes": decided.select("path", F.col("film_id").cast("long"), F.col("confidence").cast("int"), "note", "target", "wanted", "outcome", "batch"),
        "moves": intake.moves(decided).withColumn("batch", F.lit(number).cast("long")),
    }
    done = store.commit(source, number, rows)
    drop(decided)
    return done


def take_films(spark: SparkSession, source: str, films: DataFrame, folder: str | None = None, checkpoint: str | None = None, **options) -> VersionedStore:
    """Reads what is new in the folder `source` (Parquet, FILES) since the last call with the same `checkpoint` and takes it in,
    batch by batch; returns the store. A batch that died is tried again and is in once, with all or nothing of it."""
    folder = folder or f"{shared_dir(spark)}/films-{uuid.uuid4().hex}"
    store = film_store(spark, folder)
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", options.pop("files_at_once", 1000)).parquet(source)
    write = stream.writeStream.foreachBatch(lambda batch, number: take_batch(store, batch, films, number, **options) and None)
    write.option("checkpointLocation", checkpoint or f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return store


def _status(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    file, system = _status(spark, path)
    return system.exists(file)


def _is_file(spark: SparkSession, path: str) -> bool:
    file, system = _status(spark, path)
    return system.exists(file) and system.getFileStatus(file).isFile()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An extension: events by day and type, for batches and for streams, where rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
