"""Streaming counterparts: a running confusion, a manifest kept current, last clicks of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from arterial.operators.raster import confusion_columns, ratios
from arterial.operators.tiles import keep_last, split

MODES = ("flood", "source", "target")


def running_confusion(pixels: DataFrame) -> DataFrame:
    """Confusion by terrain of a stream (terrain, t, p); use output mode complete or update."""
    return ratios(pixels.groupBy("terrain").agg(*confusion_columns()))


def upsert_manifest(stream: DataFrame, path: str, checkpoint: str, resplit: bool = False, keep: int = 2) -> StreamingQuery:
    """Keep the last row per tile_id in versioned Parquet tables under path; a batch that runs twice gives the same version.
    resplit: assign splits anew over all rows each time. Of older versions the last `keep` stay."""
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("ingest_seq", F.lit(epoch + 1).cast("long"))
        if epoch:
            new = spark.read.parquet(f"{path}/v{epoch - 1}").unionByName(new)
        last = keep_last(new)
        (split(last) if resplit else last).select(*new.columns).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{epoch - keep}")
        if epoch >= keep:
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_clicks(clicks: DataFrame) -> DataFrame:
    """The last click of each session and mode of a stream (session, mode, x, y, at). A click of mode 'reset' clears its
    session: modes whose last click is older have a null place."""
    last = clicks.groupBy("session").agg(
        F.max(F.when(F.col("mode") == "reset", F.col("at"))).alias("reset"),
        *[F.max_by(F.struct("x", "y"), F.when(F.col("mode") == m, F.col("at"))).alias(m) for m in MODES], *[F.max(F.when(F.col("mode") == m, F.col("at"))).alias(f"{m}_at") for m in MODES])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("place"), F.col(f"{m}_at").alias("at")) for m in MODES]))
    rows = last.select("session", "reset", each.alias("c")).where("c.at is not null")
    stays = F.col("reset").isNull() | (F.col("c.at") > F.col("reset"))
    return rows.select("session", "c.mode", F.when(stays, F.col("c.place")).alias("place"), "c.at")


def best_so_far(epochs: DataFrame) -> DataFrame:
    """The epoch with the best score; of equal ones the first. epochs: (run, epoch, score)."""
    return epochs.groupBy("run").agg(F.max(F.struct("score", (-F.col("epoch")).alias("e"))).alias("m")).select("run", (-F.col("m.e")).alias("epoch"), F.col("m.score").alias("score"))


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Loss of each epoch over batches (run, epoch, loss, n), weighted by batch size."""
    return batches.groupBy("run", "epoch").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
