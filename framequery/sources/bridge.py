"""Frames, detections, keyframe maps, tasks and texts as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames whose id is divisible by this are the queries of searches and tasks.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), (21 + F.col("label")).cast("string"), F.lit("_V001")).alias("video_id"), (F.col("vec_id") * 25).alias("frame_id"), F.floor(F.col("vec_id") / 10).cast("bigint").alias("shot_id"), "embedding")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection for each event, on the frame that the event's number falls on."""
    f = frames(spark, sf_dir).select(F.col("id").alias("fid"), "video_id", "frame_id")
    n = f.count()
    e = table(spark, sf_dir, "events")
    colour = F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("old")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.join(f, F.col("event_id") % F.lit(n) == F.col("fid")).select("video_id", F.col("frame_id").cast("string").alias("frame_id"), F.concat_ws(" ", "event_type", colour).alias("object"), (1 + F.col("event_id") % 4).cast("string").alias("quantity"), F.col("value").cast("string").alias("bbox_x"), *[F.lit("1").alias(f"bbox_{x}") for x in "ywh"], (F.col("event_id") + 2).alias("row_no"))


def keyframe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyframe 7 frames after each frame, numbered along the video by shots of descending length of id."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_id")).cast("bigint")
    return frames(spark, sf_dir).select("video_id", order.alias("n"), (F.col("frame_id") + 7).alias("frame_idx"), order.alias("file_order"))


def frame_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).drop("embedding")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("ocr_text"))
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("asr_text"))
    return f.join(d, "id", "left").join(c, "id", "left")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "embedding")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).where(F.col("id") % EVERY == 0)
    kind = F.element_at(F.array(F.lit("KIS"), F.lit("VQA"), F.lit("trake")), (F.floor(F.col("id") / EVERY) % 3 + 1).cast("int"))
    return f.select(F.col("id").cast("string").alias("task_id"), kind.alias("task_type"), F.col("id").alias("query_id"), F.col("video_id").alias("v"), F.col("shot_id").alias("s"))


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the task's video: those up to 20 shots away matter, those up to 5 more."""
    f = frames(spark, sf_dir).drop("embedding")
    apart = F.abs(F.col("shot_id") - F.col("s"))
    near = tasks(spark, sf_dir).join(f, (F.col("v") == F.col("video_id")) & (F.col("id") != F.col("query_id"))).where(apart <= 20)
    return near.select("task_id", "video_id", F.col("frame_id").cast("string").alias("frame_id"), F.when(apart <= 5, 2).otherwise(1).alias("relevance"))
