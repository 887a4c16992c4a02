"""Corpus building: the schema of frames, adjacent pairs of a video's frames and their duplicates, the frames that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions import vectors

DUPLICATE = 0.4
#: Numbers of a stored vector.
DIMENSION = 1024
#: The collection of frames; texts are indexed by retrieval.postings.
COLLECTION = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("video_id", T.StringType(), False),
        T.StructField("frame_id", T.LongType(), False),
        T.StructField("shot_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("ocr_text", T.StringType()),
        T.StructField("asr_text", T.StringType()),
    ]
)
#: The longest texts that the collection takes.
LONGEST = {"video_id": 255, "ocr_text": 65535, "asr_text": 65535}


def collection(frames: DataFrame, dimension: int | None = None) -> DataFrame:
    """frames with the columns and types of the collection; columns that they lack are null. Raises, when rows are read,
    for a text that is too long or a vector of another dimension."""
    has = {c.lower() for c in frames.columns}
    out = []
    for field in COLLECTION:
        value = F.col(field.name) if field.name in has else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in LONGEST:
            value = F.when(F.octet_length(value) > LONGEST[field.name], F.raise_error(F.lit(f"{field.name} is longer than {LONGEST[field.name]} bytes")).cast("string")).otherwise(value)
        if field.name == "embedding" and dimension:
            value = F.when(F.size(value) != dimension, F.raise_error(F.lit(f"embedding must have {dimension} numbers")).cast("array<float>")).otherwise(value)
        out.append(value.alias(field.name))
    return frames.select(*out)


def adjacent_pairs(frames: DataFrame) -> DataFrame:
    """(video_id, left_id, right_id, similarity): the 1st frame of a video with its 2nd, the 3rd with its 4th and so on."""
    order = Window.partitionBy("video_id").orderBy("frame_id")
    seen = frames.select("video_id", F.col("id").alias("left_id"), F.row_number().over(order).alias("n"), F.lead("id").over(order).alias("right_id"), F.col("embedding").alias("a"), F.lead("embedding").over(order).alias("b"))
    return seen.where("n % 2 = 1 and right_id is not null").select("video_id", "left_id", "right_id", vectors.cosine(vectors.as_vector(F.col("a")), vectors.as_vector(F.col("b"))).alias("similarity"))


def with_status(frames: DataFrame, limit: float = DUPLICATE) -> DataFrame:
    """frames with final_status: the right one of a pair above the limit is a DUPLICATE."""
    gone = adjacent_pairs(frames).where(F.col("similarity") > limit).select(F.col("right_id").alias("id"), F.lit("DUPLICATE").alias("final_status"))
    return frames.join(gone, "id", "left").withColumn("final_status", F.coalesce("final_status", F.lit("KEPT")))


def shots_of_frames(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """frames with the shot (video_id, shot_id, start, end; both ends included) that their number falls in; the earliest
    start where shots overlap, null where none fits. Shots of a video start in order, so each frame takes the last start."""
    order = Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    starts = shots.groupBy("video_id", F.col("start").alias("at")).agg(F.min(F.struct("shot_id", "end")).alias("shot"))
    line = starts.withColumn("kind", F.lit(0)).unionByName(frames.select("video_id", F.col("frame_id").alias("at")).distinct().withColumn("kind", F.lit(1)).withColumn("shot", F.lit(None).cast(starts.schema["shot"].dataType)))
    found = line.withColumn("last", F.last("shot", True).over(order)).where("kind = 1").select(F.col("video_id").alias("v"), F.col("at").alias("a"), F.when(F.col("last.end") >= F.col("at"), F.col("last.shot_id")).alias("shot_id"))
    return frames.drop("shot_id").join(found, (F.col("video_id") == F.col("v")) & (F.col("frame_id") == F.col("a")), "left").drop("v", "a")


def build_corpus(frames: DataFrame, shots: DataFrame | None = None, limit: float = DUPLICATE, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(collection of the frames that stay, statistics by video) of frames with vectors, and shots if these lack them."""
    told = with_status(frames if shots is None else shots_of_frames(frames, shots), limit)
    return collection(told.where("final_status = 'KEPT'"), dimension), dedup_stats(told)


def dedup_stats(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count_distinct("shot_id").alias("shots"), F.count("*").alias("frames"), F.count_if(F.col("final_status") == "KEPT").alias("kept"), F.count_if(F.col("final_status") == "DUPLICATE").alias("duplicates"))
