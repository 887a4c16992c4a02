"""Answers: submission of each task, ids, grouping of tracks, official rules, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

MAX_ROWS, MAX_ANSWER = 100, 100


def submit_kis(rows: DataFrame) -> DataFrame:
    """submission_id, ids, task and error of rows (id, frame_id, shot_id, video_id, task)."""
    name = scalars.first_filled(F.col("id"), scalars.fallback_id(F.col("video_id"), F.col("shot_id"), F.col("frame_id")))
    bad = name == "frame"
    return rows.select("row", F.when(~bad, name).alias("submission_id"), "frame_id", "shot_id", "video_id", F.upper(F.coalesce(scalars.filled(F.col("task")), F.lit("KIS"))).alias("task"), F.when(bad, F.lit("submit requires id, frameId/frame_id, shotId/shot_id, or videoId/video_id")).alias("error"))


def submit_vqa(rows: DataFrame) -> DataFrame:
    missing = lambda c: scalars.filled(F.col(c)).isNull()
    error = F.when(missing("video_id"), F.lit("submit_vqa requires video_id")).when(missing("frame_id"), F.lit("submit_vqa requires frame_id")).when(missing("answer"), F.lit("submit_vqa requires a non-empty answer"))
    return rows.select("row", "video_id", "frame_id", "answer", F.lit("VQA").alias("task"), error.alias("error"))


def submit_trake(rows: DataFrame) -> DataFrame:
    error = F.when(scalars.filled(F.col("video_id")).isNull(), F.lit("submit_trake requires video_id")).when(F.coalesce(F.size("frame_ids"), F.lit(0)) <= 0, F.lit("submit_trake requires at least one frame_id"))
    return rows.select("row", "video_id", "frame_ids", F.lit("TRAKE").alias("task"), error.alias("error"))


def submit_key(video: Column, frame: Column, shot: Column, row_id: Column) -> Column:
    v = F.coalesce(scalars.canonical_id(video), F.lit(""))
    tagged = lambda tag, c: F.concat(v, F.lit(f":{tag}:"), scalars.filled(scalars.canonical_id(c)))
    return F.coalesce(tagged("frame", frame), tagged("shot", shot), F.concat(F.lit("id:"), scalars.filled(scalars.canonical_id(row_id))), F.concat(v, F.lit(":missing")))


def has_identity(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | scalars.filled(c).isNotNull()
    return out


def quantity(c: Column) -> Column:
    n = scalars.whole_number(c)
    return F.when(n > 0, n).otherwise(F.lit(1).cast("bigint"))


def trake_groups(rows: DataFrame) -> DataFrame:
    """(video_id, frame_ids): a track for each video, its ids rising, each once; rows without an integer frame go."""
    typed = rows.select("video_id", scalars.whole_number(F.col("frame_id")).alias("f")).where("video_id <> '' and f is not null")
    return typed.groupBy("video_id").agg(F.array_sort(F.collect_set("f")).alias("frame_ids"))


def toggled(tray: DataFrame, toggles: DataFrame, key: str = "key") -> DataFrame:
    """Keys of the tray after toggling each key of toggles as often as it occurs."""
    turns = tray.select(key).distinct().unionByName(toggles.select(key))
    return turns.groupBy(key).count().where("count % 2 = 1").select(key)


def tray_order(tray: DataFrame) -> DataFrame:
    """Rows of a tray by frame number; what is no number counts as 0, and equal numbers go by the order of selection."""
    number = F.regexp_extract(F.trim(F.coalesce(F.col("frame_id").cast("string"), F.lit(""))), "^[+-]?[0-9]+", 0).try_cast("bigint")
    return tray.orderBy(F.coalesce(number, F.lit(0)), "pos")


def submission_violations(rows: DataFrame, kind: str, events: int = 0) -> DataFrame:
    """(query_name, row, rule) for rows (query_name, row, cells) of submission files that break an official rule."""
    cells = F.col("cells")
    integer = lambda c: F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))
    width = {"KIS": F.size(cells) == 2, "QA": F.size(cells) == 3, "TRAKE": (F.size(cells) == events + 1) if events else F.size(cells) >= 2}[kind]
    frames = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))) if kind == "TRAKE" else F.slice(cells, 2, 1)
    numbers = F.transform(frames, lambda x: x.try_cast("bigint"))
    rules = [("columns", ~width), ("video", F.coalesce(F.get(cells, F.lit(0)), F.lit("")) == ""), ("frame", F.exists(frames, lambda x: ~integer(x)) | (F.size(frames) < 1))]
    if kind == "QA":
        rules.append(("answer", ~F.coalesce(F.char_length(F.get(cells, F.lit(2))).between(1, MAX_ANSWER), F.lit(False))))
    if kind == "TRAKE":
        rules.append(("order", ~F.coalesce(numbers == F.array_sort(numbers), F.lit(False))))
    broken = rows.select("query_name", "row", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))).alias("rule"))
    long_ = rows.groupBy("query_name").agg(F.count("*").alias("n")).where(F.col("n") > MAX_ROWS).select("query_name", F.lit(None).cast("bigint").alias("row"), F.lit("rows").alias("rule"))
    return broken.unionByName(long_)


def csv_line(cells: Column) -> Column:
    """Cells with the least quoting that reads back."""
    return F.array_join(F.transform(cells, lambda x: F.when(x.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)), ",")
