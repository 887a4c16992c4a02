"""Readers: detections, keyframe maps, frame lookups, JSON lines, cases, images, fingerprints of file trees."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTION_COLUMNS = ("video_id", "frame_id", "object", "quantity", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
TASK_CARD = "task_id string, task_type variant, relevant_frames variant"
RANKING = "task_id string, results variant"
CASE = "case_id variant, task_type variant, query variant, relevant_frames variant, expected_answer string, answer_type string, expected_track variant, track_order variant, source variant, annotation_status string, review_required boolean, keyframe_number bigint"


def existing_file(path: str | Path | None, name: str, base: str | Path | None = None) -> Path | None:
    """The file of a setting; None if the setting is blank. A relative path is looked for below `base`, then below the
    working directory."""
    if path is None or not str(path).strip():
        return None
    given = Path(str(path).strip()).expanduser()
    places = [given] if given.is_absolute() else [(Path(base or ".") / given).resolve(), given.resolve()]
    found = next((p for p in places if p.exists()), places[0])
    if not found.exists():
        raise RuntimeError(f"{name} does not exist: {found}")
    if not found.is_file():
        raise RuntimeError(f"{name} is not a file: {found}")
    return found


def _text_columns(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with all columns as texts, trimmed names, without a byte-order mark."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", True).csv(path)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections with row_no, which counts from 2 as a file's lines do."""
    df = _text_columns(spark, path)
    if missing := [c for c in DETECTION_COLUMNS if c not in df.columns]:
        raise ValueError(f"objects.csv is missing required columns: {', '.join(missing)}")
    return df.select(*DETECTION_COLUMNS, (F.monotonically_increasing_id() + 2).alias("row_no"))


def read_keyframe_maps(spark: SparkSession, folder: str) -> DataFrame:
    """All maps of a folder; a file's name is its video."""
    df = _text_columns(spark, f"{folder.rstrip('/')}/*.csv").select("n", "frame_idx", F.col("_metadata.file_name").alias("file"))
    return df.select(F.regexp_replace("file", "\\.csv$", "").alias("video_id"), "n", "frame_idx", F.monotonically_increasing_id().alias("file_order"))


def read_frame_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, frame_id, shot_id); rows whose frame is no number go."""
    df = _text_columns(spark, path)
    return df.select("video_id", F.col("frame_id").try_cast("bigint").alias("frame_id"), "shot_id").where("frame_id is not null")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value) of the lines of text files; `at` rises along a file. A file's lines are read in splits, so numbers
    of lines take the lines of the splits before into account only where an error asks for one (line_number)."""
    return spark.read.text(path, recursiveFileLookup=Path(path).is_dir(), pathGlobFilter="*.jsonl" if Path(path).is_dir() else "*").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")


def _line_number(lines: DataFrame, file: str, at: int) -> int:
    return lines.where((F.col("file") == file) & (F.col("at") <= at)).count()


def _said_path(file: str) -> str:
    return unquote(urlsplit(file).path) if file.startswith("file:") else file


def _json_objects(lines: DataFrame) -> DataFrame:
    """lines that are not blank; ValueError for the first that holds no JSON object, by file and line."""
    full = lines.where("trim(value) <> ''")
    parsed = full.withColumn("kind", F.expr("schema_of_variant(try_parse_json(value))"))
    if bad := parsed.where("kind is null or not startswith(kind, 'OBJECT')").orderBy("file", "at").limit(1).collect():
        row = bad[0]
        place = f"{_said_path(row['file'])} at line {_line_number(lines, row['file'], row['at'])}"
        raise ValueError(f"invalid JSON in {place}" if row["kind"] is None else f"JSONL record in {place} must be an object")
    return full


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file. Blank lines are skipped; the first line that is no object is named in the error."""
    return _json_objects(_numbered_lines(spark, path)).select(F.from_json("value", schema).alias("x")).select("x.*")


def read_json_object(path: str | Path) -> dict:
    try:
        value = json.loads(Path(path).read_bytes())
    except json.JSONDecodeError as error:
        raise ValueError(f"invalid JSON in {path}") from error
    if not isinstance(value, dict):
        raise ValueError(f"metadata in {path} must be a JSON object")
    return value


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of all JSON-lines files below a folder in order of path and line, each with a unique id."""
    if not any(Path(folder).rglob("*.jsonl")):
        raise ValueError(f"no case files found under {folder}")
    lines = _numbered_lines(spark, folder)
    full = _json_objects(lines).select("file", "at", F.from_json("value", CASE).alias("x"))
    name = F.when(F.schema_of_variant(F.col("x.case_id")) == "STRING", F.try_variant_get(F.col("x.case_id"), "$", "string"))
    cases = full.select(F.col("file").alias("path"), F.col("at").alias("pos"), name.alias("case_id"), *[F.col(f"x.{c.strip().split()[0]}") for c in CASE.split(",")[1:]])
    if nameless := cases.where("coalesce(trim(case_id), '') = ''").orderBy("path", "pos").limit(1).collect():
        row = nameless[0]
        raise ValueError(f"{_said_path(row['path'])} line {_line_number(lines, row['path'], row['pos'])} requires a non-empty case_id")
    order = F.struct("path", "pos")
    if twice := cases.groupBy("case_id").agg(F.count("*").alias("n"), F.get(F.sort_array(F.collect_list(order)), F.lit(1)).alias("second")).where("n > 1").orderBy("second").limit(1).collect():
        raise ValueError(f"duplicate case_id {twice[0]['case_id']} in {_said_path(twice[0]['second']['path'])}")
    return cases


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")


def tree_fingerprint(spark: SparkSession, folder: str) -> str:
    """SHA-256 over relative paths and sizes, each followed by a zero byte, ordered by path segments; contents are not read."""
    if not Path(folder).is_dir():
        raise ValueError(f"keyframes directory not found: {folder}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    base = Path(folder).resolve().as_uri().removeprefix("file://")
    inner = F.ltrim(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(base), F.lit("")), F.lit("/"))
    sha = hashlib.sha256()
    for r in files.select(inner.alias("p"), "length").orderBy(F.split("p", "/")).toLocalIterator():
        sha.update(f"{unquote(r['p'])}\0{r['length']}\0".encode())
    return sha.hexdigest()
