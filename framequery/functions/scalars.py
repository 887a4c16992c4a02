"""Column expressions for texts, ids, numbers and paths. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = "[^\\p{L}\\p{N}_]+"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def label(c: Column) -> Column:
    return F.lower(stripped(c))


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def first_of(c: Column) -> Column:
    """The first element of an array column, null for an empty one."""
    return F.get(c, F.lit(0))


def plain_number(c: Column) -> Column:
    """The text of a number as it is shown: without a fraction where there is none."""
    number = real_number(c)
    whole = number == F.floor(number)
    return F.when(whole & (F.abs(number) < 2.0**63), number.try_cast("bigint").cast("string")).when(number.isNotNull(), number.cast("string"))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda x: x != "")


def whole_number(c: Column) -> Column:
    """The integer that a text spells, else null: fractions in texts are no integers. Numbers are cut; a number that is
    none, or infinite, gives null."""
    text = stripped(c.cast("string"))
    spelt = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    real = c.try_cast("double")
    cut = F.when(F.abs(real) < 2.0**63, real.try_cast("bigint"))
    kind = F.typeof(c)  # folded before the plan runs
    return F.when(kind.isin("double", "float") | kind.startswith("decimal"), cut).when(kind == "boolean", c.try_cast("bigint")).otherwise(spelt)


def real_number(c: Column) -> Column:
    return stripped(c.cast("string")).try_cast("double")


def count_of(c: Column) -> Column:
    """An amount: at least 1, and 1 for whatever is no integer."""
    return F.greatest(F.coalesce(whole_number(c), F.lit(1)), F.lit(1)).cast("bigint")


def canonical_id(c: Column) -> Column:
    """Digits without leading zeros; other texts as they are, without white space around."""
    text = stripped(c.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text)


def path_parts(path: Column) -> Column:
    """struct(path, video_id, frame_id, shot_id) of `.../keyframes/<video>/<shot>/<frame>.ext` or `.../<video>/<frame>.ext`.

    Scheme, host, query, fragment and the last part's parameters are left aside.
    """
    value = stripped(F.coalesce(path.cast("string"), F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(value, "[?#].*$", ""), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    inner = F.regexp_replace(inner, ";[^/]*$", "")
    parts = F.filter(F.split(inner, "/"), lambda x: x != "")
    n = F.size(parts)
    at = lambda k: F.try_element_at(parts, F.lit(-k))
    deep = (n >= 4) & (at(4) == "keyframes")
    some = value != ""
    return F.struct(
        value.alias("path"),
        F.when(some & deep, at(3)).when(some & (n >= 2), at(2)).alias("video_id"),
        F.when(some, F.regexp_replace(at(1), "\\.[^.]*$", "")).alias("frame_id"),
        F.when(some & deep, at(2)).alias("shot_id"),
    )


def title(video_id: Column, frame_id: Column) -> Column:
    frame = frame_id.cast("string")
    return F.when(frame.isNull(), F.lit("Retrieved frame")).when(filled(video_id).isNull(), F.concat(F.lit("Frame "), frame)).otherwise(F.concat(video_id, F.lit(" frame "), frame))


def fallback_id(*parts: Column) -> Column:
    return F.coalesce(filled(F.concat_ws(":", *[filled(p) for p in parts])), F.lit("frame"))


def padded(number: Column) -> Column:
    """Three digits at least, more where the number has them."""
    text = number.cast("string")
    return F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0"))


def thumbnail(template: str, video_id: Column, shot_id: Column, frame_id: Column, keyframe: Column) -> Column:
    """The template filled in; empty if it needs a keyframe number and there is none."""
    out: Column = F.lit(template)
    for name, value in (("video_id", video_id), ("shot_id", shot_id), ("frame_id", frame_id), ("keyframe_number:03d", padded(keyframe)), ("keyframe_number", padded(keyframe))):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.when(keyframe.isNull(), F.lit("")).otherwise(out) if "{keyframe_number" in template else out


def joined_url(base: str, path: Column) -> Column:
    """Absolute addresses stay; other paths go below the base."""
    rest = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))
    return F.when(path.isNull() | (path == ""), F.lit("")).when(path.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//|^data:"), path).otherwise(rest)
