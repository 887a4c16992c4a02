"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Every document draws an exponential key -ln(u) / weight, where u follows from its id and a seed, and weight is its
quality. Within a source documents are sorted by key and their sizes are summed up along that order. A source's target
holds so many complete epochs, which take every document, and a fraction, which takes documents along the order until
the budget is reached; the document at the border counts with the words that fit.

Prefix sums do not gather a source: rows are dealt by ranges of (source, key), summed within each range, and the sums of
the ranges before, one row for each source and range, are added.

Targets: sources in code-point order, null last, weigh by a repeating list and share `share` times all sizes; a target
stops at `epochs` times its source's size and the excess is shared again by weight. Sorted by cap / weight, the sources
that stop form a prefix, so that one pass over prefix sums finds the level at which all hold.

Defined results: a null text has size 0; an empty source takes nothing; without any words all targets are 0; repeated
rows share a key and are told apart by nothing, so that equal rows may take different amounts but always the same
together; a null id draws like any other. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_name

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, EPOCHS = 1.5, 2
SEED = 17
WORD = "[^\\x20\\x09-\\x0D]+"


def uniform(*columns: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that follows from the columns: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def default_quality(size: Column, chars: Column) -> Column:
    """Weight 1 for texts whose words have a usual mean length, less for others: 0.25 to 1."""
    mean = F.coalesce(chars / F.nullif(size, F.lit(0)), F.lit(0.0))
    return F.when(mean.between(4, 9), F.lit(1.0)).when(mean.between(3, 12), F.lit(0.5)).otherwise(F.lit(0.25))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    # the level if this source and all that follow stay open; it holds for the first that doesn't reach its cap by it
    weighed = weighed.withColumn("level", (F.col("total") - F.col("spent")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("spent"), F.col("level")))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * level["level"], F.col("cap")))
    return weighed.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target and taken, the words the mix takes of each row with repeats counted."""
    return _mixed(docs, id_col, text_col, source_col, quality_col, weights, share, epochs, seed).drop("text_hash")


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """mix_sources with text_hash, which tells the rows of one id apart."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, chars = F.regexp_count(text, F.lit(WORD)).cast("long"), F.char_length(text)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), chars.alias("chars"), F.xxhash64(text).alias("text_hash"), *([F.col(quality_col).cast("double").alias("quality")] if quality_col else []))
    quality = F.greatest(F.coalesce(F.col("quality"), F.lit(1.0)), F.lit(1e-6)) if quality_col else default_quality(F.col("size"), F.col("chars"))
    slim = materialize(slim, "mix-sizes")  # dealing by ranges looks at its input twice; texts are read once
    drawn = slim.select("doc_id", "source", "size", "text_hash", (-F.ln(uniform(F.col("doc_id"), seed=seed)) / quality).alias("key"))
    order = ["source", "key", "doc_id", "size"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(drawn.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-ranges")

    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    targets = source_targets(ranged.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, epochs)
    targets = materialize(targets, "mix-targets").withColumnRenamed("source", "t")

    within = Window.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = summed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).join(targets, F.col("source").eqNullSafe(F.col("t")))
    start = F.col("start") + F.col("earlier")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    extra = F.when(whole < epochs, F.least(F.col("size"), F.greatest(budget - start, F.lit(0)))).otherwise(F.lit(0))
    return summed.select("doc_id", "text_hash", "source", "size", "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs, with all its columns, each row as often as the mix takes it; the document at a source's border stays if at
    least half of it fits. Texts without words, null ones too, hold nothing that could be taken and go. Rows with the same
    id and text are taken as often as the one that is taken most. An empty table gives no rows."""
    own, hashed, asked, times, copy = (own_name(x) for x in ("id", "hash", "asked", "times", "copy"))
    size = F.greatest("size", F.lit(1))
    mixed = _mixed(docs, id_col, text_col, source_col, **options).select(F.col("doc_id").alias(own), F.col("text_hash").alias(asked), F.floor((F.col("taken") + F.floor(size / 2)) / size).cast("int").alias(times))
    mixed = mixed.where(F.col(times) > 0).groupBy(own, asked).agg(F.max(times).alias(times))
    told = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    joined = told.join(mixed.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(asked)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
