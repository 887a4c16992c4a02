"""What the operators share: reading tables, durable intermediate tables, word hashes, rolling hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A task holds at most this many bytes of text at once besides the row that it works on.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder. Only where the
    master is local (tests) one of our own stands in."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/framequery-{context.applicationId}"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **observed: Column) -> DataFrame:
    """Writes df into the shared folder and reads it back: cuts the lineage and survives lost executors. Aggregates named
    in `observed` are taken along the write and are in the result's `observed`."""
    path, watch = fresh_path(df.sparkSession, name), Observation()
    plan = df.observe(watch, *[c.alias(k) for k, c in observed.items()]) if observed else df
    plan.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written, back.observed = path, watch.get if observed else {}
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize whose rows nothing needs any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def own_name(name: str) -> str:
    """A name for a column of our own beside all columns of the caller's table."""
    return f"__{name}_{uuid.uuid4().hex}"


#: A key of more than one in HOT of all rows is frequent, so at most HOT keys are.
HOT = 2_000


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled whatever its size: Spark broadcasts tables of up to 10 MB as they are
    compressed, which become many times that in the driver's memory, and all of a plan's tables at once."""
    return df.hint("merge")


def join_frequent(many: DataFrame, few: DataFrame, keys: list[str], total: int, times: str = "times", wide: bool = False) -> DataFrame:
    """many joined with few on keys. few has one row for each key, and in `times` how many of the `total` rows of many
    have it. Frequent keys, HOT at most, go by broadcast, so that the rows of a key that a third of all rows share stay in
    the tasks where they are; the others are shuffled, however small they are if `wide`."""
    often = F.col(times) * HOT > total
    hot = few.where(often)
    there = many.join(F.broadcast(hot), keys)
    far = few.where(~often)
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(spread(far) if wide else far, keys)
    return there.unionByName(rest)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_BYTES, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    for x in column.cast(pa.large_binary() if large else pa.binary()):
        yield x.as_py() or b""


class Memo(dict):
    """word -> value of a pure function, emptied when it holds `limit` words, so that memory stays bounded."""

    def __init__(self, f: Callable[[bytes], object], limit: int = 1 << 19):
        super().__init__()
        self.f, self.limit = f, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.f(word)
        return value


def word_hashes(memo: Memo, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def hash_memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


#: An odd multiplier for each rolling hash; arithmetic is modulo 2**64.
ROLL_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of all runs of k consecutive words, O(1) for each word whatever k is."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.inverse, np.uint64)]), dtype=np.uint64)

    def __call__(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h)
        if n < k:
            return np.empty(0, np.uint64)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.up[:n], out=total[1:], dtype=np.uint64)
        return mix((total[k:] - total[:-k]) * self.down[: n - k + 1])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table() -> bytes:
    """Byte table that lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


def join_spread(many: DataFrame, few: DataFrame, keys: list[str], total: int, times: str = "times", how: str = "inner", small: bool = False) -> DataFrame:
    """As join_frequent (or a left join), for rows that are costly to compute: many is read once, and rows of frequent
    keys, whose partners come by broadcast, are dealt over all tasks by a salt instead of by their key. If `small`, a
    task's share of few fits in its memory, so that many isn't sorted."""
    salt, found = own_name("salt"), own_name("found")
    values = [c for c in few.columns if c not in keys]
    sides = [few.select(*keys, F.struct(*values).alias(own_name("hot"))) for _ in range(2)]
    hot, rest = (side.columns[-1] for side in sides)
    near = sides[0].where(F.col(f"{hot}.{times}") * HOT > total)
    far = sides[1].where(F.col(f"{rest}.{times}") * HOT <= total).withColumn(salt, F.lit(0).cast("long"))
    told = many.join(F.broadcast(near), keys, "left")
    told = told.withColumn(salt, F.when(F.col(hot).isNull(), F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id()))
    far = far.hint("shuffle_hash") if small else far
    both = told.join(far, [*keys, salt], "left").withColumn(found, F.coalesce(hot, rest))
    both = both.where(F.col(found).isNotNull()) if how == "inner" else both
    return both.select(*many.columns, *[F.col(found)[c].alias(c) for c in values])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component.

    Every node takes the smallest of itself and its neighbours, and these steps are followed to their ends. The edges that
    are left between different ends, each once, are the edges of the next level; the others are not read again. The
    smallest node of a component is an end at every level. No level gathers a component: all steps are partial aggregations
    and joins of slim rows, both sides straight from an exchange, which adaptive execution splits where a node has very
    many edges. No join has more rows than there are edges.
    """
    count = {"rows": F.count(F.lit(1))}

    def once(pairs: DataFrame) -> DataFrame:
        """Each edge between two nodes once; one node to itself is none."""
        return materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges", **count)

    edges = once(edges.select("a", "b"))
    table = None
    while table is None or edges.observed["rows"]:
        low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        low = low.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")))
        level = materialize(low.groupBy("node").agg(F.min("root").alias("root")), f"{name}-labels")
        moved = edges.observed["rows"]
        while moved:
            via = level.select(F.col("node").alias("root"), F.col("root").alias("via"))
            hop = level.join(via, "root").select("node", F.col("via").alias("root"), F.col("root").alias("was"))
            hop = materialize(hop, f"{name}-labels", moved=F.count_if(F.col("root") != F.col("was")))
            discard(level)
            level, moved = hop.drop("was"), hop.observed["moved"]
            level._written = hop._written
        first = edges.join(level.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ends = first.join(level.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = once(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        discard(edges)
        edges = left
        if table is None:
            table = level
            continue
        up = level.select(F.col("node").alias("root"), F.col("root").alias("up"))
        joined = materialize(table.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels")
        discard(table, level)
        table = joined
    discard(edges)
    return table.select("node", "root")
