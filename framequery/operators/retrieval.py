"""Vector top-k, filtered and staged retrieval, fusion of scored lists, BM25."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vectors

#: Order of equal scores.
TIES = ("video_id", "frame_id")
#: Shots beyond the anchor that a stage may still use, besides the number of stages that remain.
SLACK = 2
#: Bytes of query vectors that go to the executors at once; the frames are read once for so many.
BLOCK_BYTES = 64 << 20


def top_k(frames: DataFrame, vector: Sequence[float] | Column, k: int, metric: str = "cosine") -> DataFrame:
    """The k best frames with distance and retrieval_rank; a sort-limit on the executors, ranks on k rows. Frames without
    an embedding are not found."""
    score = {"cosine": vectors.cosine, "inner": vectors.inner}[metric]
    scored = frames.where(F.col("embedding").isNotNull()).withColumn("distance", score(vectors.as_vector(F.col("embedding")), vectors.as_vector(vector))).drop("embedding")
    order = [F.col("distance").desc(), *TIES]
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("retrieval_rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # over k rows


def top_k_batch(frames: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, video_id, frame_id, distance, retrieval_rank) for all queries (query_id, embedding).

    Query vectors are broadcast in blocks of BLOCK_BYTES; the driver holds one block at a time, and frames are read once
    for each. A batch of frames is one matrix product; a task keeps the k best of each query over all its batches, and a
    window over those rows ranks the rest. Frames and queries without an embedding are left aside.
    """
    out, block, size = None, [], 0
    for r in queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").orderBy("query_id").toLocalIterator():
        block.append((r["query_id"], r["embedding"]))
        size += 8 * len(r["embedding"])
        if size >= BLOCK_BYTES:
            part = _block(frames, block, k)
            out, block, size = (part if out is None else out.unionByName(part)), [], 0
    if block or out is None:
        part = _block(frames, block, k)
        out = part if out is None else out.unionByName(part)
    ranked = Window.partitionBy("query_id").orderBy(F.col("distance").desc(), *TIES)
    return out.withColumn("retrieval_rank", F.row_number().over(ranked).cast("bigint")).where(F.col("retrieval_rank") <= k)


def _best(query: np.ndarray, score: np.ndarray, n_queries: int, k: int) -> np.ndarray:
    """Places of the rows that score at least as much as the k-th best of their query: ties are settled by the window."""
    order = np.lexsort((-score, query))
    start = np.searchsorted(query[order], np.arange(n_queries))
    last = np.minimum(start + k, np.append(start[1:], len(query))) - 1
    floor = np.full(n_queries, -np.inf)
    some = last >= start
    floor[some] = score[order][last[some]]
    return np.flatnonzero(score >= floor[query])


def _block(frames: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    ids = np.array([q for q, _ in queries], np.int64)
    q = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), vectors.EPSILON)
    asked = frames.sparkSession.sparkContext.broadcast((ids, q))  # BLOCK_BYTES, about
    names = ("id", "video_id", "frame_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = asked.value
        held = None
        for pdf in batches:
            if pdf.empty or not len(ids):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vectors.EPSILON)).T
            least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            row, col = np.nonzero(s >= least[:, None])
            found = pd.DataFrame({"q": row, **{c: pdf[c].to_numpy()[col] for c in names}, "distance": s[row, col]})
            held = found if held is None else pd.concat([held, found], ignore_index=True)
            if len(held) > 4 * k * len(ids):
                held = held.iloc[_best(held["q"].to_numpy(), held["distance"].to_numpy(), len(ids), k)]
        if held is not None:
            held = held.iloc[_best(held["q"].to_numpy(), held["distance"].to_numpy(), len(ids), k)]
            yield pd.DataFrame({"query_id": ids[held["q"].to_numpy()], **{c: held[c].to_numpy() for c in (*names, "distance")}})

    picked = frames.select(*names, "embedding").where(F.col("embedding").isNotNull())
    return picked.mapInPandas(run, "query_id long, id long, video_id string, frame_id long, distance double")


def top_k_within(frames: DataFrame, queries: DataFrame, context: DataFrame, k: int, slack: int = SLACK) -> DataFrame:
    """top_k_batch for a later stage: each of queries (query_id, remaining, embedding) looks at the frames that its own
    context (query_id, video_id, shot_id) admits. Frames meet queries by video and shot, never all of them."""
    anchors = context.select("query_id", "video_id", scalars.whole_number(F.col("shot_id")).alias("s")).where("video_id <> '' and s is not null")
    shots = anchors.join(queries.select("query_id", "remaining"), "query_id")
    shots = shots.select("query_id", "video_id", F.explode(F.sequence("s", F.col("s") + F.col("remaining") + slack)).alias("shot_id")).distinct()
    met = frames.select("id", "video_id", "frame_id", "shot_id", "embedding").where(F.col("embedding").isNotNull()).join(shots, ["video_id", "shot_id"])
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    scored = met.join(asked, "query_id").select("query_id", "id", "video_id", "frame_id", vectors.cosine(vectors.as_vector(F.col("embedding")), F.col("q")).alias("distance"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("distance").desc(), *TIES)
    return scored.withColumn("retrieval_rank", F.row_number().over(ranked).cast("bigint")).where(F.col("retrieval_rank") <= k)


def within_context(frames: DataFrame, context: DataFrame, remaining: int, slack: int = SLACK) -> DataFrame:
    """Frames of a context's videos whose shot lies in [anchor, anchor + remaining + slack] of some anchor (forward only).

    Anchors whose shot is no integer are left aside. The semi-join is by video with the shots as residual; anchors are
    reduced to distinct pairs before.
    """
    anchors = context.select(F.col("video_id").alias("v"), scalars.whole_number(F.col("shot_id")).alias("s")).where("v <> '' and s is not null").distinct()
    return frames.join(anchors, (F.col("video_id") == F.col("v")) & F.col("shot_id").between(F.col("s"), F.col("s") + remaining + slack), "left_semi")


def context_shots(context: DataFrame, remaining: int, slack: int = SLACK) -> DataFrame:
    """(video_id, shot_id): the shots that a context admits."""
    anchors = context.select("video_id", scalars.whole_number(F.col("shot_id")).alias("s")).where("video_id <> '' and s is not null").distinct()
    return anchors.select("video_id", F.explode(F.sequence("s", F.col("s") + remaining + slack)).alias("shot_id")).distinct()


def staged(frames: DataFrame, stage_vectors: list[Sequence[float]], k: int, context: DataFrame | None = None, done: int = 0) -> DataFrame:
    """Rows of the last stage. Each stage searches the shots that the one before leaves; scores are not added up."""
    total = len(stage_vectors)
    if context is None:
        context, done = top_k(frames, stage_vectors[0], k), 1
    for stage in range(done, total):
        context = top_k(within_context(frames, context, total - stage), stage_vectors[stage], k)
    return context


def _weights(n: int, weights: Sequence[float]) -> list[float]:
    """A weight for each of n lists; missing ones repeat the last."""
    given = [float(w) for w in weights] or [1.0]
    if len(given) > n:
        raise ValueError(f"{len(given)} weights for {n} lists")
    return given + given[-1:] * (n - len(given))


def fuse(lists: list[DataFrame], weights: Sequence[float], k: int, key: str = "id") -> DataFrame:
    """Weighted sum of scored lists (key, score) from different sources, each a search's hits."""
    all_ = None
    for df, w in zip(lists, _weights(len(lists), weights), strict=True):
        part = df.select(key, (F.col("score") * F.lit(w)).alias("score"))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy(key).agg(F.sum("score").alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def fuse_scores(frames: DataFrame, scores: list[Column], weights: Sequence[float], k: int, key: str = "id") -> DataFrame:
    """Weighted sum of several scores of one source with unique keys: one scan and a sort-limit, no shuffle of all rows."""
    total = F.lit(0.0)
    for score, w in zip(scores, _weights(len(scores), weights), strict=True):
        total = total + score * F.lit(w)
    return frames.select(key, total.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


K1, B = 1.8, 0.75
#: Words that the English analyser leaves out.
ENGLISH_STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()


def analysed(text: Column, language: Column | None = None) -> Column:
    """The terms of a text: words in lower case without punctuation. Texts whose language is `en` lose stop words, and
    plural endings (ies, es and s, by Harman's rules); other languages keep all words as they are."""
    words = scalars.tokens(F.coalesce(text.cast("string"), F.lit("")))
    if language is None:
        return words
    plain = F.filter(words, lambda w: ~w.isin(*ENGLISH_STOP_WORDS))
    stem = lambda w: F.when(w.rlike("(?<![ae])ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(?<![aeo])es$"), F.regexp_replace(w, "es$", "e")).when(w.rlike("[^us]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.when(F.lower(language) == "en", F.transform(plain, stem)).otherwise(words)


def postings(texts: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """(key, term, tf, dl): an index of the terms of a text column, to be written once and read by many searches. dl is
    the text's number of terms; a text without terms has one row with a null term, so that the lengths are complete."""
    words = texts.select(key, analysed(F.col(text), F.col(language) if language else None).alias("w"))
    rows = words.select(key, F.size("w").alias("dl"), F.explode_outer("w").alias("term"))
    return rows.groupBy(key, "term", "dl").agg(F.count("term").alias("tf"))


def bm25_batch(index: DataFrame, queries: DataFrame, key: str, k: int, k1: float = K1, b: float = B, language: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best texts for each of queries (query_id, query), from postings. Only postings
    of the queries' terms are read beyond the lengths."""
    lengths = index.groupBy(key).agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", F.explode(F.array_distinct(analysed(F.col("query"), F.lit(language) if language else None))).alias("term"))
    found = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = found.join(df, "term").join(F.broadcast(lengths))  # lengths is one row
    f, d, n = F.col("tf"), F.col("df"), F.col("n")
    score = F.ln(1 + (n - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighed.select("term", key, score.alias("score")).join(asked, "term").groupBy("query_id", key).agg(F.sum("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(ranked).cast("bigint")).where(F.col("rank") <= k)


def bm25(texts: DataFrame, key: str, text: str, query: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best texts of one query, without an index: lengths and counts of the query's terms are dealt once, and both
    the statistics and the scores read them."""
    terms = sorted({t for t in re.split(r"[^\w]+", query.lower()) if t})
    words = texts.select(key, analysed(F.col(text)).alias("w"))
    times = lambda t: F.size(F.filter("w", lambda x: x == t))
    tf = [times(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = words.select(key, F.size("w").alias("dl"), *tf).repartition(F.col(key))  # texts are read once: the exchange is reused
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.join(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.ln(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # a filter on the scores, not on the counts, which would be moved below the exchange and keep it from being reused
    return joined.select(key, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(k)
