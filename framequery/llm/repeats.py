"""Substring dedup by seed and extend, without pairs of documents.

1. Seeds: every document is winnowed: of each WINNOW consecutive hashes of SEED words the least is an anchor. Two equal
   runs of SEED + WINNOW - 1 = min_words words always share an anchor at the same place of the run.
2. Join on anchors: each anchor meets its smallest and largest document id. Anchors of one document only end here, and
   with them most of the corpus. A passage that a third of all documents share is one key of a partial aggregation,
   never a list of its documents.
3. Extension: from each shared anchor the document is extended word by word to the left and to the right, as far as
   min_words reach. An extension is not compared with one partner's text: the smallest document that shares an anchor need
   not be the one that shares most words around it, and to try all would be pairs. Each step's run of min_words words is
   looked up by its 128-bit hash among the steps of all documents at once, which gives the smallest document in which it
   starts. Consecutive runs that an earlier document has form the maximal repeats.
4. The words of the maximal repeats are removed.

Exact copies of a whole text are settled by the text's digest, so that only one of them is extended. Frequent anchors,
copies and runs are joined by broadcast, so that none of them is one task's.

Words are runs of `[^\\x20\\x09-\\x0D]`, unchanged. Defined results: a null text has no words and keeps nothing; texts of
fewer than min_words words keep all; of rows with one id and text each is judged alike, since only smaller ids count;
rows with a null id come first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLL_BASES, Rolling, discard, hash_memo, join_frequent, join_spread, map_arrow, materialize, mix, utf8, word_hashes

MIN_WORDS = 50
#: Words of a seed. Winnowing looks at MIN_WORDS - SEED + 1 seeds at a time.
SEED = 12
#: Stands for a null id; smaller than any id.
NO_ID = -(1 << 63)


def window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive numbers, by doubling."""
    span, out = 1, h
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (w - span)], out[w - span :]) if w > span else out


def anchors(h: np.ndarray, roll: Rolling, seed: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed seeds: every place whose hash is the least of some window of w seeds."""
    seeds = roll(h, seed)
    if len(seeds) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = window_minimum(seeds, w)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    best = ~window_minimum(~padded, w)  # the largest of the minima of the windows that hold a place
    at = np.flatnonzero(seeds == best)
    return at, seeds[at]


def maximal(at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Windows of `size` words that start at the sorted places `at`, joined where they touch."""
    apart = np.flatnonzero(np.diff(at) > size)
    return list(zip(at[np.concatenate([[0], apart + 1])].tolist(), (at[np.concatenate([apart, [len(at) - 1]])] + size).tolist(), strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_sha256, repeats (the removed stretches of words
    [start, stop)) and, unless with_text is false, kept (the words that stay, joined by one space)."""
    w = min_words - seed + 1
    # a text's hash tells the texts of one id apart, and spreads the rows without one
    picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    rows = F.count(F.lit(1))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, roll = hash_memo(), Rolling(ROLL_BASES[0])
        for batch in batches:
            ids, ths, digests, at, hs = [], [], [], [], []
            for doc, text, th in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if len(words) < min_words:
                    continue
                places, found = anchors(word_hashes(memo, words), roll, seed, w)
                ids.append(doc)
                ths.append(th)
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                at.append(places.astype(np.int32))
                hs.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(digests, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(hs, pa.list_(pa.int64()))], names=["doc_id", "th", "digest", "places", "hashes"])

    long_texts = materialize(map_arrow(picked, first_pass, "doc_id long, th long, digest binary, places array<int>, hashes array<long>"), "winnowed", rows=rows)
    # of equal texts the smallest id stands for all: the others' windows all start in it
    firsts = materialize(long_texts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("times")), "first-of-copies")
    later = join_frequent(long_texts.select("doc_id", "th", "digest"), firsts.where("first_id < last_id"), ["digest"], long_texts.observed["rows"])
    later = materialize(later.where("doc_id > first_id").select("doc_id", "th").distinct(), "later-copies")
    seeds = long_texts.join(later.hint("shuffle_hash"), ["doc_id", "th"], "left_anti").select("doc_id", "th", F.explode(F.arrays_zip("places", "hashes")).alias("x"))
    seeds = materialize(seeds.select("doc_id", "th", F.col("x.places").alias("place"), F.col("x.hashes").alias("h")), "seeds", rows=rows)
    shared = seeds.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times")).where("low < high").select("h", "times")
    shared = materialize(shared, "shared-hashes")
    around = join_frequent(seeds, shared, ["h"], seeds.observed["rows"]).groupBy("doc_id", "th").agg(F.collect_set("place").alias("places"))
    around = materialize(around, "shared-seeds", anchors=F.sum(F.size("places")))
    discard(long_texts, firsts, seeds, shared)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        rolls = [Rolling(b) for b in ROLL_BASES]
        for batch in batches:
            ids, ths, starts, one, two = [], [], [], [], []
            for doc, text, th, places in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.split()
                at = places.values.to_numpy(zero_copy_only=False)
                n = len(words) - min_words + 1
                # the windows that hold the seed at p start between p - (min_words - seed) and p
                depth = np.zeros(n + 1, np.int32)
                np.add.at(depth, np.maximum(at - (min_words - seed), 0), 1)
                np.add.at(depth, np.minimum(at + 1, n), -1)
                start = np.flatnonzero(np.cumsum(depth[:n]) > 0)
                h = word_hashes(memo, words)
                ids.append(np.full(len(start), doc, np.int64))
                ths.append(np.full(len(start), th, np.int64))
                starts.append(start.astype(np.int32))
                one.append(rolls[0](h, min_words)[start])
                two.append(rolls[1](mix(h), min_words)[start])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(ths)), pa.array(np.concatenate(starts)), _signed(np.concatenate(one)), _signed(np.concatenate(two))], names=["doc_id", "th", "place", "h1", "h2"])

    # from here on one plan: both joins with the texts are by id and hash, and share one exchange of them
    texts = picked.join(around.hint("shuffle_hash"), ["doc_id", "th"])
    windows = map_arrow(texts.select("doc_id", "text", "th", "places"), extend, "doc_id long, th long, place int, h1 long, h2 long")
    earliest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times")).where("low < high").drop("high")
    # as many windows as there can be around the shared anchors
    most = (around.observed["anchors"] or 0) * w
    hits = join_spread(windows, earliest, ["h1", "h2"], most).where("low < doc_id").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("place")).alias("hits"))
    marks = hits.unionByName(later.withColumn("hits", F.lit(None).cast("array<int>"))).withColumn("marked", F.lit(True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, removed, digests, kept, repeats = [], [], [], [], [], []
            for doc, text, marked, hits in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.split()
                spans: list[tuple[int, int]] = []
                if marked:
                    spans = maximal(hits.values.to_numpy(zero_copy_only=False), min_words) if hits.is_valid else [(0, len(words))]
                left, last = [], 0
                for a, b in spans:
                    left += words[last:a]
                    last = b
                left = left + words[last:] if spans else words
                stays = b" ".join(left)
                ids.append(None if doc == NO_ID else doc)
                ns.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(stays).hexdigest())
                repeats.append([{"start": a, "stop": b} for a, b in spans])
                if with_text:
                    kept.append(stays.decode("utf-8", "replace"))
            out = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.string())] if with_text else out, names=[*names, "kept"] if with_text else names)

    joined = picked.join(marks.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "marked", "hits")
    return map_arrow(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,stop:int>>" + ", kept string" * with_text)
