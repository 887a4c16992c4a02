"""Quality rules whose cutoffs follow the data: quantile sketches per language and source instead of fixed numbers.

Texts are measured once; the measures of each (language, source) are summarised by Spark's mergeable quantile
sketches (partial sketches per task, merged after the shuffle, so a hot source costs no hot task); a group's quantiles
are blended with those of its language, and these with the corpus, by the number of documents. The cutoffs are then joined back and documents
outside them are dropped.

Words are runs of `[^\\x20\\x09-\\x0D]`. Defined results: a null text is empty, has no words and fails; null language or
source form groups of their own; repeated rows each get their row and each count. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLL_BASES, Rolling, hash_memo, map_arrow, materialize, utf8, word_hashes

SYMBOLS = b"#*$%&|<>"
RUN = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Measures that the sketches summarise, and which of their tails is suspect.
TAILS = {"symbol_rate": "high", "dup_line_rate": "high", "repeat_rate": "high", "upper_rate": "high", "mean_word": "both", "distinct_rate": "low"}
#: The tails of a group begin at quantile LOW and at quantile HIGH.
LOW, MIDDLE, HIGH = 0.1, 0.5, 0.9
#: A cutoff lies FENCE times as far from the median as its tail's beginning, LEAST_WIDTH at least: most measures are 0 in
#: most texts, and what a text of a few lines gets by one repeated line or symbol is no outlier.
FENCE = 2.5
LEAST_WIDTH = {"symbol_rate": 0.01, "dup_line_rate": 0.1, "repeat_rate": 0.1, "upper_rate": 0.02, "mean_word": 0.5, "distinct_rate": 0.25}
#: Where a measure of texts that pass the base rules ends. A cutoff keeps to the nearer half of the way from its tail's
#: beginning to there, so that every rule can reject something in every group.
BOUND = {"symbol_rate": 1.0, "dup_line_rate": 1.0, "repeat_rate": MAX_REPEAT_PERCENT / 100, "upper_rate": 1.0, "distinct_rate": 0.0}
#: A group's quantiles count by its documents, those of the next wider group by so many.
LEAST = 200
ACCURACY = 1000

_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_PLAIN = bytes(b for b in range(256) if b not in SYMBOLS)
_LEADING = bytes(range(0x80, 0xC0))

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbol_rate double, dup_line_rate double, repeat_rate double, upper_rate double, mean_word double, distinct_rate double"


def repeated_words(h: np.ndarray, roll: Rolling, run: int = RUN) -> int:
    """How many words lie in a run of `run` words that the text has twice or more."""
    windows = roll(h, run)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    depth = np.zeros(len(h) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + run, -1)
    return int((np.cumsum(depth[:-1]) > 0).sum())


def measure(text: bytes, memo, roll: Rolling) -> tuple:
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.translate(None, _LEADING)))
    symbols = len(text.translate(None, _PLAIN))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(word_hashes(memo, words), roll)
    upper, letters = len(text.translate(None, _UPPER)), len(text.translate(None, _LETTERS))
    distinct = len(set(words)) / n**0.75 if n else 0.0
    return n, chars, symbols, dup, repeats, symbols / max(chars, 1), dup / max(len(lines), 1), repeats / max(n, 1), upper / max(letters, 1), chars / max(n, 1), distinct


def measure_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, roll = hash_memo(), Rolling(ROLL_BASES[0])
        types = [pa.int64()] * 5 + [pa.float64()] * 6
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            columns = list(zip(*(measure(x, memo, roll) for x in utf8(batch.column(3))), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "lang", "source", *names])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(picked, run, f"doc_id long, lang string, source string, {MEASURES}")


def thresholds(measured: DataFrame, tails: dict[str, str] | None = None) -> DataFrame:
    """For each language and source the low and high cutoff of each measure, from the sketches of texts that pass the base rules."""
    tails = tails or TAILS
    sketch = [F.percentile_approx(m, [LOW, MIDDLE, HIGH], ACCURACY).alias(m) for m in tails]
    sound = measured.where(~base_failed())
    cube = sound.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.grouping_id("lang", "source").alias("level"), F.count("*").alias("n"), *sketch)
    cube = materialize(cube, "quality-sketches")
    fine, by_lang, whole = (cube.where(F.col("level") == k) for k in (0, 1, 3))
    wide = by_lang.select(F.col("lang").alias("l"), F.col("n").alias("ln"), *[F.col(m).alias(f"l_{m}") for m in tails])
    all_ = whole.select(*[F.col(m).alias(f"c_{m}") for m in tails])  # one row: the aggregate without keys
    joined = fine.join(wide, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(all_), F.lit(True), "left")
    out = [F.col("lang"), F.col("source")]
    for m, tail in tails.items():
        blend = lambda own, n, wider: (n * own + LEAST * wider) / (n + LEAST)
        q = [blend(F.col(m)[k], F.col("n"), blend(F.col(f"l_{m}")[k], F.col("ln"), F.col(f"c_{m}")[k])) for k in range(3)]
        least, bound = F.lit(LEAST_WIDTH.get(m, 0.0)), F.lit(BOUND.get(m)).cast("double")  # least and greatest skip nulls
        low = F.greatest(q[1] - F.greatest(FENCE * (q[1] - q[0]), least), (q[0] + bound) / 2)
        high = F.least(q[1] + F.greatest(FENCE * (q[2] - q[1]), least), (q[2] + bound) / 2)
        out.append((low if tail in ("low", "both") else F.lit(None).cast("double")).alias(f"{m}_low"))
        out.append((high if tail in ("high", "both") else F.lit(None).cast("double")).alias(f"{m}_high"))
    return joined.select(*out)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_verdicts(docs: DataFrame, **columns: str) -> DataFrame:
    """The measures of each row of docs, base_failed, the rules that it breaks, and kept."""
    measured = materialize(measure_texts(docs, **columns), "quality-measures")
    cut = materialize(thresholds(measured), "quality-cutoffs")
    cut = cut.select(F.col("lang").alias("l"), F.col("source").alias("s"), *[c for c in cut.columns if c not in ("lang", "source")])
    joined = measured.join(cut, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    broken = F.array_compact(F.array(*[F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in TAILS]))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("broken_rules", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
        .select("doc_id", "lang", "source", *[x.split()[0] for x in MEASURES.split(", ")], "base_failed", "broken_rules", "kept")
    )
