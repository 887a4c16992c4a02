"""Best-fit packing of token sequences by hierarchical residual packing.

Texts are tokenised in Arrow batches; only (piece, length, checksum) rows go on. Each group of pieces is packed by
best-fit decreasing. Bins that are nearly full are final; the underfull ones go to the next level of a tree as items
that stay together, where several groups meet and are packed again. From level to level a bin needs less to be final,
down to half: two bins of at most half a sequence always fit together, so that at most one bin of each group goes on
and the last group stays small whatever the input.

Token ids: the tokenizer's for the text without special tokens, then id 0. Longer documents are cut into full
sequences and a rest; shorter ones are never cut.

Defined results: a null text is empty and gives one piece with the single id 0; repeated rows and ids are packed like
other rows; an empty table gives no rows; other columns are left aside. Pieces are dealt to groups by content and place in
the table, so that equal rows spread; a table that is read in another order may be packed in another way.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_arrow, materialize, own_name

CAPACITY = 2048
#: Pieces packed together at the first level, and groups that meet at each further one.
GROUP, FAN_IN = 40_000, 8
#: Part of a sequence that makes a bin final, by level; the last holds for all further levels.
FINAL = (0.98, 0.9, 0.75, 0.5)
#: A group of this many bins or fewer is packed at once to the end.
LAST = 4_000

#: Texts outside Latin-1 and those with the tokenizer's own markers go to the tokenizer as a whole.
_MARKER = re.compile(r"<\|(?:startoftext|endoftext)\|>", re.IGNORECASE)
#: The split pattern of the vocabulary file, with its Unicode classes spelt out for Latin-1 (after lower-casing).
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECES = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class WordTokenizer:
    """Ids of whole texts as little-endian uint32 bytes. Words are independent of each other in this vocabulary, so each
    word's ids are computed by the tokenizer once and kept in a bounded memo."""

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self.whole, 1 << 19)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One for each Python worker, whose memo serves all its tasks."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text and _MARKER.search(text):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, _PIECES.findall(text.lower())))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a closing 0, cut where longer than a sequence."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer.of(path)
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), encode(text.as_py() or "") + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the bin with the least room that still holds it. A bit set of the rooms
    that occur finds that bin in one step."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


_ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_BINS = f"grp long, number long, fill long, final boolean, items array<{_ITEM}>"


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN, final: tuple[float, ...] = FINAL) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32)."""
    given = pieces.columns
    row = own_name("row")
    pieces = materialize(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces", short=F.count_if(F.col("length") < capacity))
    n = pieces.observed["short"]
    groups = max(1, -(-n // group))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        items = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None).to_dict("records")
        lengths = pdf["length"].tolist()
        bins = best_fit(lengths, capacity)
        fills = [sum(lengths[i] for i in b) for b in bins]
        done = groups == 1
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "number": range(len(bins)), "fill": fills, "final": [done or f >= final[0] * capacity for f in fills], "items": [[items[i] for i in b] for b in bins]})

    def further(level: int, last: bool):
        need = 0 if last else final[min(level, len(final) - 1)] * capacity

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["fill", "grp", "number"], ascending=[False, True, True], kind="stable")
            fills, items = pdf["fill"].tolist(), pdf["items"].tolist()
            bins = best_fit(fills, capacity)
            sums = [sum(fills[i] for i in b) for b in bins]
            return pd.DataFrame({"grp": pdf["to"].iloc[0], "number": range(len(bins)), "fill": sums, "final": [f >= need for f in sums], "items": [[x for i in b for x in items[i]] for b in bins]})

        return merge

    keyed = pieces.where(F.col("length") < capacity).withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", row), F.lit(groups))).drop(row)
    bins = materialize(keyed.groupBy("grp").applyInPandas(first, _BINS), "bins-0")
    done, level = [], 0
    while True:
        done.append(bins.where("final").select(F.lit(level).alias("level"), "grp", "number", "items"))
        if groups == 1:
            break
        rest = bins.where("not final")
        level += 1
        groups = 1 if rest.count() <= LAST else -(-groups // fan_in)
        bins = materialize(rest.withColumn("to", F.pmod(F.col("grp"), F.lit(groups))).groupBy("to").applyInPandas(further(level, groups == 1), _BINS), f"bins-{level}")
    packed = done[0]
    for x in done[1:]:
        packed = packed.unionByName(x)
    # the number of a sequence: level, group and place in the group; full pieces are numbered as rows
    low = packed.withColumn("sequence_id", F.col("level").cast("long") * F.lit(1 << 56) + F.col("grp") * F.lit(1 << 28) + F.col("number"))
    before = "aggregate(slice(items, 1, at), 0L, (s, x) -> s + x.length)"
    spread = low.select("sequence_id", "items", F.posexplode("items").alias("at", "item")).select("item.*", "sequence_id", F.expr(before).alias("offset"))
    full = pieces.where(F.col("length") >= capacity)
    full = full.select(*given, (F.lit(1 << 62) + F.col(row)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return spread.unionByName(full)
