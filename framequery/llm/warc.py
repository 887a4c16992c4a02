"""WARC archives: writing with digests and revisits, and parallel reading by boundary-chain verification.

Writing: of records with equal payloads (at least min_bytes long) the one with the largest id is a response, the others
are revisits that refer to it and carry no payload. Digests are computed on slim rows and joined back by id, so that a
payload shared by a third of all pages is one key of a partial aggregation and of a join of slim rows.

Reading: a file is cut into byte ranges. A task looks for record magic in its range and reads the record there, which
gives the offset of its successor; magic inside a payload gives a candidate, too. Each candidate gets its exit, the first
offset beyond the range that its chain reaches. Pointer jumping over the exits, from offset 0 of every file and twice as
far in each round, finds where the true chain enters each range; only candidates on the chain from there are records.

Archives are .warc.gz (one gzip member for each record) or plain .warc. Files are written and read through pyarrow's
file systems, below spark.checkpoint.dir or a path given.

Defined results: a null payload is empty; a null URL is an empty header; rows with a null id keep it and count as
smaller than all; rows with one id and payload are all responses or all revisits; an empty table writes no file and reads
as no rows; a damaged record ends its file's chain. Reading fails if the manifest tells more or fewer records than were
read, unless `lenient`: then, and without a count in the manifest, what is before the damaged record stays.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, join_frequent, map_arrow, materialize, utf8

MIN_BYTES = 0
#: Bytes of a range, and of one read.
RANGE, READ = 4 << 20, 1 << 20
#: First read for a plain record's header; it goes on until the header's end.
HEADER_READ = 1 << 16
LEVEL = 1
#: All records carry one date, so that reruns write equal files.
DATE = "2024-01-01T00:00:00Z"
GZIP_MAGIC, PLAIN_MAGIC = b"\x1f\x8b\x08", b"WARC/1."


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, page_id: int | None, refers_to: int | None, url: str, payload: bytes) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c for c in url if c not in "\r\n"),
        "WARC-Payload-Digest": f"sha1:{digest_text(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{'' if refers_to is None else refers_to}>"
        payload = b""
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, compress: bool = True) -> DataFrame:
    """Writes one archive for each task and returns the manifest (file, bytes, records). A file of a lost task is in no
    manifest, so that lost executors leave nothing that is read."""
    folder = path or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    slim = rows.select("page_id", F.sha1(F.encode("payload", "utf-8")).alias("sha"), F.octet_length("payload").alias("size"))
    slim = materialize(slim, "payload-digests", rows=F.count(F.lit(1)))
    heads = slim.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("times")).where("times > 1")
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("head"))
    # only revisits are joined by id and payload; whatever finds no partner is a response
    kinds = join_frequent(slim, heads, ["sha"], slim.observed["rows"]).where(revisit).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "head").distinct()
    kinds = materialize(kinds, "revisits")
    typed = rows.join(kinds.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1(F.encode("payload", "utf-8")) == F.col("s")), "left").select("page_id", F.col("s").isNotNull().alias("revisit"), "head", "url", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        name, out, size, n = f"{base}/part-{uuid.uuid4().hex}.warc" + ".gz" * compress, None, 0, 0
        for batch in batches:
            for page, revisit, head, url, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), utf8(batch.column(3)), utf8(batch.column(4)), strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                data = record_bytes("revisit" if revisit else "response", page, head, url.decode("utf-8", "replace"), payload)
                if compress:
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["file", "bytes", "records"])

    return materialize(map_arrow(typed, write, "file string, bytes long, records long"), "manifest").withColumn("folder", F.lit(folder))


def archive_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all archives in a folder."""
    from pyarrow import fs

    system, base = _file_system(folder)
    files = [(x.path, x.size, None, folder) for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]
    return spark.createDataFrame(files, "file string, bytes long, records long, folder string")


class _Window:
    """Bytes of a file from an offset on, read as far as asked for."""

    def __init__(self, handle, start: int, size: int):
        self.handle, self.start, self.size, self.data = handle, start, size, b""
        self.asked, self.found = 0, -1

    def upto(self, offset: int) -> None:
        """Makes bytes before `offset` present."""
        have = self.start + len(self.data)
        want = min(max(offset, have), self.size)
        if want > have:
            self.handle.seek(have)
            self.data += self.handle.read(want - have)

    def blank(self, at: int) -> int:
        """The offset of the first empty line at or after an offset, -1 if there is none. Offsets go up from call to call,
        so that many candidates before one empty line search for it once."""
        if not self.asked <= at <= self.found:
            self.asked, look, want = at, at, at + HEADER_READ
            while True:
                self.upto(want)
                k = self.data.find(b"\r\n\r\n", look - self.start)
                have = self.start + len(self.data)
                if k >= 0 or have >= self.size:
                    self.found = self.start + k if k >= 0 else self.size
                    break
                look, want = max(at, have - 3), have + (have - at)
        return self.found if self.found < self.size else -1

    def get(self, a: int, b: int) -> bytes:
        self.upto(b)
        return self.data[a - self.start : b - self.start]


def _unzip(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The gzip member at an offset and the offset after it, or None if there is no whole one."""
    z, parts, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        piece = window.get(pos, pos + min(READ, max(1 << 14, pos - at)))
        if not piece:
            return None
        try:
            parts.append(z.decompress(piece))
        except zlib.error:
            return None
        if pos == at and not parts[0].startswith(PLAIN_MAGIC[: len(parts[0])]):
            return None
        pos += len(piece)
    return b"".join(parts), pos - len(z.unused_data)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """Header, payload and length of the record at the start of data, or None."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(PLAIN_MAGIC):
        return None
    head = dict(x.split(": ", 1) for x in data[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    try:
        n = int(head["Content-Length"])
    except (KeyError, ValueError):
        return None
    stop = end + 4 + n
    if n < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        return None
    return head, data[end + 4 : stop], stop + 4


def _plain(window: _Window, at: int) -> tuple[bytes, int] | None:
    blank = window.blank(at)
    if blank < 0:
        return None
    head, end = window.get(at, blank), blank - at
    try:
        n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)[b"Content-Length"])
    except (KeyError, ValueError):
        return None
    stop = at + end + 4 + n + 4
    if n < 0 or stop > window.size:
        return None
    return window.get(at, stop), stop


def candidates(handle, size: int, start: int, stop: int, zipped: bool) -> list[tuple]:
    """(offset, successor, header, payload) of whatever reads like a record and starts in [start, stop)."""
    window, magic = _Window(handle, start, size), GZIP_MAGIC if zipped else PLAIN_MAGIC
    window.upto(stop + len(magic) - 1)
    out, at = [], window.data.find(magic)
    while 0 <= at and start + at < stop:
        got = (_unzip if zipped else _plain)(window, start + at)
        record = got and parse_record(got[0])
        if record and record[2] == len(got[0]):
            out.append((start + at, got[1], record[0], record[1]))
        at = window.data.find(magic, at + 1)
    return out


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def read_archives(manifest: DataFrame, range_bytes: int = RANGE, with_payload: bool = True, lenient: bool = False) -> DataFrame:
    """file, offset and the fields of every record that is reachable from the start of its file."""
    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.where("bytes > 0").select("folder", "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")).repartition(n, "file", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file, size, start in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                system, _ = _file_system(folder)
                with system.open_input_file(file) as handle:
                    found = candidates(handle, size, start, min(size, start + range_bytes), file.endswith(".gz"))
                rows = []
                for at, after, head, payload in found:
                    kind = head.get("WARC-Type")
                    full = kind != "revisit"
                    digest = digest_text(payload) if full else head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    if full and head.get("WARC-Payload-Digest", f"sha1:{digest}") != f"sha1:{digest}":
                        continue  # damaged, so nothing leads on from here
                    rows.append([file, start // range_bytes, at, after, after, _page(head.get("WARC-Record-ID")), len(payload) if full else int(head.get("X-Payload-Length", 0)), digest, kind, None if full else _page(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), payload.decode("utf-8", "replace") if with_payload and full else None])
                leave: dict[int, int] = {}
                for row in reversed(rows):
                    row[4] = leave[row[2]] = leave.get(row[3], row[3])
                columns = list(zip(*rows, strict=True)) or [()] * 12
                types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "part", "at", "after", "leave", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    found = materialize(map_arrow(ranges, scan, f"file string, part long, at long, after long, leave long, {FIELDS}"), "candidates")
    entered = reachable_entries(found.select("file", "at", "leave"))
    entered = entered.select(F.col("file").alias("f"), F.floor(F.col("at") / range_bytes).alias("k"), F.col("at").alias("entry"))
    chains = found.select("file", "part", "at", "after").join(entered, (F.col("file") == F.col("f")) & (F.col("part") == F.col("k"))).select("file", "part", "at", "after", "entry")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        at, after, cursor, keep = rows["at"].tolist(), rows["after"].tolist(), int(rows["entry"].iloc[0]), []
        while (k := bisect_left(at, cursor)) < len(at) and at[k] == cursor:
            keep.append(cursor)
            cursor = after[k]
        return pd.DataFrame({"file": rows["file"].iloc[0], "at": keep})

    # a group is the candidates of one range, without their fields
    true = materialize(chains.groupBy("file", "part").applyInPandas(walk, "file string, at long"), "records")
    if not lenient:
        read = true.groupBy(F.col("file").alias("f")).agg(F.count("*").alias("read"))
        lost = manifest.join(read, F.col("file") == F.col("f"), "left").select("file", "records", F.coalesce("read", F.lit(0)).alias("read")).where("records <> read")
        if some := lost.limit(3).collect():
            raise ValueError("records read differ from the manifest: " + "; ".join(f"{r['read']} of {r['records']} in {r['file']}" for r in some))
    return found.join(true, ["file", "at"], "left_semi").select("file", F.col("at").alias("offset"), *[x.split()[0] for x in FIELDS.split(", ")])


def reachable_entries(found: DataFrame) -> DataFrame:
    """(file, at): where the chain from offset 0 enters ranges, from (file, at, leave) of all candidates."""
    starts = found.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    doors = found.select("file", F.col("leave").alias("at")).union(starts).distinct()
    jump = materialize(found.join(doors, ["file", "at"], "left_semi"), "jumps")
    reached = materialize(jump.where("at = 0").select("file", "at"), "reached")
    while True:
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("leave").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        fresh = materialize(ahead.join(reached, ["file", "at"], "left_anti").distinct(), "reached-more")
        if fresh.isEmpty():
            return reached
        reached = reached.union(fresh)
        hop = jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("further"))
        longer = jump.join(hop, ["file", "leave"]).select("file", "at", F.col("further").alias("leave")).union(jump.join(hop, ["file", "leave"], "left_anti").select("file", "at", "leave"))
        longer = materialize(longer, "jumps")
        discard(jump)
        jump = longer
