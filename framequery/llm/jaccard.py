"""N-gram Jaccard join: an LSH forest of MinHash signatures, and exact verification.

Texts become sets of SHINGLE-word shingles (lower case, punctuation aside). Equal sets are settled by a digest of the
set; one document of each such class goes on. Its MinHash signature is cut into TREES labels of DEPTH values each.

Forest: the labels of all trees are sorted, dealt by ranges with the set as the last sort key, so that no prefix is one
task's. A pass over the sorted labels leaves those that share their first SHORTEST values with a neighbour; all others
are alone in their branch. The nodes of the prefix tries are then cut, each at a depth of its own. With prefixes of
matched_depth() values all trees together reach the target recall; a node of more than SMALL sets there is taken apart by
longer prefixes, up to DEPTH. Each set's recall follows from the depths at which its own branches are cut,
1 - product(1 - threshold**depth). Where that is below the target, prefixes are shortened, for all sets of the node, until
it is met: first those whose node stays small when it is shortened, then the longest. Two sets at the threshold are
missed with probability 1 - RECALL at most.

The sets of a node are tied to its least one, and components of ties are the candidate groups, verified exactly. A
group's sets are dealt into blocks along their sorted labels; of a group of several blocks, only blocks that have sets
of one node meet. Intersections of two blocks are counted by matrix products. A pair of blocks gives back at most one
row for each of its sets, with its number of links, and the ties of a spanning forest; pairs never become rows. Classes
are the components of the verified ties.

Defined results: a null text is empty; texts without words form one class by equality and have no links to others;
texts of fewer than five words are one shingle; each row of docs gets its row, repeated rows count as copies; a null id
is an id of its own. n_links counts the other documents (rows) with similarity at least the threshold, copies included.
An empty table gives no rows. Columns other than id and text are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROLL_BASES, Rolling, components, hash_memo, join_frequent, map_arrow, materialize, own_name, utf8, word_hashes, word_table

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 6, 0.9999
#: No prefix is shorter than so many values; nodes of SMALL sets or fewer are small.
SHORTEST, SMALL = 4, 32
#: Bytes of a value of a label, and of the number of its tree before it.
VALUE, TREE = 2, 1
#: Shingles in a block of a candidate group, about; a set counts as BLOCK / MOST of them at least.
BLOCK, MOST = 1 << 17, 512
#: Columns of a matrix product at once.
CHUNK = 4096

_TABLE = word_table()
_ROUND = np.random.default_rng(20240501)
#: Multipliers and shifts of the hash functions; a fixed seed makes reruns agree.
_MULTIPLY = (_ROUND.integers(1 << 32, size=TREES * DEPTH, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _ROUND.integers(1 << 32, size=TREES * DEPTH, dtype=np.uint32)[:, None]


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which all trees together reach the target recall at the threshold."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("no prefix reaches the target recall; use more trees")


def shingles(text: bytes, memo, roll: Rolling, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.translate(_TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(roll(word_hashes(memo, words), min(size, len(words))))


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH least hash values, over bounded pieces of the set."""
    best = np.full(len(_MULTIPLY), 0xFFFFFFFF, np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    for a in range(0, len(s), 2048):
        best = np.minimum(best, (low[None, a : a + 2048] * _MULTIPLY + _ADD).min(axis=1))
    return best.reshape(TREES, DEPTH)


def labels_of(sig: np.ndarray) -> bytes:
    """The labels of all trees, one after the other: the tree's number and the low bytes of its values."""
    out = np.empty((len(sig), TREE + VALUE * sig.shape[1]), np.uint8)
    out[:, 0] = np.arange(len(sig))
    out[:, TREE:] = sig.astype(f">u{VALUE}").view(np.uint8).reshape(len(sig), -1)
    return out.tobytes()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of the left block with all of the right one, counted by matrix products
    over the shingles that both blocks have."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    counts = np.zeros((len(left), len(right)), np.float64)
    place = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    keep = [np.isin(x, common) for x in (a, b)]
    at = [np.searchsorted(common, x[k]) for x, k in zip((a, b), keep, strict=True)]
    place = [p[k] for p, k in zip(place, keep, strict=True)]
    order = [np.argsort(x, kind="stable") for x in at]
    at = [x[o] for x, o in zip(at, order, strict=True)]
    place = [p[o] for p, o in zip(place, order, strict=True)]
    for c in range(0, len(common), CHUNK):
        m = []
        for x, p, n in zip(at, place, counts.shape, strict=True):
            i, j = np.searchsorted(x, [c, c + CHUNK])
            one = np.zeros((n, min(CHUNK, len(common) - c)), np.float32)
            one[p[i:j], x[i:j] - c] = 1
            m.append(one)
        counts += m[0] @ m[1].T
    return counts


def component_of(linked: np.ndarray) -> np.ndarray:
    """For each vertex of the graph with this symmetric boolean matrix the least vertex of its component."""
    root = np.full(len(linked), -1)
    for r in range(len(linked)):
        if root[r] >= 0:
            continue
        root[r], front = r, [r]
        while front:
            new = np.flatnonzero(linked[front.pop()] & (root < 0))
            root[new] = r
            front += new.tolist()
    return root


def text_hash(text_col: str) -> Column:
    """Tells the rows of one id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, set_id, n_shingles, labels): the digest of each row's set of shingles and its labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, roll = hash_memo(), Rolling(ROLL_BASES[0])
        for batch in batches:
            sets, sizes, labels = [], [], []
            for text in utf8(batch.column(1)):
                s = shingles(text, memo, roll)
                sets.append(set_digest(s))
                sizes.append(len(s))
                labels.append(labels_of(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())], names=["doc_id", "text_hash", "set_id", "n_shingles", "labels"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("text_hash"))
    return map_arrow(picked, run, "doc_id long, text_hash long, set_id binary, n_shingles long, labels binary")


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes() if len(s) else b"no words", digest_size=16).digest()


def prefix(depth: int) -> Column:
    return F.substring("label", 1, TREE + VALUE * depth)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (label, set_id), those that share their first SHORTEST values with the label before or after them, and
    both ends of the task's range, whose neighbours are in other tasks. One row waits for the next batch."""
    width, held, tied, first = TREE + VALUE * SHORTEST, None, True, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        starts = np.frombuffer(b"".join(x[:width] for x in rows.column("label").to_pylist()), np.uint8).reshape(-1, width)
        same = (starts[1:] == starts[:-1]).all(axis=1)
        keep = np.concatenate([[tied], same])  # as the one before
        keep[:-1] |= same
        tied, first = (True if first and len(keep) == 1 else bool(keep[-1])), False
        yield from rows.slice(0, len(keep) - 1).filter(pa.array(keep[:-1])).to_batches()
        held = rows.slice(len(keep) - 1).to_batches()[0]
    if held is not None:
        yield held


def forest_nodes(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(prefix, set_id, head): the sets of the forest's cut nodes that hold more than one, with the least of them."""
    spark = sets.sparkSession
    width, n = TREE + VALUE * DEPTH, int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.substring("labels", k * width + 1, F.lit(width)))
    line = sets.where("n_shingles > 0").select(F.explode(one).alias("label"), "set_id").repartitionByRange(n, "label", "set_id").sortWithinPartitions("label", "set_id")
    rows = materialize(map_arrow(line, neighbours, "label binary, set_id binary"), "forest", rows=F.count(F.lit(1)))
    total = rows.observed["rows"]

    start = matched_depth(threshold)
    cut = []
    for depth in range(start, DEPTH + 1):  # the branches that are too large at one depth are looked at one further down
        if depth > start and not total:
            break
        here = rows.withColumn("prefix", prefix(depth))
        nodes = here.groupBy("prefix").agg(F.count("*").alias("times"), F.min("set_id").alias("head"))
        large = (F.col("times") > SMALL) if depth < DEPTH else F.lit(False)
        level = materialize(join_frequent(here, nodes, ["prefix"], total), f"forest-{depth}", large=F.count_if(large), n=F.count(F.lit(1)))
        first = level if depth == start else first
        cut.append(level.where(~large).withColumn("depth", F.lit(depth)))
        rows, total = level.where(large).select("label", "set_id"), level.observed["large"]
    cuts = cut[0]
    for x in cut[1:]:
        cuts = cuts.unionByName(x)
    if len(cut) == 1:  # no branch is longer than what the recall asks for
        return cuts.where("times > 1").select("prefix", "set_id", "head")

    # branches without a row are cut at SHORTEST: nobody else is in them
    miss = {d: log(1 - threshold**d) for d in range(SHORTEST, DEPTH + 1)}
    gain = F.element_at(F.create_map(*[F.lit(x) for d in miss for x in (d, miss[d] - miss[SHORTEST])]), F.col("depth"))

    def lost(cuts: DataFrame) -> DataFrame:
        """Sets whose recall is below the target."""
        return cuts.groupBy("set_id").agg((F.sum(gain) + TREES * miss[SHORTEST]).alias("miss")).where(F.col("miss") > log(1 - RECALL)).select("set_id")

    def replaced(cuts: DataFrame, back: DataFrame, depth: int) -> DataFrame:
        """cuts with the nodes of `back`, of prefixes of `depth` values, in place of those below them."""
        gone = back.select(F.col("prefix").alias("up")).distinct()
        stay = cuts.withColumn("up", F.when(F.col("depth") > depth, prefix(depth))).join(gone, "up", "left_anti").drop("up")
        return materialize(stay.unionByName(back.withColumn("depth", F.lit(depth))), "forest-cut")

    for depth in range(start - 1, SHORTEST - 1, -1):
        asked = cuts.where(F.col("depth") == depth + 1).join(lost(cuts), "set_id", "left_semi").select(prefix(depth).alias("prefix")).distinct()
        under = first.select("label", "set_id", prefix(depth).alias("prefix")).join(asked, "prefix", "left_semi")
        sizes = under.groupBy("prefix").agg(F.count("*").alias("times"), F.min("set_id").alias("head")).where(F.col("times") <= SMALL)
        cuts = replaced(cuts, materialize(under.join(sizes, "prefix"), "forest-shorter"), depth)
    wider = cuts.where(F.col("depth") > start).join(lost(cuts), "set_id", "left_semi").groupBy(prefix(start).alias("prefix")).agg(F.lit(True).alias("wider"))
    sizes = first.groupBy("prefix").agg(F.count("*").alias("n")).join(wider, "prefix")
    back = materialize(join_frequent(first, sizes, ["prefix"], first.observed["n"], "n").drop("n", "wider"), "forest-back")
    return replaced(cuts, back, start).where("times > 1").select("prefix", "set_id", "head")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, set_id, class_id (the least id of the class), n_links for each row of docs."""
    return _classes(docs, id_col, text_col, threshold).select("doc_id", F.lower(F.hex("set_id")).alias("set_id"), "class_id", "n_links")


def _blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, i, j, block, set_id, copies) for each pair of blocks i <= j that meet and the sets of either."""
    spark = members.sparkSession
    weighed = members.withColumn("weight", F.greatest("n_shingles", F.lit(BLOCK // MOST)))
    mass = materialize(weighed.groupBy("grp").agg(F.sum("weight").alias("mass"), F.count("*").alias("times")), "masses", total=F.sum("times"))
    total = mass.observed["total"] or 0
    massed = materialize(join_frequent(weighed, mass, ["grp"], total).drop("times"), "massed")
    zero = F.lit(0).cast("long")
    small = massed.where(F.col("mass") <= BLOCK).select("grp", zero.alias("i"), zero.alias("j"), zero.alias("block"), "set_id", "copies")
    large = massed.where(F.col("mass") > BLOCK)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(large.repartitionByRange(n, "grp", "labels", "set_id").withColumn("part", F.spark_partition_id()), "large-groups")
    # weights summed up along the sorted labels: within each range, and over the ranges before it
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("grp", "part").agg(F.sum("weight").alias("size"))
    parts = parts.select("grp", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    along = Window.partitionBy("part", "grp").orderBy("labels", "set_id")
    summed = ranged.withColumn("within", F.sum("weight").over(along) - F.col("weight")).join(parts, ["grp", "part"])
    dealt = materialize(summed.select("grp", "set_id", "copies", F.floor((F.col("earlier") + F.col("within")) / BLOCK).cast("long").alias("block")), "blocks")
    touched = nodes.join(dealt.select("set_id", "grp", "block"), "set_id").select("prefix", "grp", "block").distinct()
    other = touched.select("prefix", F.col("block").alias("other"))
    meet = touched.join(other, "prefix").where("block <= other").select("grp", F.col("block").alias("i"), F.col("other").alias("j")).distinct()
    sides = meet.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return small.unionByName(dealt.join(sides, ["grp", "block"]).select(*small.columns))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """jaccard_classes with text_hash, and root, which tells classes apart where they share their least id."""
    signed = materialize(signatures(docs, id_col, text_col), "signatures", rows=F.count(F.lit(1)))
    # one row for each set; `one` names a row with it
    one = F.struct("doc_id", "text_hash")
    sets = signed.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min(one).alias("one"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("labels").alias("labels"))
    sets = materialize(sets, "sets")
    nodes = materialize(forest_nodes(sets, threshold), "nodes")
    ties = nodes.where("set_id > head").select(F.col("head").alias("a"), F.col("set_id").alias("b")).distinct()
    groups = components(ties, "candidates")

    members = materialize(sets.join(groups, F.col("set_id") == F.col("node")).select("set_id", "one", "n_shingles", "copies", "labels", F.col("root").alias("grp")), "members")
    pairs = materialize(_blocks(members.drop("one"), nodes), "block-pairs", across=F.count_if(F.col("i") < F.col("j")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, roll = hash_memo(), Rolling(ROLL_BASES[0])
        for batch in batches:
            keep, wide, sets = [], [], []
            for set_id, text, several in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                s = shingles(text, memo, roll)
                if set_digest(s) == set_id:
                    keep.append(set_id)
                    wide.append(several)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(wide, pa.bool_()), pa.array(sets, pa.list_(pa.int64()))], names=["set_id", "wide", "shingles"])

    # wide: sets of blocks that meet others, whose shingles are read again for these
    across = pairs.where("i < j").select("set_id").distinct().withColumn("wide", F.lit(True))
    wanted = members.join(across, "set_id", "left").select(F.col("one.doc_id").alias("want"), F.col("one.text_hash").alias("hash"), "set_id", F.coalesce("wide", F.lit(False)).alias("wide"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("text_hash"))
    full = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("text_hash") == F.col("hash"))).select("set_id", "text", "wide")
    full = materialize(map_arrow(full, shingled, "set_id binary, wide boolean, shingles array<long>"), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key, rows):
            i, j = key[1:]
            parts = [[r for r in rows if r[0] == b] for b in dict.fromkeys((i, j))]
            left, right = parts[0], parts[-1]
            if not left or not right or len(rows) < 2:
                return []
            sets = [[r[4] for r in p] for p in (left, right)]
            sizes = [np.array([len(s) for s in x], np.float64) for x in sets]
            both = intersections(*sets)
            linked = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9
            copies = [np.array([r[2] for r in p], np.int64) for p in (left, right)]
            gained = (linked * copies[1][None, :]).sum(axis=1)
            if i == j:
                gained -= copies[0]  # every set has a link to itself
            else:
                gained = np.concatenate([gained, (linked * copies[0][:, None]).sum(axis=0)])
            names = [r[1] for p in parts for r in p]
            # sets of one root are one vertex, so that blocks are tied by what holds each of them together
            roots = sorted({r[3] for r in rows})
            at = {root: k for k, root in enumerate(roots)}
            u, v = (np.array([at[r[3]] for r in p]) for p in (left, right))
            square = np.zeros((len(roots),) * 2, bool)
            x, y = np.nonzero(linked)
            square[u[x], v[y]] = square[v[y], u[x]] = True
            out: list[tuple] = [(name, None, int(g)) for name, g in zip(names, gained.tolist(), strict=True) if g]
            return out + [(roots[k], roots[r], 0) for k, r in enumerate(component_of(square).tolist()) if r != k]

        key, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for g, i, j, block, name, copies, root, shingle in zip(*(batch.column(c).to_pylist() for c in range(7)), batch.column(7), strict=True):
                if (g, i, j) != key:
                    if rows:
                        out += close(key, rows)
                    key, rows = (g, i, j), []
                rows.append((block, name, copies, root, shingle.values.to_numpy(zero_copy_only=False).view(np.uint64).copy()))
            yield _ties(out)
        if rows:
            yield _ties(close(key, rows))

    def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
        """All rows of a pair of blocks are together, in a row, in one partition; a pair holds about two BLOCKs."""
        met = pairs.join(full.select("set_id", "shingles").dropDuplicates(["set_id"]), "set_id").select("grp", "i", "j", "block", "set_id", "copies", "root", "shingles")
        together = met.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return materialize(map_arrow(together, verify, "a binary, b binary, gained long"), "verified")

    found = verified(pairs.where("i = j").withColumn("root", F.col("set_id")), full)
    if pairs.observed["across"]:
        roots = found.where("b is not null").select(F.col("a").alias("set_id"), F.col("b").alias("root"))
        rooted = pairs.where("i < j").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        found = found.unionByName(verified(rooted, full.where("wide")))
    classes = components(found.where("b is not null").select("a", "b"), "classes")
    gained = found.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("gained").alias("gained"))
    named = sets.select("set_id", "least", "copies").join(classes, F.col("set_id") == F.col("node"), "left").drop("node").join(gained, "set_id", "left")
    named = named.withColumn("root", F.coalesce("root", "set_id"))
    first = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(first, "root").select("set_id", "root", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("gained", F.lit(0))).cast("long").alias("n_links"))
    named = materialize(named, "classes")
    out = join_frequent(signed.select("doc_id", "text_hash", "set_id"), named, ["set_id"], signed.observed["rows"], "copies")
    return out.select("doc_id", "text_hash", "set_id", "root", "class_id", "n_links")


def _ties(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "gained"])


def one_row_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all its columns, with one row of each class: of the rows with the least id, nulls last, the one with
    the least set and text. Rows that share an id or have none stay as long as their classes differ; of rows with the same
    id and text one stays. An empty table gives no rows."""
    classes = _classes(docs, id_col, text_col, threshold)
    own, stays, hashed = own_name("own"), own_name("stays"), own_name("hash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id", "text_hash")
    stay = classes.groupBy("root").agg(F.min(order).alias("least")).select(F.col("least.doc_id").alias(stays), F.col("least.text_hash").alias(hashed))
    told = docs.withColumn(own, text_hash(text_col))
    same = told[id_col].cast("long").eqNullSafe(F.col(stays)) & (F.col(own) == F.col(hashed))
    return told.join(stay.hint("shuffle_hash"), same).dropDuplicates([id_col, own]).select(*docs.columns)
