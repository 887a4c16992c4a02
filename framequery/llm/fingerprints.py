"""SimHash fingerprints and the search for all of them within a Hamming radius, with DataFrame operations only.

Terms are runs of five words. Each occurrence of a term votes with its hash, so a term weighs as often as it occurs:
a bit of the fingerprint is set if more than half of the votes have it. The votes of CHUNK terms in a row are added up bit
by bit with full adders on whole hashes, which leaves four numbers for each half; these are counted 2 bits to a long, in
lanes of 32 bits, by ordinary sums.

Permuted block tables: the 128 bits are cut into BLOCKS blocks. Two fingerprints within RADIUS bits agree on at least
BLOCKS - RADIUS blocks, so that they meet in the table of some choice of that many blocks, and are counted in the first
such table. The tables hold distinct fingerprints only, so copies of a text cost one entry. An entry's fingerprints meet
in lists of about MOST; a fingerprint gets back how many are near it and the least label among them, never the pairs.

Tables that grow with the input are shuffled, never broadcast: the driver holds frequent keys (HOT) and heads of ranges only.

Words are runs of `[^\x20\x09-\x0D]`, unchanged. Defined results: a null text is empty; a text without words has the
fingerprint of 128 zeros; fewer than five words are one term; a tie of votes leaves the bit 0. Rows with the same id and
text count as one document in the order of documents and each get the same row; among different texts of one id the
order follows a hash of the text; a null id comes last in descending order. An empty table gives no rows; other columns
are left aside.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_frequent, materialize, spread

BITS = 128
RADIUS, BLOCKS = 3, 6
TERM = 5
#: Terms whose votes are added up before they are counted; 15 is what four binary digits hold.
CHUNK = 15
#: Fingerprints in one list of an entry, about.
MOST = 512
#: Stands for a null id; smaller than any id.
NO_ID = -(1 << 63)
_LANES = (1 << 32) + 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t-\r]+"), "")


def _added(df: DataFrame, keys: list[str], numbers: dict[tuple[int, int], list[str]]) -> DataFrame:
    """Adds up the bits of columns place by place: numbers holds the columns of each half of the hash and power of two. In
    every step three of a power become one, and one of the next power. What is left are the columns p<half>_<power>."""
    while any(len(c) > 1 for c in numbers.values()):
        columns, left = [], {}
        for (half, power), names in numbers.items():
            for k in range(0, len(names) - len(names) % 3, 3):
                x, y, z = (F.col(c) for c in names[k : k + 3])
                step = len(columns)
                either = x.bitwiseXOR(y)
                columns += [either.bitwiseXOR(z).alias(f"__s{step}"), x.bitwiseAND(y).bitwiseOR(z.bitwiseAND(either)).alias(f"__c{step}")]
                left.setdefault((half, power), []).append(f"__s{step}")
                left.setdefault((half, power + 1), []).append(f"__c{step}")
            for c in names[len(names) - len(names) % 3 :]:
                columns.append(F.col(c).alias(f"__k{len(columns)}"))
                left.setdefault((half, power), []).append(f"__k{len(columns) - 1}")
        df, numbers = df.select(*keys, *columns), left
    return df.select(*keys, *[F.col(c[0]).alias(f"__p{half}_{power}") for (half, power), c in numbers.items()])


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the two halves f1, f2 of the fingerprint of each row's text; keys tell rows apart."""
    words = texts.select(*keys, words_of(F.coalesce(F.col(text), F.lit(""))).alias("__w"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("__w") - TERM, F.lit(0)) / CHUNK).cast("int"))
    runs = words.select(*keys, F.explode(F.transform(starts, lambda k: F.slice("__w", k * CHUNK + 1, F.lit(CHUNK + TERM - 1)))).alias("__r"))
    runs = runs.withColumn("__n", F.greatest(F.size("__r") - (TERM - 1), F.least(F.size("__r"), F.lit(1))))
    own, zero = [*keys, "__n"], F.lit(0).cast("long")
    first = [F.when(F.col("__n") > i, F.xxhash64(*[F.get("__r", F.lit(i + k)) for k in range(TERM)])).otherwise(zero).alias(f"__a{i}") for i in range(CHUNK)]
    votes = runs.select(*own, *first)
    second = [F.when(F.col("__n") > i, F.xxhash64(f"__a{i}", F.lit(1))).otherwise(zero).alias(f"__b{i}") for i in range(CHUNK)]
    votes = votes.select("*", *second)
    added = _added(votes, own, {(half, 0): [f"__{c}{i}" for i in range(CHUNK)] for half, c in ((1, "a"), (2, "b"))})

    def lane(half: int, i: int) -> Column:
        parts = [F.shiftrightunsigned(f"__p{half}_{power}", i).bitwiseAND(F.lit(_LANES)) * (1 << power) for power in range(CHUNK.bit_length())]
        return sum(parts[1:], parts[0])

    lanes = [F.sum(lane(half, i)).alias(f"__v{half}_{i}") for half in (1, 2) for i in range(32)]
    counted = added.groupBy(*keys).agg(F.sum("__n").alias("__n"), *lanes)

    def bits(k: int) -> Column:
        value = F.lit(0).cast("long")
        for i in range(32):
            v = F.col(f"__v{k}_{i}")
            for count, bit in ((v.bitwiseAND(F.lit((1 << 32) - 1)), i), (F.shiftrightunsigned(v, 32), i + 32)):
                one = (1 << bit) - (1 << 64 if bit == 63 else 0)
                value = value.bitwiseOR(F.when(2 * count > F.col("__n"), F.lit(one).cast("long")).otherwise(zero))
        return value

    return counted.select(*keys, bits(1).alias("f1"), bits(2).alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return 1 - distance(a1, a2, b1, b2) / F.lit(float(BITS))


def as_text(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[list[tuple[int, int]]]:
    """For each table, the masks of the two halves of the blocks that it looks at."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << b for b in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return [(signed((m := sum(chosen)) & (1 << 64) - 1), signed(m >> 64)) for chosen in combinations(masks, blocks - radius)]


def _met(entered: DataFrame, value: str, tables: list[tuple[int, int]], radius: int) -> DataFrame:
    """(f1, f2, near) for each entry and each list of it: the values of the list's fingerprints that are within the radius
    and meet this one in no table before."""
    lists = entered.groupBy("entry", "block").agg(F.collect_list(F.struct(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col(value).alias("value"))).alias("list"))
    asked = entered.select("entry", "f1", "f2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    before = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in tables])

    def near(x: Column) -> Column:
        apart = distance(F.col("f1"), F.col("f2"), x["g1"], x["g2"])
        d1, d2 = F.col("f1").bitwiseXOR(x["g1"]), F.col("f2").bitwiseXOR(x["g2"])
        met = F.exists(F.slice(before, F.lit(1), F.col("entry.k")), lambda m: d1.bitwiseAND(m["a"]).bitwiseOR(d2.bitwiseAND(m["b"])) == 0)
        return apart.between(1, radius) & ~met

    return asked.join(spread(lists), ["entry", "block"]).select("f1", "f2", F.transform(F.filter("list", near), lambda x: x["value"]).alias("near")).where(F.size("near") > 0)


def within_radius(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(f1, f2, gained, r1, r2) of those distinct fingerprints (f1, f2, rows) that have others within the radius: the rows
    of these, and the least fingerprint that can be reached from one to the next."""
    tables = block_tables(radius, blocks)
    prints = materialize(prints.select("f1", "f2", "rows"), "prints", n=F.count(F.lit(1)))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col("f1").bitwiseAND(F.lit(a)).alias("m1"), F.col("f2").bitwiseAND(F.lit(b)).alias("m2")) for k, (a, b) in enumerate(tables)])
    entered = prints.select("f1", "f2", "rows", F.explode(entries).alias("entry"))
    shared = entered.groupBy("entry").agg(F.count("*").alias("times")).where("times > 1")
    entered = join_frequent(entered, shared, ["entry"], prints.observed["n"] * len(tables), wide=True).withColumn("blocks", F.ceil(F.col("times") / MOST).cast("int"))
    entered = materialize(entered.withColumn("block", F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")).cast("int")).drop("times"), "block-tables")
    found = _met(entered, "rows", tables, radius).groupBy("f1", "f2").agg(F.sum(F.aggregate("near", F.lit(0).cast("long"), lambda s, x: s + x)).alias("gained"))
    found = materialize(found, "near-counts", n=F.count(F.lit(1)))
    # labels: the least fingerprint seen so far, and in every round that of the least neighbour's label, too
    table = materialize(found.select("f1", "f2", F.struct("f1", "f2").alias("root")), "print-labels")
    moved = found.observed["n"]
    entered = entered.join(spread(found.select("f1", "f2")), ["f1", "f2"], "left_semi")
    while moved:
        seen = _met(entered.join(spread(table), ["f1", "f2"]), "root", tables, radius).groupBy("f1", "f2").agg(F.min(F.array_min("near")).alias("seen"))
        low = table.join(spread(seen), ["f1", "f2"]).select("f1", "f2", F.col("root").alias("was"), F.least("root", "seen").alias("low"))
        hop = table.select(F.struct("f1", "f2").alias("low"), F.col("root").alias("via"))
        stepped = low.join(spread(hop), "low").select("f1", "f2", F.least("low", "via").alias("root"), "was")
        stepped = materialize(stepped, "print-labels", moved=F.count_if(F.col("root") != F.col("was")))
        discard(table)
        table, moved = stepped.drop("was"), stepped.observed["moved"]
        table._written = stepped._written
    return found.join(spread(table), ["f1", "f2"]).select("f1", "f2", "gained", F.col("root.f1").alias("r1"), F.col("root.f2").alias("r2"))


def next_documents(keyed: DataFrame) -> DataFrame:
    """(doc_id, th) -> (next_id, next_th): the following document in descending order, after the last the first.

    Ids are dealt by ranges; each range knows the head of the next one from a table of one row for each range.
    """
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc(), F.col("th")]
    ranged = materialize(keyed.select("doc_id", "th", "n").distinct().repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    step = Window.partitionBy("part").orderBy(*order)
    head = F.min(F.struct(-(F.col("doc_id") + 1), F.col("th"), F.col("doc_id"))).alias("head")  # -(x + 1) can't overflow
    heads = ranged.groupBy("part").agg(head)
    line = Window.orderBy("part")  # over one row for each range
    ring = heads.select("part", F.coalesce(F.lead("head").over(line), F.first("head").over(line)).alias("after"))
    follow = ranged.select("*", F.lead("doc_id").over(step).alias("in_id"), F.lead("th").over(step).alias("in_th"))
    follow = follow.join(F.broadcast(ring), "part")
    own = F.col("in_th").isNotNull()
    return follow.select("doc_id", "th", "n", F.when(own, F.col("in_id")).otherwise(F.col("after.doc_id")).alias("next_id"), F.when(own, F.col("in_th")).otherwise(F.col("after.th")).alias("next_th"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """For each row of docs its fingerprint, that of its edited text, and the other documents within the radius.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document's.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    slim = materialize(texts.select("doc_id", "th", F.char_length("text").cast("long").alias("n")), "lengths")
    counts = slim.groupBy("doc_id", "th").count().where("count > 1")
    repeated = not counts.isEmpty()
    ring = materialize(next_documents(slim), "ring")

    lenders = texts.dropDuplicates(["doc_id", "th"]) if repeated else texts
    asked = ring.select(F.col("next_id").alias("doc_id"), F.col("next_th").alias("th"), F.col("doc_id").alias("to_id"), F.col("th").alias("to_th"), "n")
    lent = lenders.join(asked.hint("shuffle_hash"), ["doc_id", "th"]).select(F.col("to_id").alias("doc_id"), F.col("to_th").alias("th"), F.expr("substring(text, 1, int(n div 2))").alias("lent"))
    own = lenders.join(spread(lent), ["doc_id", "th"])
    edited = own.select("doc_id", "th", "text", F.expr("concat(substring(text, 1, int(char_length(text) - char_length(text) div 2)), lent)").alias("edited"))
    both = edited.select("doc_id", "th", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    both = both.select("doc_id", "th", "x.kind", "x.text", F.when(F.col("x.kind") == 1, F.sha2("x.text", 256)).alias("sha"))
    halves = fingerprint(both, ["doc_id", "th", "kind", "sha"])
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    prints = halves.groupBy("doc_id", "th").agg(pick("f1", 0).alias("f1"), pick("f2", 0).alias("f2"), pick("f1", 1).alias("e1"), pick("f2", 1).alias("e2"), F.max("sha").alias("edited_sha256"))
    prints = materialize(prints, "fingerprints")

    counted = slim.groupBy("doc_id", "th").agg(F.count("*").alias("rows"), F.first("n").alias("n_chars"))
    known = materialize(prints.join(spread(counted), ["doc_id", "th"]), "documents-with-prints", n=F.count(F.lit(1)))
    distinct = materialize(known.groupBy("f1", "f2").agg(F.sum("rows").alias("rows"), F.count("*").alias("times"), F.min("doc_id").alias("least")), "distinct-fingerprints")
    named = distinct.join(spread(within_radius(distinct, radius)), ["f1", "f2"], "left").withColumn("r1", F.coalesce("r1", "f1")).withColumn("r2", F.coalesce("r2", "f2"))
    least = named.groupBy("r1", "r2").agg(F.min("least").alias("class_id"))
    named = named.join(spread(least), ["r1", "r2"]).select("f1", "f2", "times", "class_id", (F.col("rows") - 1 + F.coalesce("gained", F.lit(0))).alias("n_near"))
    named = materialize(named, "fingerprint-classes")

    after = prints.select(F.col("doc_id").alias("next_id"), F.col("th").alias("next_th"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    rows = join_frequent(known, named, ["f1", "f2"], known.observed["n"], wide=True)
    rows = rows.join(spread(ring.drop("n")), ["doc_id", "th"]).join(spread(after), ["next_id", "next_th"])
    if repeated:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    f, e, nx = (F.col("f1"), F.col("f2")), (F.col("e1"), F.col("e2")), (F.col("n1"), F.col("n2"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(
        real("doc_id").alias("doc_id"), "n_chars", "edited_sha256", as_text(*f).alias("fingerprint"), as_text(*e).alias("edited_fingerprint"),
        likeness(*f, *e).alias("near_edited"), likeness(*f, *nx).alias("near_next"), real("class_id").alias("class_id"), "n_near",
    )
