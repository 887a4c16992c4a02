"""Secret scans over an incremental ledger of blobs, with DataFrame operations only.

Every version of every document is addressed by the SHA-256 of its content. The ledger holds, for each blob, the rules
(with their versions) that have scanned it and the spans they found. A run scans only pairs of blob and rule version that
the ledger lacks, each once whatever the number of paths with that content, and joins the findings back to all paths.

Spans count code points, end exclusive. For each rule matches are leftmost and do not overlap; those that fail the rule's
condition are dropped afterwards. Places are found by splitting the text into gaps and matches and summing up lengths.

Defined results: a null text is empty and has no spans; repeated rows each get their row; a null id is a path like any
other. An empty table or ledger gives no rows or adds none. Columns other than id and text are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, materialize, own_name


@dataclass(frozen=True)
class Rule:
    """kind; pattern without flags other than inline ones; a pattern that a text with a lasting match must contain; the
    group whose length decides (0: the match) and its least length."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, whose order is the order of kinds; a run of a class that must have n characters is asked for n or more
#: where a shorter run can't hide a longer match.
BASE = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", "[0-9a-f]{32}", 0, 32),
)
#: The line that a private key starts with.
_ARMOUR = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: From the armour to the END line; what is between has hyphens in headers only, and no other armour.
_TO_END = "[^-]*(?:-{1,4}[^-]+){0,40}-----END [A-Z ]{0,20}PRIVATE KEY-----"
#: Where END is missing: headers, then base64. Long runs may be indented or on one line; lines without indent go on as
#: long as they are base64 as a whole, the last one with its line break. Breaks may be written as \\n.
_HEADERS = "(?:[\\x20\\t]*[\\r\\n]+[A-Za-z0-9-]+:\\x20[^\\r\\n]*){0,9}"
_LINES = "(?:[\\x20\\t\\r\\n]+[A-Za-z0-9+/=\\\\]{16,}){0,60}(?:[A-Za-z0-9+/=\\\\\\r\\n]*(?:[A-Za-z0-9+/=\\\\]{16,}|[A-Za-z0-9+/=\\\\]+\\r?(?:\\n|\\z)))?"
#: Forms of keys that issuers have made public.
EXTRA = (
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ"),
    Rule("private_key", f"{_ARMOUR}(?:{_TO_END}|{_HEADERS}{_LINES})", _ARMOUR, version=2),
)
RULES = BASE + EXTRA

SPANS = "array<struct<start:int,kind_no:int,stop:int,kind:string>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def _found(rule: Rule, number: int, todo: Column) -> Column:
    """The rule's matches in `text`: their number, gap before, length, and whether they last."""
    apart = f"(?s)\\G(.*?)({rule.pattern})"  # without \\G each place of the rest would start a new search to the end
    parts = [F.regexp_extract_all("text", F.lit(apart), F.lit(g)) for g in (1, 2, *([rule.group + 2] if rule.group else []))]
    each = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("gap", "hit", "value"), strict=False)])
    value = "value" if rule.group else "hit"
    wrap = lambda x, i: F.struct(F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), i.alias("at"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("length"), (F.char_length(x[value]) >= rule.least).alias("lasts"))
    none = F.array().cast("array<struct<kind_no:int,kind:string,at:int,gap:int,length:int,lasts:boolean>>")
    return F.when(F.array_contains(todo, rule.name) & F.col("text").rlike(rule.hint), F.transform(each, wrap)).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs with spans, from (blob, todo, text); todo names the rules to run."""
    hits = blobs.select("blob", F.explode(F.concat(*[_found(r, k, F.col("todo")) for k, r in enumerate(rules)])).alias("x"))
    hits = hits.select("blob", "x.*").distinct()  # a blob may have come twice by one path
    along = Window.partitionBy("blob", "kind_no").orderBy("at")
    placed = hits.withColumn("stop", F.sum(F.col("gap") + F.col("length")).over(along).cast("int")).where("lasts")
    span = F.struct((F.col("stop") - F.col("length")).alias("start"), "kind_no", "stop", "kind")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(versions, ledger): (doc_id, blob) of each row of docs, and the ledger with what these versions add to it."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.sha2("text", 256).alias("blob"), "text")
    versions = materialize(texts.select("doc_id", "blob"), "versions", rows=F.count(F.lit(1)))
    paths = versions.groupBy("blob").agg(F.min("doc_id").alias("path"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        ledger = spark.createDataFrame([], LEDGER)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    unseen = paths.join(seen, "blob", "left").select("blob", "path", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    unseen = materialize(unseen.where(F.size("todo") > 0), "unseen").withColumnRenamed("blob", "b")
    fresh = texts.join(unseen.hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("path")))
    found = scan_blobs(fresh.select("blob", "todo", "text"), rules)
    entry = unseen.select(F.col("b").alias("blob"), F.col("todo").alias("rules")).join(found, "blob", "left")
    entry = entry.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return versions, ledger.unionByName(materialize(entry, "ledger"))


def secret_spans(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans (start, kind_no, stop, kind; in order) for each row of docs. Numbers of kinds are those of
    `rules`, whatever the ledger's rules were."""
    versions, book = update_ledger(docs, ledger, id_col, text_col, rules)
    # spans of a rule's former version are not the rule's
    now = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.name)])
    number = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    valid = F.filter("spans", lambda x: F.array_contains(F.col("rules"), F.try_element_at(now, x["kind"])))
    book = book.withColumn("spans", F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.element_at(number, x["kind"]).alias("kind_no"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    spans = book.where(F.size("spans") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    paths = versions.groupBy("blob").agg(F.count("*").alias("times"))
    joined = join_spread(versions, spans.join(paths, "blob"), ["blob"], versions.observed["rows"], how="left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.col("times").alias("copies"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


MASK = "<secret>"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, length_col: str | None = None) -> DataFrame:
    """docs, with all its columns, with MASK in place of each stretch of spans; length_col, if given, follows the text.
    Every row stays; null texts stay null, and repeated rows are masked alike. An empty table gives no rows."""
    blob, parts = own_name("blob"), own_name("parts")
    found = materialize(secret_spans(docs, None, id_col, text_col, rules).where(F.size("spans") > 0), "found")
    found = found.groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias("spans"), F.first("copies").alias("copies"))
    grow = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))))
    merged = found.select(blob, F.struct("copies", F.aggregate("spans", F.array().cast("array<struct<start:int,stop:int>>"), grow).alias("masks")).alias(parts)).withColumn("copies", F.col(f"{parts}.copies"))
    times = own_name("times")
    keyed = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    rows = found.agg(F.sum("copies")).first()[0] or 0
    joined = join_spread(keyed, merged.withColumnRenamed("copies", times), [blob], rows, times, "left", small=True)
    text, masks = F.col(text_col), F.col(f"{parts}.masks")
    before = lambda i: F.when(i > 0, masks[i - 1]["stop"]).otherwise(F.lit(0))
    gaps = F.transform(masks, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), F.lit(MASK)))
    rest = F.substring(text, F.element_at(masks, -1)["stop"] + 1, F.char_length(text))
    out = joined.withColumn(text_col, F.when(masks.isNull(), text).otherwise(F.concat(F.array_join(gaps, ""), rest)))
    if length_col:
        out = out.withColumn(length_col, F.when(masks.isNull(), F.col(length_col)).otherwise(F.char_length(text_col).cast(docs.schema[length_col].dataType)))
    return out.select(*docs.columns)
