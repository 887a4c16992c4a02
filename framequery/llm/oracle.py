"""DuckDB statements for the queries whose whole result SQL can express."""

from __future__ import annotations

from . import jaccard, mixing, repeats, secrets, warc

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def op3() -> str:
    weights = ", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, length(coalesce(text, '')) AS chars FROM documents),
drawn AS (SELECT *, -ln((('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE)
    / CASE WHEN chars / nullif(size, 0)::DOUBLE BETWEEN 4 AND 9 THEN 1.0 WHEN chars / nullif(size, 0)::DOUBLE BETWEEN 3 AND 12 THEN 0.5 ELSE 0.25 END::DOUBLE AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total, ([{weights}])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap), cap)) AS target FROM l),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn),
j AS (SELECT p.doc_id, p.size, p.start, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 2) ELSE 0 END::BIGINT AS whole FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (whole * size + CASE WHEN whole < 2 THEN least(size, greatest(round(target - whole * source_size)::BIGINT - start, 0)) ELSE 0 END)::BIGINT AS taken FROM j"""


def op4() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    k = jaccard.SHINGLE
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {jaccard.THRESHOLD} * (x.n + y.n - c) - 1e-9
    UNION ALL SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, min(r.b) AS class_id, any_value(coalesce(q.n, 0))::BIGINT AS n_links FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) q ON q.a = r.a GROUP BY 1"""


def op6() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::BIGINT + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, CASE WHEN strlen(html) >= {warc.MIN_BYTES} THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS head FROM p)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {digit}), '') AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM m"""


def op7() -> str:
    k = repeats.MIN_WORDS
    return f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS low FROM v) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS i FROM hit),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def op9() -> str:
    def found(number: int, rule: secrets.Rule) -> str:
        apart = f"(?s)(.*?)({rule.pattern})".replace("'", "''")
        part = lambda g: f"regexp_extract_all(text, '{apart}', {g})"
        return f"SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, {rule.least} AS least, unnest({part(1)}) AS gap, unnest({part(2)}) AS hit, unnest({part(rule.group + 2 if rule.group else 2)}) AS val, generate_subscripts({part(1)}, 1) AS i FROM d"

    raw = " UNION ALL ".join(found(k, r) for k, r in enumerate(secrets.RULES))
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    said = "coalesce(string_agg(kind || ':' || (stop - length(hit)) || ':' || stop, ',' ORDER BY stop - length(hit), k){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), raw AS ({raw}),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM raw),
lasting AS (SELECT * FROM placed WHERE length(val) >= least)
SELECT d.doc_id, {count}, sha256({said.format(f" FILTER (k < {len(secrets.BASE)})")}) AS base_sha256, {said.format("")} AS spans FROM d LEFT JOIN lasting USING (doc_id) GROUP BY d.doc_id"""
