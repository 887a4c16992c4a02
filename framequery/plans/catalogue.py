"""The catalogue of queries over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoders, scalars, vectors
from ..operators import ann, answers, corpus, evaluate, keyframes, objects, retrieval, shaping
from ..sources import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENS = "list_filter(string_split_regex(lower({}), '[^\\pL\\pN_]+'), lambda x: x <> '')"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
COS = "(list_dot_product({0}, {1}) / greatest(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 1e-12))"
WORDS = [objects.ObjectQuery("click red", 2), objects.ObjectQuery("view", 5)]
KS = (1, 5, 10)

#: Views that several statements share, in the order in which they build on each other.
VIEWS = {
    "frames": "SELECT vec_id AS id, 'L' || (21 + label) || '_V001' AS video_id, vec_id * 25 AS frame_id, vec_id // 10 AS shot_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "asked": "SELECT id AS query_id, embedding AS q FROM frames WHERE id % 50 = 0",
    "detections": "SELECT f.video_id, f.frame_id::VARCHAR AS frame_id, e.event_type || ' ' || (['red', 'blue', 'old'])[e.user_id % 3 + 1] AS object, 1 + e.event_id % 4 AS quantity, e.value AS bbox_x, e.event_id + 2 AS row_no FROM events e JOIN frames f ON f.id = e.event_id % (SELECT count(*) FROM frames)",
    "counts": "SELECT video_id, frame_id, object, count(*) AS n FROM detections GROUP BY ALL",
    "matched": "SELECT c.video_id, c.frame_id, w.query, w.requested, sum(CASE WHEN c.object = w.query OR list_has_all(" + TOKENS.format("c.object") + ", " + TOKENS.format("w.query") + ") THEN c.n ELSE 0 END)::BIGINT AS matched FROM counts c CROSS JOIN (VALUES ('click red', 2), ('view', 5)) w(query, requested) GROUP BY ALL",
    "objects_of": "SELECT video_id, frame_id, min(matched) AS least, sum(abs(matched - requested) / requested::DOUBLE) AS delta, sum(matched)::BIGINT AS total FROM matched GROUP BY ALL",
    "ranked": "SELECT query_id, id, video_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, frame_id) AS rank FROM (SELECT a.query_id, f.id, f.video_id, f.frame_id, " + COS.format("f.embedding", "a.q") + " AS score FROM asked a CROSS JOIN frames f)",
    "keyframe_map": "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS n, frame_id + 7 AS frame_idx FROM frames",
    "nearest": "SELECT id, keyframe_number FROM (SELECT f.id, k.n AS keyframe_number, row_number() OVER (PARTITION BY f.id ORDER BY abs(k.frame_idx - f.frame_id), k.n) AS r FROM frames f JOIN keyframe_map k USING (video_id)) WHERE r = 1",
    "tasks": "SELECT id::VARCHAR AS task_id, (['KIS', 'VQA', 'trake'])[id // 50 % 3 + 1] AS task_type, id AS query_id, video_id AS v, shot_id AS s FROM frames WHERE id % 50 = 0",
    "relevant": "SELECT t.task_id, f.video_id, f.frame_id, CASE WHEN abs(f.shot_id - t.s) <= 5 THEN 2 ELSE 1 END AS relevance FROM tasks t JOIN frames f ON f.video_id = t.v AND f.id <> t.query_id WHERE abs(f.shot_id - t.s) <= 20",
    "rankings": "SELECT query_id::VARCHAR AS task_id, video_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked WHERE id <> query_id AND rank <= 51",
    "judged": "SELECT r.*, coalesce(x.relevance, 0) AS relevance FROM rankings r LEFT JOIN relevant x USING (task_id, video_id, frame_id)",
    "scored": "SELECT t.task_id, upper(t.task_type) AS task_type, j.first_relevant_rank, coalesce(1.0::DOUBLE / j.first_relevant_rank, 0) AS reciprocal_rank, coalesce(j.dcg / nullif(i.ideal, 0), 0) AS ndcg_at_10, " + ", ".join(f"coalesce(j.r{k}, 0)::DOUBLE AS recall_at_{k}" for k in KS) + " FROM tasks t LEFT JOIN (SELECT task_id, min(rank) FILTER (relevance > 0) AS first_relevant_rank, sum((pow(2, relevance) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, " + ", ".join(f"max((relevance > 0 AND rank <= {k})::INT) AS r{k}" for k in KS) + " FROM judged GROUP BY 1) j USING (task_id) LEFT JOIN (SELECT task_id, sum((pow(2, relevance) - 1) / log2(b + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY relevance DESC) AS b FROM relevant) WHERE b <= 10 GROUP BY 1) i USING (task_id)",
    "pairs": "SELECT video_id, id AS left_id, right_id, " + COS.format("a", "b") + " AS similarity FROM (SELECT video_id, id, embedding AS a, row_number() OVER w AS n, lead(id) OVER w AS right_id, lead(embedding) OVER w AS b FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)) WHERE n % 2 = 1 AND right_id IS NOT NULL",
    "convs": "SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1",
    "first_turns": "SELECT conv_id, text FROM conversations WHERE turn = 0",
    "frame_text": "SELECT f.id, f.video_id, f.frame_id, f.shot_id, d.text AS ocr_text, c.text AS asr_text FROM frames f LEFT JOIN documents d ON d.doc_id = f.id LEFT JOIN first_turns c ON c.conv_id = f.id",
}


def statement(body: str) -> str:
    """The body with the views that it needs in front."""
    import re

    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in need) + " " if need else "") + body


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = statement(sql)
        return f

    return add


def _vectors(spark, sf_dir, *ids):
    """Request vectors: those of the frames with these ids."""
    rows = bridge.frames(spark, sf_dir).where(F.col("id").isin(*ids)).select("id", "embedding").collect()
    return [list(next(r["embedding"] for r in rows if r["id"] == i)) for i in ids]


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "video_id", "frame_id", "shot_id", F.round("distance", 6).alias("distance"), "retrieval_rank")


def _top_sql(vector: int, source: str, k: int) -> str:
    return f"SELECT id, video_id, frame_id, shot_id, score, row_number() OVER (ORDER BY score DESC, video_id, frame_id) AS retrieval_rank FROM (SELECT f.id, f.video_id, f.frame_id, f.shot_id, {COS.format('f.embedding', 'v.q')} AS score FROM {source} f CROSS JOIN (SELECT embedding AS q FROM frames WHERE id = {vector}) v) ORDER BY score DESC, video_id, frame_id LIMIT {k}"


_SHOWN = "SELECT id, video_id, frame_id, shot_id, round(score, 6) AS distance, retrieval_rank FROM "


@query(_SHOWN + f"({_top_sql(0, 'frames', 10)})")
def vector_topk(spark, sf_dir):
    return _shown(retrieval.top_k(bridge.frames(spark, sf_dir), _vectors(spark, sf_dir, 0)[0], 10))


@query("SELECT query_id, id, round(score, 6) AS distance, rank AS retrieval_rank FROM ranked WHERE rank <= 20")
def vector_topk_batch(spark, sf_dir):
    found = retrieval.top_k_batch(bridge.frames(spark, sf_dir), bridge.queries(spark, sf_dir), 20)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "retrieval_rank")


@query("SELECT id, round(s, 6) AS distance FROM (SELECT f.id, f.video_id, f.frame_id, list_dot_product(f.embedding, v.q) AS s FROM frames f CROSS JOIN (SELECT embedding AS q FROM frames WHERE id = 1) v) ORDER BY s DESC, video_id, frame_id LIMIT 10")
def inner_product_topk(spark, sf_dir):
    found = retrieval.top_k(bridge.frames(spark, sf_dir), _vectors(spark, sf_dir, 1)[0], 10, "inner")
    return found.select("id", F.round("distance", 6).alias("distance"))


@query("SELECT id, pos - 1 AS pos, round(3 * x / greatest(3 * sqrt(d), 1e-12), 6) AS value FROM (SELECT id, list_dot_product(embedding, embedding) AS d, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM frames)")
def l2_normalize(spark, sf_dir):
    tripled = F.transform(vectors.as_vector(F.col("embedding")), lambda x: 3 * x)
    return bridge.frames(spark, sf_dir).select("id", F.posexplode(vectors.unit(tripled)).alias("pos", "value")).select("id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


_C0 = f"SELECT DISTINCT video_id AS v, shot_id AS s FROM ({_top_sql(0, 'frames', 20)})"


def _within_sql(context: str, remaining: int) -> str:
    return f"(SELECT * FROM frames x WHERE EXISTS (SELECT 1 FROM ({context}) c WHERE c.v = x.video_id AND x.shot_id BETWEEN c.s AND c.s + {remaining + retrieval.SLACK}))"


_STAGE1_OF_2 = _top_sql(1, _within_sql(_C0, 1), 20)
_STAGE1_OF_3 = _top_sql(1, _within_sql(_C0, 2), 20)
_STAGE2_OF_3 = _top_sql(2, _within_sql(f"SELECT DISTINCT video_id AS v, shot_id AS s FROM ({_STAGE1_OF_3})", 1), 20)


@query(_SHOWN + f"({_top_sql(0, _within_sql(_C0, 0), 20)})")
def filtered_topk(spark, sf_dir):
    f, v = bridge.frames(spark, sf_dir), _vectors(spark, sf_dir, 0)[0]
    return _shown(retrieval.top_k(retrieval.within_context(f, retrieval.top_k(f, v, 20), 0), v, 20))


@query(_SHOWN + f"({_STAGE1_OF_2})")
def staged_two(spark, sf_dir):
    return _shown(retrieval.staged(bridge.frames(spark, sf_dir), _vectors(spark, sf_dir, 0, 1), 20))


@query(_SHOWN + f"({_STAGE2_OF_3})")
def staged_three(spark, sf_dir):
    return _shown(retrieval.staged(bridge.frames(spark, sf_dir), _vectors(spark, sf_dir, 0, 1, 2), 20))


@query("SELECT DISTINCT video_id, unnest(range(shot_id, shot_id + 5)) AS shot_id FROM frames")
def context_shots(spark, sf_dir):
    return retrieval.context_shots(bridge.frames(spark, sf_dir), 2)


_PATHS = "SELECT id AS pos, CASE id % 4 WHEN 0 THEN '/keyframes/' || video_id || '/' || shot_id || '/' || frame_id || '.jpg' WHEN 1 THEN '/keyframes/' || video_id || '/' || lpad(frame_id::VARCHAR, 9, '0') || '.png' WHEN 2 THEN 'http://h/keyframes/' || video_id || '/' || shot_id || '/' || frame_id || '.jpg?x=1' ELSE '  ' || frame_id || ' ' END AS path FROM frames"


def _paths(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    v, s, n = F.col("video_id"), F.col("shot_id").cast("string"), F.col("frame_id").cast("string")
    deep = F.concat(F.lit("/keyframes/"), v, F.lit("/"), s, F.lit("/"), n, F.lit(".jpg"))
    flat = F.concat(F.lit("/keyframes/"), v, F.lit("/"), F.lpad(n, 9, "0"), F.lit(".png"))
    kind = F.col("id") % 4
    path = F.when(kind == 0, deep).when(kind == 1, flat).when(kind == 2, F.concat(F.lit("http://h"), deep, F.lit("?x=1"))).otherwise(F.concat(F.lit("  "), n, F.lit(" ")))
    return f.select(F.col("id").alias("pos"), path.alias("path"))


_PARSED = f"SELECT pos, trim(path) AS path, CASE WHEN pos % 4 <> 3 THEN split_part(regexp_replace(path, '^http://h', ''), '/', 3) END AS video_id, CASE WHEN pos % 4 = 3 THEN trim(path) ELSE regexp_extract(path, '/([0-9]+)\\.', 1) END AS frame_id, CASE WHEN pos % 4 IN (0, 2) THEN split_part(regexp_replace(path, '^http://h', ''), '/', 4) END AS shot_id FROM ({_PATHS})"


@query(_PARSED)
def parse_frame_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("pos", scalars.path_parts(F.col("path")).alias("p")).select("pos", "p.*")


@query(f"SELECT p.pos, p.path, coalesce(f.video_id, p.video_id) AS video_id, coalesce(f.frame_id::VARCHAR, p.frame_id) AS frame_id, coalesce(f.shot_id::VARCHAR, p.shot_id) AS shot_id, f.id / 2.0::DOUBLE AS score FROM ({_PARSED}) p LEFT JOIN frames f ON f.id = p.pos AND p.pos % 4 = 1")
def context_resolve(spark, sf_dir):
    paths = _paths(spark, sf_dir).withColumn("path", F.trim("path"))
    f = bridge.frames(spark, sf_dir)
    known = paths.join(f, paths.pos == f.id).where(F.col("path").endswith(".png"))
    known = known.select("pos", "path", "video_id", F.col("frame_id").cast("string").alias("frame_id"), F.col("shot_id").cast("string").alias("shot_id"), (F.col("id") / 2).alias("score"))
    return shaping.resolve_contexts(paths, known).select("pos", "path", "video_id", "frame_id", "shot_id", "score")


@query("SELECT id AS pos, video_id, frame_id, shot_id, '' AS thumbnail, CASE WHEN id % 2 = 0 THEN id / 2.0::DOUBLE END AS distance FROM frames ORDER BY id LIMIT 100")
def context_echo(spark, sf_dir):
    f = bridge.frames(spark, sf_dir).select(F.col("id").alias("pos"), F.lit(None).cast("string").alias("path"), "video_id", "frame_id", "shot_id", F.when(F.col("id") % 2 == 0, F.col("id") / 2).alias("score"))
    return shaping.echo_context(f, 100)


def _convs(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    texts = F.transform("x", lambda t: t["text"])
    return c.select("conv_id", texts.alias("texts"), F.transform(texts, lambda t, i: F.when(i >= 2, F.upper(t)).otherwise(t)).alias("used"))


_PREFIX = f"SELECT conv_id, len(texts) AS n, coalesce(list_min(list_filter(list_transform(texts, lambda t, i: CASE WHEN t <> {STRIP.format('CASE WHEN i > 2 THEN upper(t) ELSE t END')} THEN i - 1 END), lambda x: x IS NOT NULL)), len(texts)) AS prefix_length FROM convs"


@query(f"SELECT conv_id, prefix_length FROM ({_PREFIX})")
def used_prefix(spark, sf_dir):
    return _convs(spark, sf_dir).select("conv_id", shaping.used_prefix(F.col("texts"), F.col("used")).alias("prefix_length"))


@query(f"SELECT conv_id, prefix_length < n AS stale FROM ({_PREFIX})")
def stale_check(spark, sf_dir):
    return _convs(spark, sf_dir).select("conv_id", shaping.is_stale(F.col("texts"), F.col("used")).alias("stale"))


@query(f"SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '2 click red 5 view' ELSE list_aggregate(list_transform(texts, lambda t: {STRIP.format('t')}), 'string_agg', ' ') END AS label FROM (SELECT conv_id, list_filter(list_transform(texts, lambda t, i: CASE WHEN i = list_position(texts, t) THEN t END), lambda x: x IS NOT NULL) AS texts FROM convs)")
def query_label(spark, sf_dir):
    wanted = F.array(*[F.struct(F.lit(q.query).alias("query"), F.lit(q.count).alias("count")) for q in WORDS])
    none = F.col("conv_id") % 3 == 0
    texts = F.when(none, F.array(F.lit(" "))).otherwise(F.col("texts"))
    return _convs(spark, sf_dir).select("conv_id", shaping.query_label(texts[0], texts, wanted).alias("label"))


@query("SELECT video_id, frame_id, object, n AS quantity FROM counts")
def object_index(spark, sf_dir):
    return objects.label_counts(objects.clean_detections(bridge.detections(spark, sf_dir)))


@query("SELECT video_id, frame_id, count(*) AS row_count, max(row_no) AS last_row, count(DISTINCT object) AS labels, string_agg(object, '|' ORDER BY row_no) AS in_order, round(sum(bbox_x), 6) AS box_sum FROM detections GROUP BY ALL")
def object_docs(spark, sf_dir):
    d = objects.object_docs(objects.clean_detections(bridge.detections(spark, sf_dir)))
    boxes = F.aggregate("detections", F.lit(0.0), lambda s, x: s + x["bbox"]["x"])
    return d.select("video_id", "frame_id", "row_count", "last_row", F.size("objects").cast("bigint").alias("labels"), F.array_join(F.transform("detections", lambda x: x["object"]), "|").alias("in_order"), F.round(boxes, 6).alias("box_sum"))


def _docs(spark, sf_dir):
    return objects.object_docs(objects.clean_detections(bridge.detections(spark, sf_dir)))


@query("SELECT video_id, frame_id, least > 0 AS all_matched, total FROM objects_of")
def object_match(spark, sf_dir):
    o = F.col("objects")
    return _docs(spark, sf_dir).select("video_id", "frame_id", objects.matches_all(WORDS, o).alias("all_matched"), sum((objects.matched_count(q.query, o) for q in WORDS), F.lit(0).cast("bigint")).alias("total"))


@query("SELECT video_id, frame_id, query, requested::BIGINT AS requested, matched FROM matched WHERE matched > 0")
def object_match_list(spark, sf_dir):
    return _docs(spark, sf_dir).select("video_id", "frame_id", F.explode(objects.match_list(WORDS, F.col("objects"))).alias("m")).select("video_id", "frame_id", "m.*")


@query("SELECT object, sum(n)::BIGINT AS quantity FROM counts GROUP BY 1")
def object_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode("objects").alias("object", "n")).groupBy("object").agg(F.sum(F.greatest("n", F.lit(1))).alias("quantity"))


@query(f"SELECT h.id, round(h.score, 6) AS distance, round(o.delta, 6) AS delta, row_number() OVER (ORDER BY h.score DESC, o.delta, h.retrieval_rank) AS place FROM ({_top_sql(0, 'frames', 100)}) h JOIN objects_of o ON o.video_id = h.video_id AND o.frame_id = h.frame_id::VARCHAR WHERE o.least > 0")
def object_delta_rank(spark, sf_dir):
    from pyspark.sql import Window

    hits = retrieval.top_k(bridge.frames(spark, sf_dir), _vectors(spark, sf_dir, 0)[0], 100)
    found = objects.filter_and_rank(hits, objects.clean_detections(bridge.detections(spark, sf_dir)), WORDS)
    place = F.row_number().over(Window.orderBy(F.col("distance").desc(), "object_count_delta", "retrieval_rank"))  # over at most 100 rows
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("object_count_delta", 6).alias("delta"), place.cast("bigint").alias("place"))


def _nearest(spark, sf_dir):
    return keyframes.nearest_keyframe(bridge.frames(spark, sf_dir).drop("embedding"), keyframes.usable_map(bridge.keyframe_map(spark, sf_dir)))


@query("SELECT id, keyframe_number FROM nearest")
def nearest_keyframe(spark, sf_dir):
    return _nearest(spark, sf_dir).select("id", "keyframe_number")


_TEMPLATE = "/keyframes/{video_id}/{keyframe_number:03d}.jpg?shot={shot_id}&f={frame_id}"
_THUMB = "'/keyframes/' || f.video_id || '/' || printf('%03d', k.keyframe_number) || '.jpg?shot=' || f.shot_id || '&f=' || f.frame_id"


@query(f"SELECT f.id, {_THUMB} AS thumbnail FROM frames f JOIN nearest k USING (id)")
def thumbnail_template(spark, sf_dir):
    return _nearest(spark, sf_dir).select("id", scalars.thumbnail(_TEMPLATE, F.col("video_id"), F.col("shot_id"), F.col("frame_id"), F.col("keyframe_number")).alias("thumbnail"))


@query("SELECT CASE WHEN id = 0 THEN video_id || ':' || shot_id || ':' || frame_id ELSE id::VARCHAR END AS result_id, frame_id, video_id, 1.0::DOUBLE AS score, video_id || ' frame ' || frame_id AS title, concat_ws(' ', nullif(asr_text, ''), nullif(ocr_text, '')) AS description, '/i/' || frame_id || '.jpg' AS thumbnail, 'Milvus hybrid search' AS reason, video_id AS \"videoId\", CASE WHEN shot_id = 0 THEN '' ELSE shot_id::VARCHAR END AS \"shotId\", '' AS \"videoUrl\", 0 AS matches, ocr_text AS raw_text, frame_id::VARCHAR AS raw_frame FROM frame_text")
def result_projection(spark, sf_dir):
    found = shaping.results(bridge.frame_text(spark, sf_dir), "/i/{frame_id}.jpg")
    return found.select("result_id", "frame_id", "video_id", "score", "title", "description", "thumbnail", F.array_join("reasons", "; ").alias("reason"), "videoId", "shotId", "videoUrl", F.size("objectMatches").alias("matches"), F.get_json_object("raw", "$.ocr_text").alias("raw_text"), F.get_json_object("raw", "$.frame_id").alias("raw_frame"))


_UI = "SELECT id, CASE WHEN id % 5 = 0 THEN '/x/' || id || '.png' WHEN keyframe_number IS NOT NULL AND id % 5 < 3 THEN '/keyframes/' || video_id || '/' || printf('%03d', keyframe_number) || '.jpg' ELSE '/keyframes/' || video_id || '/' || frame_id || '.png' END AS path FROM frames JOIN nearest USING (id)"


@query(_UI)
def ui_image_path(spark, sf_dir):
    i = F.col("id") % 5
    return _nearest(spark, sf_dir).select("id", shaping.ui_image_path(F.when(i == 0, F.concat(F.lit("/x/"), F.col("id").cast("string"), F.lit(".png"))), F.col("video_id"), F.col("frame_id"), F.when(i < 3, F.col("keyframe_number"))).alias("path"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN path ELSE 'http://m/base' || path END AS url FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'https://h/' || id || '.jpg' ELSE '/keyframes/' || video_id || '/' || frame_id || '.png' END AS path FROM frames)")
def static_url(spark, sf_dir):
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://h/"), F.col("id").cast("string"), F.lit(".jpg"))).otherwise(shaping.ui_image_path(F.lit(None), F.col("video_id"), F.col("frame_id"), F.lit(None).cast("bigint")))
    return bridge.frames(spark, sf_dir).select("id", scalars.joined_url("http://m/base/", path).alias("url"))


@query("SELECT video_id, frame_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY video_id) AS frames, coalesce(lag(frame_id) OVER w, frame_id) AS previous, coalesce(lead(frame_id) OVER w, frame_id) AS next FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)")
def filmstrip_neighbours(spark, sf_dir):
    return shaping.neighbours(bridge.frames(spark, sf_dir))


_KIND = "(['KIS', 'vqa', 'Trake', 'other', ''])[user_id % 5 + 1]"


def _kind():
    return F.element_at(F.array(*[F.lit(x) for x in ("KIS", "vqa", "Trake", "other", "")]), (F.col("user_id") % 5 + 1).cast("int"))


@query(f"SELECT event_id, CASE WHEN event_type = 'view' THEN 'VKIS' WHEN upper({_KIND}) IN ('KIS', 'VQA', 'TRAKE') THEN upper({_KIND}) ELSE 'KIS' END AS task FROM events")
def request_task(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").select("event_id", shaping.request_task(_kind(), F.col("event_type") == "view").alias("task"))


@query("SELECT conv_id, turn, CASE WHEN len(text) % 3 = 0 THEN 'en: ' || text ELSE text END AS translated FROM conversations")
def translate_fallback(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "conversations")
    entries = c.where(F.char_length("text") % 3 == 0).select(F.col("text").alias("source"), F.concat(F.lit("en: "), "text").alias("target"))
    return shaping.translate(c, entries).select("conv_id", "turn", "translated")


@query("SELECT task_id, task_type, first_relevant_rank, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_at_10, 6) AS ndcg_at_10, recall_at_1, recall_at_5, recall_at_10 FROM scored")
def eval_per_task(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6)).withColumn("ndcg_at_10", F.round("ndcg_at_10", 6))


def _rankings(spark, sf_dir):
    found = retrieval.top_k_batch(bridge.frames(spark, sf_dir), bridge.queries(spark, sf_dir), 51).where("id <> query_id")
    return found.select(F.col("query_id").cast("string").alias("task_id"), "video_id", F.col("frame_id").cast("string").alias("frame_id"), F.col("retrieval_rank").alias("pos"))


def _scored(spark, sf_dir):
    return evaluate.per_task(bridge.tasks(spark, sf_dir), bridge.relevant(spark, sf_dir), _rankings(spark, sf_dir), KS)


@query("SELECT task_type, count(*) AS task_count, " + ", ".join(f"round(avg(recall_at_{k}), 6) AS recall_at_{k}" for k in KS) + ", round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM scored GROUP BY GROUPING SETS ((task_type), ())")
def eval_summary(spark, sf_dir):
    s = evaluate.summary(_scored(spark, sf_dir), KS)
    return s.select("task_type", "task_count", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("task_type", "task_count")])


@query("SELECT task_id, pos, occurrence <= coalesce(there, 0) AS hit FROM (SELECT task_id, pos, video_id, frame_id, row_number() OVER (PARTITION BY task_id, video_id, frame_id ORDER BY pos) AS occurrence FROM (SELECT task_id, video_id, frame_id, rank * 2 AS pos FROM rankings UNION ALL SELECT task_id, video_id, frame_id, rank * 2 + 1 FROM rankings)) LEFT JOIN (SELECT task_id, video_id, frame_id, count(*) AS there FROM relevant GROUP BY ALL) USING (task_id, video_id, frame_id)")
def eval_hit_sequence(spark, sf_dir):
    return evaluate.hit_sequence(_twice(spark, sf_dir), bridge.relevant(spark, sf_dir)).select("task_id", "pos", "hit")


def _twice(spark, sf_dir):
    r = _rankings(spark, sf_dir)
    from pyspark.sql import Window

    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy("pos")).cast("bigint"))
    return r.withColumn("pos", F.explode(F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)))


@query("SELECT task_id, video_id, frame_id::VARCHAR AS frame_id, rank FROM rankings")
def eval_dedup_candidates(spark, sf_dir):
    return evaluate.ranked_candidates(_twice(spark, sf_dir)).select("task_id", "video_id", "frame_id", "rank")


@query("SELECT task_id, only_in FROM (SELECT coalesce(t.task_id, r.task_id) AS task_id, CASE WHEN r.task_id IS NULL THEN 'tasks' WHEN t.task_id IS NULL THEN 'rankings' END AS only_in FROM (SELECT task_id FROM tasks) t FULL JOIN (SELECT DISTINCT conv_id::VARCHAR AS task_id FROM conversations) r ON t.task_id = r.task_id) WHERE only_in IS NOT NULL")
def eval_id_set_diff(spark, sf_dir):
    other = bridge.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("task_id"))
    return evaluate.id_differences(bridge.tasks(spark, sf_dir), other)


@query("SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.8::DOUBLE / (tf + 1.8::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM words) WHERE term IN ('idiot', 'license', 'token') GROUP BY 1, 2) JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY 1) USING (term) CROSS JOIN (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words) GROUP BY 1) ORDER BY s DESC, doc_id LIMIT 20".replace("words", "(SELECT doc_id, " + TOKENS.format("text") + " AS w FROM documents)"))
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25(bridge.table(spark, sf_dir, "documents"), "doc_id", "text", "idiot license token", 20)
    return found.select("doc_id", F.round("score", 6).alias("score"))


_BATCH = {1: "idiot license token", 2: "The old house, a river", 3: "privacy secrets", 4: "zzzz"}
_TERMS = "SELECT DISTINCT query_id, unnest(" + TOKENS.format("query") + ") AS term FROM (VALUES " + ", ".join(f"({k}, '{q}')" for k, q in _BATCH.items()) + ") q(query_id, query)"


@query(("SELECT query_id, doc_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM (SELECT t.query_id, p.doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.8::DOUBLE / (tf + 1.8::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM words) GROUP BY 1, 2) p JOIN (" + _TERMS + ") t USING (term) JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY 1) USING (term) CROSS JOIN (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words) GROUP BY 1, 2)) WHERE rank <= 20").replace("words", "(SELECT doc_id, " + TOKENS.format("text") + " AS w FROM documents)"))
def bm25_batch(spark, sf_dir):
    asked = spark.createDataFrame(list(_BATCH.items()), "query_id long, query string")
    index = retrieval.postings(bridge.table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.bm25_batch(index, asked, "doc_id", 20).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query()
def ann_topk(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    centroids = ann.fit_centroids(f)
    found = ann.search_batch(ann.with_cell(f, centroids), centroids, bridge.queries(spark, sf_dir), 10, ann.fit_probes(f, centroids))
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "retrieval_rank")


@query(f"SELECT doc_id, len(w) AS tokens, len(list_distinct(w)) AS distinct_tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)")
def token_counts(spark, sf_dir):
    w = scalars.tokens(F.col("text"))
    return bridge.table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("bigint").alias("tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct_tokens"))


@query("SELECT id, round(s, 6) AS score FROM (SELECT f.id, " + COS.format("f.embedding", "a.e") + " * 0.7::DOUBLE + list_dot_product(f.embedding, b.e) * 0.3::DOUBLE AS s FROM frames f CROSS JOIN (SELECT embedding AS e FROM frames WHERE id = 0) a CROSS JOIN (SELECT embedding AS e FROM frames WHERE id = 1) b) ORDER BY s DESC, id LIMIT 20")
def weighted_fusion(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    a, b = (vectors.as_vector(v) for v in _vectors(spark, sf_dir, 0, 1))
    e = vectors.as_vector(F.col("embedding"))
    return retrieval.fuse_scores(f, [vectors.cosine(e, a), vectors.inner(e, b)], [0.7, 0.3], 20).select("id", F.round("score", 6).alias("score"))


@query("SELECT id, round(sum(w * s), 6) AS score FROM (SELECT 0.7::DOUBLE AS w, id, score AS s FROM (" + _top_sql(0, "frames", 50) + ") UNION ALL SELECT 0.3::DOUBLE, id, score FROM (" + _top_sql(1, "frames", 50) + ")) GROUP BY id ORDER BY sum(w * s) DESC, id LIMIT 20")
def hit_fusion(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    lists = [retrieval.top_k(f, v, 50).select("id", F.col("distance").alias("score")) for v in _vectors(spark, sf_dir, 0, 1)]
    return retrieval.fuse(lists, [0.7, 0.3], 20).select("id", F.round("score", 6).alias("score"))


@query("SELECT video_id, left_id, right_id, round(similarity, 6) AS similarity, similarity > 0.4 AS duplicate FROM pairs")
def adjacent_dedup(spark, sf_dir):
    p = corpus.adjacent_pairs(bridge.frames(spark, sf_dir))
    return p.select("video_id", "left_id", "right_id", F.round("similarity", 6).alias("similarity"), (F.col("similarity") > corpus.DUPLICATE).alias("duplicate"))


@query("SELECT video_id, count(DISTINCT shot_id) AS shots, count(*) AS frames, count(*) FILTER (right_id IS NULL) AS kept, count(right_id) AS duplicates FROM frames f LEFT JOIN (SELECT right_id FROM pairs WHERE similarity > 0.4) p ON p.right_id = f.id GROUP BY 1")
def dedup_stats(spark, sf_dir):
    return corpus.dedup_stats(corpus.with_status(bridge.frames(spark, sf_dir)))


@query("SELECT id, video_id, frame_id, shot_id, len(embedding) AS numbers, CAST(NULL AS VARCHAR) AS ocr_text FROM frames f WHERE id NOT IN (SELECT right_id FROM pairs WHERE similarity > 0.4)")
def build_corpus(spark, sf_dir):
    kept, _ = corpus.build_corpus(bridge.frames(spark, sf_dir))
    return kept.select("id", "video_id", "frame_id", "shot_id", F.size("embedding").cast("bigint").alias("numbers"), "ocr_text")


@query("SELECT f.id, CASE WHEN f.frame_id % 1000 < 900 THEN f.frame_id // 1000 END AS shot FROM frames f")
def shots_of_frames(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    k = F.floor(F.col("frame_id") / 1000)
    shots = f.select("video_id", k.alias("shot_id"), (k * 1000).alias("start"), (k * 1000 + 899).alias("end")).distinct()
    return corpus.shots_of_frames(f, shots).select("id", F.col("shot_id").alias("shot"))


_SHAPES = "CASE event_id % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"


@query("SELECT label, sum(n)::BIGINT AS quantity FROM (SELECT event_type AS label, " + _SHAPES.format(3, 3, 4, 0) + " AS n FROM events WHERE event_id % 4 < 3 UNION ALL SELECT 'x', 1 FROM events WHERE event_id % 4 = 0) GROUP BY 1")
def object_summary_shapes(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("event_id") % 4
    shape = lambda text: F.format_string(text, *[kind] * text.count("%s"))
    doc = F.when(k == 0, shape('{"objects": {" %s": "3", "X": 0}}')).when(k == 1, shape('{"labels": ["%s", 5, {"name": "%s", "count": 2}]}')).when(k == 2, shape('{"objects": [], "detections": [{"object": "%s", "quantity": 4.7}]}')).otherwise(F.lit("oops"))
    found = bridge.table(spark, sf_dir, "events").select(F.explode(objects.summary(doc)).alias("label", "n"))
    return found.groupBy("label").agg(F.sum("n").alias("quantity"))


_SAID = "SELECT query_id // 50 AS i, task_id, CASE WHEN query_id // 50 % 13 = 0 THEN 'x' || task_id ELSE task_id END AS ranked_id FROM tasks"


@query(
    "SELECT DISTINCT message, \"order\" FROM (SELECT CASE WHEN i % 7 = 0 THEN 'task_id ' || task_id || ' requires at least one relevant frame' END AS message, 6 AS \"order\" FROM ("
    + _SAID + ") UNION ALL SELECT 'ranking for task_id ' || ranked_id || ' requires results', 4 FROM (" + _SAID + ") WHERE i % 5 = 4 UNION ALL SELECT 'task card and ranking task_ids must match', 5 FROM (" + _SAID + ") WHERE i % 13 = 0"
    + " UNION ALL SELECT 'each frame requires video_id and frame_id', 7 FROM (" + _SAID + ") WHERE i % 7 = 5 UNION ALL SELECT 'relevance must be a positive integer', 8 FROM (" + _SAID + ") WHERE i % 7 IN (1, 2, 3) UNION ALL SELECT 'duplicate relevant frame for task_id ' || task_id, 9 FROM (" + _SAID + ") WHERE i % 7 = 4"
    + " UNION ALL SELECT 'ranking results must be a list', 10 FROM (" + _SAID + ") WHERE i % 5 IN (0, 1) UNION ALL SELECT 'each frame requires video_id and frame_id', 11 FROM (" + _SAID + ") WHERE i % 5 = 2 UNION ALL SELECT 'task card requires task_type', 12 FROM (" + _SAID + ") WHERE i % 11 = 0) WHERE message IS NOT NULL"
)
def eval_violations(spark, sf_dir):
    i = F.floor(F.col("query_id") / 50)
    one_of = lambda n, texts: F.parse_json(F.element_at(F.array(*[F.lit(t) for t in texts]), (i % n + 1).cast("int")))
    frame = '[{"video_id": "v", "frame_id": 1%s}]'
    relevant = one_of(7, ["[]", frame % ', "relevance": true', frame % ', "relevance": "2"', frame % ', "relevance": 1.5', '[{"video_id": "v", "frame_id": 1}, {"videoId": "v", "frameId": "1"}]', '[{"video_id": "", "frame_id": 1}]', frame % ', "relevance": 2'])
    t = bridge.tasks(spark, sf_dir)
    cards = t.select("task_id", F.when(i % 11 == 0, F.parse_json(F.lit("5"))).otherwise(F.parse_json(F.lit('"KIS"'))).alias("task_type"), relevant.alias("relevant_frames"))
    results = F.when(i % 5 < 4, one_of(5, ["null", '"oops"', '[{"videoId": "v", "frameId": ""}]', "[]", "0"]))
    ranked = t.select(F.when(i % 13 == 0, F.concat(F.lit("x"), "task_id")).otherwise(F.col("task_id")).alias("task_id"), results.alias("results"))
    return evaluate.violations(cards, ranked)


def _cases(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), "role", F.col("conv_id").alias("path"), F.col("turn").alias("pos"))


@query("SELECT case_id, role, place FROM (SELECT conv_id || '-' || turn AS case_id, role FROM conversations) JOIN (VALUES ('1-1', 1), ('0-0', 2), ('2-0', 3)) s(case_id, place) USING (case_id)")
def case_selection(spark, sf_dir):
    from . import request

    asked = ["1-1", "0-0", "2-0"]
    found = request.select_cases(_cases(spark, sf_dir), " 1-1, 0-0,1-1,,2-0")
    return found.select("case_id", "role", F.array_position(F.array(*[F.lit(x) for x in asked]), F.col("case_id")).alias("place"))


_RAW = "(CASE event_id % 6 WHEN 0 THEN lpad(event_id::VARCHAR, 8, '0') WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN event_id || '.7' WHEN 3 THEN '' WHEN 4 THEN event_type ELSE '-' || event_id END)"


def _raw():
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 6
    return F.when(k == 0, F.lpad(n, 8, "0")).when(k == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 2, F.concat(n, F.lit(".7"))).when(k == 3, F.lit("")).when(k == 4, F.col("event_type")).otherwise(F.concat(F.lit("-"), n))


_CANON = f"CASE WHEN regexp_full_match(trim({_RAW}), '[0-9]+') THEN trim({_RAW})::BIGINT::VARCHAR ELSE trim({_RAW}) END"


@query(f"SELECT event_id, {_CANON} AS canonical, CASE WHEN {_CANON} <> '' THEN event_type || ':frame:' || {_CANON} WHEN event_id % 2 = 0 THEN event_type || ':shot:' || user_id ELSE 'id:' || event_id END AS submit_key FROM events")
def canonical_ids(spark, sf_dir):
    shot = F.when(F.col("event_id") % 2 == 0, F.col("user_id"))
    return bridge.table(spark, sf_dir, "events").select("event_id", scalars.canonical_id(_raw()).alias("canonical"), answers.submit_key(F.col("event_type"), _raw(), shot, F.col("event_id")).alias("submit_key"))


_INT = f"CASE WHEN regexp_full_match(trim({_RAW}), '[+-]?[0-9]+') THEN trim({_RAW})::BIGINT END"


@query(f"SELECT event_id, {_INT} AS as_int, TRY_CAST(nullif(trim({_RAW}), '') AS DOUBLE) AS as_real, greatest(coalesce({_INT}, 1), 1) AS amount, CASE WHEN event_id % 3 > 0 THEN trunc(value)::BIGINT END AS of_double, event_id AS of_long, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS of_boolean FROM events")
def safe_casts(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").select("event_id", scalars.whole_number(_raw()).alias("as_int"), scalars.real_number(_raw()).alias("as_real"), scalars.count_of(_raw()).alias("amount"),
        scalars.whole_number(F.when(F.col("event_id") % 3 > 0, F.col("value")).otherwise(F.lit(float("nan")))).alias("of_double"), scalars.whole_number(F.col("event_id")).alias("of_long"), scalars.whole_number(F.col("event_id") % 2 == 0).alias("of_boolean"))


@query(f"SELECT event_id, CASE WHEN {_INT} > 0 THEN {_INT} ELSE 1 END AS quantity, ({_RAW} <> '' OR event_id % 2 = 0) AS identified FROM events")
def quantity_identity(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").select("event_id", answers.quantity(_raw()).alias("quantity"), answers.has_identity(_raw(), F.when(F.col("event_id") % 2 == 0, F.col("user_id"))).alias("identified"))


@query(f"SELECT event_type AS video_id, string_agg(f::VARCHAR, ',' ORDER BY f) AS frame_ids FROM (SELECT DISTINCT event_type, {_INT} AS f FROM events) WHERE f IS NOT NULL GROUP BY 1")
def trake_grouping(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events").select(F.col("event_type").alias("video_id"), _raw().alias("frame_id"))
    return answers.trake_groups(e).select("video_id", F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"))


@query("SELECT key FROM (SELECT DISTINCT user_id AS key FROM events UNION ALL SELECT event_id AS key FROM events WHERE event_type = 'click') GROUP BY key HAVING count(*) % 2 = 1")
def trake_toggle(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "events")
    return answers.toggled(e.select(F.col("user_id").alias("key")), e.where("event_type = 'click'").select(F.col("event_id").alias("key")))


@query(f"SELECT event_type AS query_name, event_id AS row, rule FROM (SELECT event_type, event_id, unnest(list_filter([CASE WHEN event_id % 7 = 0 THEN 'columns' END, CASE WHEN user_id % 4 = 0 THEN 'video' END, CASE WHEN NOT regexp_full_match({_RAW}, '[0-9]+') THEN 'frame' END, CASE WHEN event_id % 7 = 0 OR NOT len(props) BETWEEN 1 AND 100 THEN 'answer' END], lambda x: x IS NOT NULL)) AS rule FROM events) UNION ALL SELECT event_type, NULL, 'rows' FROM events GROUP BY 1 HAVING count(*) > 100")
def submission_violations(spark, sf_dir):
    video = F.when(F.col("user_id") % 4 == 0, F.lit("")).otherwise(F.lit("L01_V001"))
    cells = F.when(F.col("event_id") % 7 == 0, F.array(video, _raw())).otherwise(F.array(video, _raw(), F.col("props")))
    rows = bridge.table(spark, sf_dir, "events").select(F.col("event_type").alias("query_name"), F.col("event_id").alias("row"), cells.alias("cells"))
    return answers.submission_violations(rows, "QA")


@query(f"SELECT event_id AS row, CASE WHEN event_id % 4 = 0 THEN 'r' || event_id WHEN event_id % 4 = 1 THEN concat_ws(':', event_type, nullif({_RAW}, '')) WHEN nullif({_RAW}, '') IS NOT NULL THEN {_RAW} END AS submission_id, upper(coalesce(nullif({_KIND}, ''), 'KIS')) AS task, CASE WHEN event_id % 4 >= 2 AND {_RAW} = '' THEN 'submit requires id, frameId/frame_id, shotId/shot_id, or videoId/video_id' END AS error FROM events")
def submit_kis(spark, sf_dir):
    k = F.col("event_id") % 4
    rows = bridge.table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.when(k == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("id"), _raw().alias("frame_id"), F.lit(None).cast("string").alias("shot_id"), F.when(k == 1, F.col("event_type")).alias("video_id"), _kind().alias("task"))
    return answers.submit_kis(rows).select("row", "submission_id", "task", "error")


@query(f"SELECT event_id AS row, 'VQA' AS task, CASE WHEN user_id % 5 = 0 THEN 'submit_vqa requires video_id' WHEN {_RAW} = '' THEN 'submit_vqa requires frame_id' WHEN user_id % 5 = 1 THEN 'submit_vqa requires a non-empty answer' END AS error FROM events")
def submit_vqa(spark, sf_dir):
    k = F.col("user_id") % 5
    rows = bridge.table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.when(k != 0, F.col("event_type")).alias("video_id"), _raw().alias("frame_id"), F.when(k == 1, F.lit("")).otherwise(F.lit("0")).alias("answer"))
    return answers.submit_vqa(rows).select("row", "task", "error")


@query("SELECT event_id AS row, 'TRAKE' AS task, CASE WHEN user_id % 5 = 0 THEN 'submit_trake requires video_id' WHEN user_id % 5 = 1 THEN 'submit_trake requires at least one frame_id' END AS error FROM events")
def submit_trake(spark, sf_dir):
    k = F.col("user_id") % 5
    rows = bridge.table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), F.when(k != 0, F.col("event_type")).alias("video_id"), F.when(k == 1, F.array().cast("array<bigint>")).otherwise(F.array("event_id")).alias("frame_ids"))
    return answers.submit_trake(rows).select("row", "task", "error")


@query()
def encode_texts(spark, sf_dir):
    encoder = encoders.HistogramEncoder()
    return bridge.table(spark, sf_dir, "documents").select("doc_id", encoders.encode_column(encoder, F.col("text")).alias("embedding"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a staged search of three queries, objects matched and ranked, results shaped."""
    hits = retrieval.staged(bridge.frames(spark, sf_dir), _vectors(spark, sf_dir, 0, 1, 2), 100)
    return shaping.results(objects.filter_and_rank(hits, objects.clean_detections(bridge.detections(spark, sf_dir)), [objects.ObjectQuery("view")]), "/i/{frame_id}.jpg")
