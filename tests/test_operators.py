import base64
import hashlib
import json
import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framequery.functions import encoders, scalars, vectors
from framequery.operators import ann, answers, corpus, evaluate, keyframes, objects, retrieval, shaping
from framequery.plans import commands, request
from framequery.sources import readers, writers

CARD = {"task_id": "kis-001", "task_type": "KIS", "relevant_frames": [{"video_id": "L21_V001", "frame_id": "100", "relevance": 2}, {"video_id": "L21_V002", "frame_id": "200", "relevance": 1}]}
RANKING = {"task_id": "kis-001", "results": [{"video_id": "L21_V999", "frame_id": "1"}, {"video_id": "L21_V002", "frame_id": "200"}, {"video_id": "L21_V001", "frame_id": "100"}]}


def lines(tmp_path, name, records):
    path = tmp_path / name
    path.write_text("".join(json.dumps(r) + "\n\n" for r in records), encoding="utf-8")
    return str(path)


def scored(spark, tmp_path, cards, rankings, ks):
    return evaluate.evaluate(readers.read_json_lines(spark, lines(tmp_path, "t.jsonl", cards), readers.TASK_CARD), readers.read_json_lines(spark, lines(tmp_path, "r.jsonl", rankings), readers.RANKING), ks)


def test_golden_metrics(spark, tmp_path):
    rows, total = scored(spark, tmp_path, [CARD], [RANKING], [3, 1, 2])
    r = rows.collect()[0]
    assert (r["recall_at_1"], r["recall_at_2"], r["recall_at_3"], r["first_relevant_rank"], r["reciprocal_rank"]) == (0.0, 1.0, 1.0, 2, 0.5)
    assert math.isclose(r["ndcg_at_3"], 0.58688267143572)
    assert {t["task_type"]: t["mrr"] for t in total.collect()} == {None: 0.5, "KIS": 0.5}
    numbers = [RANKING | {"task_id": 7, "results": [{"video_id": "L21_V001", "frame_id": 100}]}]
    rows, _ = scored(spark, tmp_path, [CARD | {"task_id": " 7 "}], numbers, [1])
    assert rows.first()["task_id"] == "7" and rows.first()["recall_at_1"] == 1.0  # ids are compared as texts


def test_types_and_empty_results(spark, tmp_path):
    other = CARD | {"task_id": "vqa-1", "task_type": "vqa"}
    rankings = [RANKING | {"results": [{"videoId": "L21_V001", "frameId": "100"}]}, {"task_id": "vqa-1", "results": []}]
    _, total = scored(spark, tmp_path, [CARD, other], rankings, [1])
    assert {t["task_type"]: t["recall_at_1"] for t in total.collect()} == {None: 0.5, "KIS": 1.0, "VQA": 0.0}


@pytest.mark.parametrize(
    ("cards", "rankings", "said"),
    [
        ([], [RANKING], "task cards must not be empty"),
        ([CARD], [], "rankings must not be empty"),
        ([CARD], [RANKING | {"task_id": "x"}], "task_ids must match"),
        ([CARD, CARD], [RANKING], "duplicate task card for task_id: kis-001"),
        ([CARD], [RANKING, RANKING], "duplicate ranking for task_id: kis-001"),
        ([CARD | {"relevant_frames": []}], [RANKING], "requires at least one relevant frame"),
        ([CARD | {"task_type": " "}], [RANKING], "task card requires task_type"),
        ([CARD | {"relevant_frames": [CARD["relevant_frames"][0]] * 2}], [RANKING], "duplicate relevant frame"),
        *[([CARD | {"relevant_frames": [CARD["relevant_frames"][0] | {"relevance": x}]}], [RANKING], "relevance must be a positive integer") for x in (0, -1, True, 1.5, "2", None, [1])],
        ([CARD | {"relevant_frames": "oops"}], [RANKING], "requires at least one relevant frame"),
        ([CARD | {"task_type": 5}], [RANKING], "task card requires task_type"),
        ([CARD | {"task_id": " "}], [RANKING], "each task card and ranking requires task_id"),
        ([CARD], [RANKING | {"results": [{"video_id": "", "frame_id": "1"}]}], "each frame requires video_id and frame_id"),
        ([CARD], [RANKING | {"results": [{"video_id": "v"}]}], "each frame requires video_id and frame_id"),
        ([CARD], [RANKING | {"results": [{"video_id": None, "videoId": "v", "frame_id": 1}]}], "each frame requires video_id and frame_id"),
        ([CARD], [RANKING | {"results": None}], "ranking results must be a list"),
        ([CARD], [RANKING | {"results": "oops"}], "ranking results must be a list"),
        ([CARD], [{"task_id": "kis-001"}], "ranking for task_id kis-001 requires results"),
    ],
)
def test_input_errors(spark, tmp_path, cards, rankings, said):
    with pytest.raises(ValueError, match=said):
        scored(spark, tmp_path, cards, rankings, [1])


@pytest.mark.parametrize("ks", [[], [0], [True], [1.5]])
def test_bad_k(ks):
    with pytest.raises(ValueError, match="k values must contain positive integers"):
        evaluate.k_values(ks)


def test_hits_claim_each_evidence_once(spark):
    c = spark.createDataFrame([("t", "V1", "100", 1), ("t", "V2", "200", 2), ("t", "V2", "200", 3)], "task_id string, video_id string, frame_id string, pos int")
    g = spark.createDataFrame([("t", "V2", "200"), ("t", "V1", "100")], "task_id string, video_id string, frame_id string")
    assert [r["hit"] for r in evaluate.hit_sequence(c, g).orderBy("pos").collect()] == [True, True, False]


@pytest.mark.parametrize("split", ["134217728", "64"])
def test_bad_lines_are_named(spark, tmp_path, split):
    bad = tmp_path / "x.jsonl"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # a file in many splits
    try:
        for text, said in (('{"task_id": "a"}\n\n' * 20 + "{oops\n", "invalid JSON in .* at line 41"), ('{"task_id": "a"}\n[1]\n', "at line 2 must be an object"), ('{"task_id": "a"}\n5\n{oops', "at line 2 must be an object")):
            bad.write_text(text)
            with pytest.raises(ValueError, match=said):
                readers.read_json_lines(spark, str(bad), readers.TASK_CARD)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cases_are_named_where_they_are_wrong(spark, tmp_path):
    with pytest.raises(ValueError, match="no case files found under"):
        readers.read_cases(spark, str(tmp_path))
    (tmp_path / "b").mkdir()
    (tmp_path / "a.jsonl").write_text('{"case_id": "c1"}\n\n{"case_id": "c2"}\n')
    second = tmp_path / "b" / "z.jsonl"
    for text, said in (('{"case_id": "c3"}\n{x', "invalid JSON in .*z.jsonl at line 2"), ('{"case_id": "c3"}\n\n{"case_id": 5}', "z.jsonl line 3 requires a non-empty case_id"), ('{"case_id": "c2"}', "duplicate case_id c2 in .*z.jsonl")):
        second.write_text(text)
        with pytest.raises(ValueError, match=said):
            readers.read_cases(spark, str(tmp_path))
    second.write_text('{"case_id": "c0", "expected_track": ["1"]}')
    cases = readers.read_cases(spark, str(tmp_path))
    ids = lambda asked: [r["case_id"] for r in request.select_cases(cases, asked).collect()]
    assert ids(None) == ["c1", "c2", "c0"] and ids("c0, c1,c0") == ["c0", "c1"]
    with pytest.raises(ValueError, match="at least one case_id"):
        request.select_cases(cases, " , ")
    with pytest.raises(ValueError, match=r"unknown case_id\(s\): y, x$"):
        request.select_cases(cases, "c1,y,x")


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/keyframes/L21_V001/12/345.jpg", ("L21_V001", "345", "12")),
        ("/keyframes/L21_V001/001.jpg", ("L21_V001", "001", None)),
        ("http://h/keyframes/L21_V001/12/345.jpg?x=1", ("L21_V001", "345", "12")),
        ("345", (None, "345", None)),
        ("  ", (None, None, None)),
    ],
)
def test_paths(spark, path, want):
    r = spark.createDataFrame([(path,)], "p string").select(scalars.path_parts(F.col("p")).alias("x")).first()["x"]
    assert (r["video_id"], r["frame_id"], r["shot_id"]) == want


def test_nearest_keyframe(spark):
    rows = [("L22_V024", "174", "17525", 0), ("L22_V024", "175", "17627", 1), ("T", "1", "10", 0), ("T", "2", "20", 1), ("B", "1", "5", 0), ("B", "x", "7", 1)]
    keys = spark.createDataFrame(rows, "video_id string, n string, frame_idx string, file_order long")
    asked = spark.createDataFrame([("L22_V024", "17630"), ("T", "15"), ("T", "9"), ("B", "5"), ("none", "5"), ("T", "x")], "video_id string, frame_id string")
    got = {(r["video_id"], r["frame_id"]): r["keyframe_number"] for r in keyframes.nearest_keyframe(asked, keyframes.usable_map(keys)).collect()}
    assert got == {("L22_V024", "17630"): 175, ("T", "15"): 1, ("T", "9"): 1, ("B", "5"): None, ("none", "5"): None, ("T", "x"): None}
    lenient = keyframes.nearest_keyframe(asked, keyframes.usable_map(keys, lenient=True))
    assert lenient.where("video_id = 'B'").first()["keyframe_number"] == 1


def test_nearest_keyframe_against_model(spark):
    rng = random.Random(5)
    keys = [(v, i + 1, rng.randrange(300), i) for v in "ab" for i in range(40)]
    asked = [(v, rng.randrange(-20, 330)) for v in "ab" for _ in range(60)]
    got = keyframes.nearest_keyframe(spark.createDataFrame(asked, "video_id string, frame_id long"), keyframes.usable_map(spark.createDataFrame(keys, "video_id string, n long, frame_idx long, file_order long"))).collect()
    for r in got:
        want = min((k for k in keys if k[0] == r["video_id"]), key=lambda k: (abs(k[2] - r["frame_id"]), k[3]))[1]
        assert r["keyframe_number"] == want


def test_thumbnail_padding(spark):
    row = spark.range(1).select(*[scalars.thumbnail("/k/{video_id}/{keyframe_number:03d}.jpg", F.lit("v"), F.lit(None), F.lit(1), F.lit(n).cast("int")).alias(f"c{i}") for i, n in enumerate((1, 175, 12345, None))]).first()
    assert list(row) == ["/k/v/001.jpg", "/k/v/175.jpg", "/k/v/12345.jpg", ""]


def test_detections_file(spark, tmp_path):
    path = tmp_path / "objects.csv"
    path.write_text("﻿video_id, frame_id ,object,quantity,bbox_x,bbox_y,bbox_w,bbox_h\nL21_V01,001, Car ,3,110,12.0,x,1\nL21_V01,001,car,1,1,1,1,1\nL21_V01,002,,1,1,1,1,1\n", encoding="utf-8")
    docs = objects.object_docs(objects.clean_detections(readers.read_detections(spark, str(path)))).collect()
    assert [(d["frame_id"], d["objects"], d["row_count"], d["last_row"]) for d in docs] == [("001", {"car": 2}, 2, 3)]
    box = docs[0]["detections"][0]["bbox"]
    assert (box["y"], box["w"]) == (12.0, None)
    by_column = objects.label_counts(objects.clean_detections(readers.read_detections(spark, str(path)), "column")).collect()
    assert by_column[0]["quantity"] == 4
    path.write_text("video_id,frame_id\na,b\n")
    with pytest.raises(ValueError, match=r"objects.csv is missing required columns: object, quantity"):
        readers.read_detections(spark, str(path))


def test_object_matching(spark):
    o = spark.createDataFrame([({"red car": 2, "car": 1, "dog": 4},)], "o map<string,bigint>")
    r = o.select(*[objects.matched_count(q, F.col("o")).alias(n) for n, q in (("car", "car"), ("red", "car red"), ("cat", "cat"), ("marks", "!!"))], objects.count_delta([objects.ObjectQuery("dog", 3), objects.ObjectQuery("cat", 2)], F.col("o")).alias("d")).first()
    assert (r["car"], r["red"], r["cat"], r["marks"]) == (3, 2, 0, 7)
    assert math.isclose(r["d"], 1 / 3 + 1)
    assert objects.normalised([objects.ObjectQuery(" Car ", 0)], ["x"]) == [objects.ObjectQuery("car", 1)]


def model_stage(rows, vector, k, allowed=None):
    def score(r):
        return sum(a * b for a, b in zip(r[4], vector, strict=True)) / max(math.hypot(*r[4]) * math.hypot(*vector), 1e-12)

    return sorted((r for r in rows if allowed is None or (r[1], r[3]) in allowed), key=lambda r: (-score(r), r[1], r[2]))[:k]


@pytest.mark.parametrize("seed", range(3))
def test_staged_search_against_model(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"v{i % 3}", i * 5, i // 4, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    stages = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    frames = spark.createDataFrame(rows, "id long, video_id string, frame_id long, shot_id long, embedding array<double>")
    want = model_stage(rows, stages[0], 5)
    for i in (1, 2):
        allowed = {(r[1], s) for r in want for s in range(r[3], r[3] + 3 - i + 3)}
        want = model_stage(rows, stages[i], 5, allowed)
    got = retrieval.staged(frames, stages, 5).orderBy("retrieval_rank").collect()
    assert [r["id"] for r in got] == [r[0] for r in want]


def test_encoder_counts_all_words():
    encoder = encoders.HistogramEncoder()
    start = " ".join(f"w{i}" for i in range(64))
    a, b, again = encoder.encode_texts([start, start + " and what follows", start + " and what follows"])
    assert (a != b).any() and (b == again).all()
    long = [f"w{i}" for i in range(20000)]
    both = encoder.encode_texts([" ".join(long), " ".join(long[:-500])])
    assert (both[0] != both[1]).any() and abs(np.linalg.norm(both, axis=1) - 1).max() < 1e-5
    assert encoder.encode_texts([""]).tolist() == [[0.0] * encoder.dimension] and encoder.encode_texts([]).shape == (0, encoder.dimension)


def test_requests(spark):
    encoder = encoders.HistogramEncoder()
    texts = ["red car", "blue car", "a dog", "red dog"]
    rows = [(i, "v", i, i, "x", t, v.tolist()) for i, (t, v) in enumerate(zip(texts, encoder.encode_texts(texts), strict=True))]
    frames = spark.createDataFrame(rows, "id long, video_id string, frame_id long, shot_id long, asr_text string, ocr_text string, embedding array<float>")
    top = request.search_text(spark, frames, request.QueryRequest(query="a dog", top_k=2), encoder)
    assert top.query == "a dog"
    assert top.results.collect()[0]["frame_id"] == 2
    with pytest.raises(ValueError, match="query text or object query is required"):
        request.search_text(spark, frames, request.QueryRequest(), encoder)
    with pytest.raises(RuntimeError, match="embedding encoder is not loaded"):
        request.search_text(spark, frames, request.QueryRequest(query="x"), None)
    with pytest.raises(RuntimeError, match="object_index is required for object queries"):
        request.search_text(spark, frames, request.QueryRequest(query="x", objects=("car",)), encoder)
    echo = request.QueryRequest(queries=("a", "b"), used_queries=("a", "b"), frames_path=("/keyframes/v/3/7.jpg",))
    assert [r["frame_id"] for r in request.search_text(spark, frames, echo, encoder).results.collect()] == ["7"]
    seen = request.search_visual(frames, request.VisualRequest(image_embedding=tuple(rows[1][6]), image_cue={"name": "cue"}, top_k=1), encoder)
    assert (seen.query, seen.results.first()["frame_id"]) == ("cue", 1)
    for cue, said in (({}, "requires imageCue.dataUrl/base64 or imageEmbedding"), ({"data": "x"}, "requires imageCue"), ({"content": "%%%"}, "invalid base64"), ({"base64": 5}, "invalid base64"), ({"dataUrl": "data:image/png;base64,aGVsbG8="}, "could not be decoded")):
        with pytest.raises(ValueError, match=said):
            request.search_visual(frames, request.VisualRequest(image_cue=cue), encoder)
    png = base64.b64encode(b"\x89PNG\r\n\x1a\n and pixels").decode()
    for cue in ({"dataUrl": f"DATA:image/png;base64,{png}"}, {"data_url": f"data:,{png}"}, {"base64": png}, {"content": png}):
        assert encoders.image_bytes(cue).startswith(b"\x89PNG") and request.search_visual(frames, request.VisualRequest(image_cue=cue), encoder).count == 4
    assert (top.task, top.count, top.topks, top.cost) == ("KIS", 2, (2,), None)
    assert request.search_text(spark, frames, request.QueryRequest(query="x", task=""), encoder).task == "KIS"
    assert request.search_text(spark, frames, request.QueryRequest(query="x", task="vqa"), encoder).task == "VQA"
    shown = top.results.collect()[0]
    raw = json.loads(shown["raw"])
    assert (shown["videoId"], shown["shotId"], shown["objectMatches"], shown["object_count_delta"]) == ("v", "2", [], None)
    assert raw["ocr_text"] == "a dog" and "embedding" not in raw and abs(raw["distance"] - shown["distance"]) < 1e-12
    config = request.Config(include_embedding=True, image_template="/k/{video_id}/{keyframe_number}.jpg")
    keys = keyframes.usable_map(spark.createDataFrame([("v", 7, 3, 0), ("v", 8, 10, 1)], "video_id string, n long, frame_idx long, file_order long"))
    full = request.search_text(spark, frames, request.QueryRequest(query="a dog", top_k=1), encoder, config=config, keyframe_map=keys).results.first()
    assert full["thumbnail"] == "/k/v/007.jpg"
    seen = spark.createDataFrame([("v", "2", "dog", 2, 1), ("v", "3", "dog", 1, 2)], "video_id string, frame_id string, object string, quantity long, row_no long")
    found = request.search_text(spark, frames, request.QueryRequest(query="a dog", objects=("Dog",)), encoder, docs=seen).results.collect()
    assert [(r["frame_id"], r["object_count_delta"], [m["matched"] for m in r["objectMatches"]]) for r in found] == [(2, 1.0, [2]), (3, 0.0, [1])]
    for wrong in (lambda: request.QueryRequest(top_k=0), lambda: request.VisualRequest(min_confidence=2.0)):
        with pytest.raises(ValueError):
            wrong()
    assert request.health(frames, encoder)["status"] == "ok" and request.health(frames.drop("shot_id"), encoder)["missing_columns"] == ["shot_id"]
    with pytest.raises(ValueError, match="numeric sequence"):
        vectors.as_vector("abc")


def test_contexts_last_wins(spark):
    paths = spark.createDataFrame([(0, "/keyframes/v/001.jpg"), (1, "/keyframes/v/001.jpg")], "pos bigint, path string")
    known = spark.createDataFrame([(0, "/keyframes/v/001.jpg", "v", "25", "1", 0.5), (1, "/keyframes/v/001.jpg", "v", "50", None, 0.7)], request.CONTEXT)
    got = shaping.resolve_contexts(paths, known).collect()
    assert [(r["frame_id"], r["shot_id"], r["score"]) for r in got] == [("50", None, 0.7)]


def test_reports_and_submission(spark, tmp_path):
    summary = {"task_count": 1, "recall_at_1": 0.5, "mrr": 1 / 3, "ndcg_at_1": 1.0}
    report = {"k": [1], "overall": summary, "by_task_type": {"a|b": summary}, "metadata": {"x": "`<"}}
    text = writers.text_summary(report).splitlines()
    assert text[0].split() == ["Scope", "Tasks", "Recall@1", "MRR", "nDCG@1"]
    assert len({len(x) for x in text}) == 1
    assert "| a\\|b | 1 | 0.5000 | 0.3333 | 1.0000 |" in writers.markdown_report(report)
    assert "``" in writers.markdown_report(report)
    rows = spark.createDataFrame([("q1", 0, ["L02_V011", "1200", 'Anh "x"'])], "query_name string, row long, cells array<string>")
    z = writers.write_submission(rows, tmp_path)
    assert (tmp_path / "submission" / "q1.csv").read_text() == 'L02_V011,1200,"Anh ""x"""\n'
    assert z.exists()
    track = spark.createDataFrame([("q", 0, ["v", "2", "1"]), ("q", 1, ["v", "1", "2"])], "query_name string, row long, cells array<string>")
    assert [(r["row"], r["rule"]) for r in answers.submission_violations(track, "TRAKE", 2).collect()] == [(0, "order")]


def test_export(spark, tmp_path):
    encoder = encoders.HistogramEncoder()
    frames = spark.createDataFrame([(i, "v", i, i, t, v.tolist()) for i, (t, v) in enumerate(zip(["red car", "dog"], encoder.encode_texts(["red car", "dog"]), strict=True))], "id long, video_id string, frame_id long, shot_id long, ocr_text string, embedding array<float>")
    (tmp_path / "cases").mkdir()
    case = {"case_id": "c1", "task_type": "kis", "query": {"texts": [" dog "]}, "relevant_frames": [{"video_id": "v", "frame_id": "1", "relevance": 1}]}
    (tmp_path / "cases" / "a.jsonl").write_text(json.dumps(case) + "\n")
    cases = request.select_cases(readers.read_cases(spark, str(tmp_path / "cases")), "c1")
    with pytest.raises(ValueError, match="metadata requires non-empty fields: corpus_version"):
        request.export_and_evaluate(spark, cases, frames, encoder, str(tmp_path / "runs"), "r1", ks=(1,), labels={"corpus_version": " "})
    report = request.export_and_evaluate(spark, cases, frames, encoder, str(tmp_path / "runs"), "r1", ks=(1,))  # the name is still free
    assert report["overall"]["recall_at_1"] == 1.0
    written = json.loads((tmp_path / "runs" / "r1" / "tasks.jsonl").read_text())
    assert written == {"task_id": "c1", "task_type": "KIS", "relevant_frames": case["relevant_frames"]}
    digest = json.loads((tmp_path / "runs" / "r1" / "metadata.json").read_text())["corpus_sha256"]
    assert digest == request.corpus_digest(frames.repartition(3)) != request.corpus_digest(frames.limit(1))
    with pytest.raises(ValueError, match="run folder already exists: .* — pick a new run_id"):
        request.export_and_evaluate(spark, cases, frames, encoder, str(tmp_path / "runs"), "r1", ks=(1,))
    for change, said in (({"query": {"texts": [" "]}}, "case c1 requires query.texts"), ({"query": None}, "case c1 requires query.texts"), ({"relevant_frames": []}, "case c1 requires relevant_frames"), ({"relevant_frames": 5}, "case c1 requires relevant_frames")):
        (tmp_path / "cases" / "a.jsonl").write_text(json.dumps(case | change) + "\n")
        with pytest.raises(ValueError, match=said):
            request.export_and_evaluate(spark, readers.read_cases(spark, str(tmp_path / "cases")), frames, encoder, str(tmp_path / "runs"), "r2")
    assert not (tmp_path / "runs" / "r2").exists()
    with pytest.raises(ValueError, match="metadata path is required"):
        request.evaluate_files(spark, "t", "r", None, "o")
    sized = tmp_path / "tree"
    (sized / "a b").mkdir(parents=True)
    (sized / "a b" / "1.jpg").write_bytes(b"xyz")
    (sized / "a.jpg").write_bytes(b"12")
    want = hashlib.sha256(b"a b/1.jpg\x003\x00a.jpg\x002\x00").hexdigest()
    assert readers.tree_fingerprint(spark, str(sized)) == want
    with pytest.raises(ValueError, match="keyframes directory not found"):
        readers.tree_fingerprint(spark, str(tmp_path / "missing"))


def test_cases_go_through_their_stages_together(spark):
    rng, encoder = random.Random(3), encoders.HistogramEncoder(16)
    names = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(12)]
    texts = [" ".join(rng.choices(names, k=4)) for _ in range(80)]
    rows = [(i, f"v{i % 3}", i * 5, i // 4, t, v.tolist()) for i, (t, v) in enumerate(zip(texts, encoder.encode_texts(texts), strict=True))]
    frames = spark.createDataFrame(rows, "id long, video_id string, frame_id long, shot_id long, ocr_text string, embedding array<float>")
    asked = [request.QueryRequest(queries=tuple(" ".join(rng.choices(names, k=2)) for _ in range(n)), top_k=6) for n in (1, 2, 3, 2, 1)]
    got = request.search_cases(frames, asked, encoder, 6).collect()
    for i, one in enumerate(asked):
        want = [(r["video_id"], r["frame_id"]) for r in request.search_text(spark, frames, one, encoder).results.collect()]
        assert [(r["video_id"], r["frame_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["retrieval_rank"])] == want


def test_commands(spark, tmp_path, capsys):
    metadata = {k: "x" for k in writers.REQUIRED_METADATA} | dict.fromkeys(writers.DIGESTS, "A" * 64)
    (tmp_path / "m.json").write_text(json.dumps(metadata))
    files = ["--tasks", lines(tmp_path, "t.jsonl", [CARD]), "--rankings", lines(tmp_path, "r.jsonl", [RANKING]), "--metadata", str(tmp_path / "m.json"), "--output", str(tmp_path / "o.json")]
    commands.main(["evaluate", *files, "--k", "3, 1", "--markdown-output", str(tmp_path / "new" / "o.md")])
    assert "nDCG@3" in capsys.readouterr().out and "0.5869" in (tmp_path / "new" / "o.md").read_text()
    for k in ("", "0", "x", "1,1.5"):
        with pytest.raises(SystemExit, match="comma-separated positive integers"):
            commands.main(["evaluate", *files, "--k", k])


def test_settings_of_the_environment(tmp_path):
    given = request.Config.of_environment({"FRAMEQUERY_TOP_K": "50", "FRAMEQUERY_RANKER_WEIGHTS": "0, 1", "FRAMEQUERY_DATA_DIR": "d", "FRAMEQUERY_ARTIFACT_DIR": "/x", "FRAMEQUERY_INCLUDE_EMBEDDING": "true", "OTHER": "1"}, tmp_path)
    assert (given.top_k, given.ranker_weights, given.include_embedding, given.artifact_dir) == (50, (0.0, 1.0), True, "/x")
    assert given.keyframes_dir == str(tmp_path / "d" / "keyframes") and given.keyframe_map_dir == str(tmp_path / "d" / "map-keyframes")
    assert given.fingerprint() != request.Config().fingerprint() == request.Config(top_k=9).fingerprint()
    assert readers.existing_file(" ", "objects") is None
    with pytest.raises(RuntimeError, match="objects does not exist"):
        readers.existing_file("no.csv", "objects", tmp_path)
    with pytest.raises(RuntimeError, match="objects is not a file"):
        readers.existing_file(tmp_path, "objects")
    (tmp_path / "a.csv").write_text("x")
    assert readers.existing_file("a.csv", "objects", tmp_path) == tmp_path / "a.csv"


def test_encoded_texts_against_a_plain_model(spark):
    def plain(text, n=64):
        out = [0.0] * n
        for w in re.split(r"[^\w]+", (text or "").lower()):
            if w:
                h = xxhash.xxh64_intdigest(w.encode())
                out[h % n] += 1 if h >> 63 else -1
        size = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / size for x in out]

    texts = [None, "", "!?", "A b a", "été Straße 5", "word " * 5000 + "last"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", encoders.encode_column(encoders.load("histogram"), F.col("t")).alias("v")).collect():
        assert np.allclose(r["v"], plain(texts[r["i"]]), atol=1e-6)
    other = encoders.load("bytegrams").encode_texts(["red car", "red cars", "blue dog", ""])
    assert other[0] @ other[1] > 0.7 > other[0] @ other[2] and not other[3].any()
    with pytest.raises(ValueError, match="unknown encoder"):
        encoders.load("x")
    cues = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",), ("a*",), ("aGk",)], "c string")
    assert [r[0] and bytes(r[0]) for r in cues.select(encoders.decoded(F.col("c"))).collect()] == [b"hi", b"hi", None, None]


def test_missing_vectors_are_not_found(spark):
    rng = random.Random(2)
    rows = [(i, "v", i, None if i % 4 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    frames = spark.createDataFrame(rows, "id long, video_id string, frame_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(1, rows[1][3]), (2, rows[2][3]), (3, None)], "query_id long, embedding array<double>")
    got = retrieval.top_k_batch(frames, queries, 7).collect()
    for q in (1, 2):
        want = [r["id"] for r in retrieval.top_k(frames, rows[q][3], 7).orderBy("retrieval_rank").collect()]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["retrieval_rank"])] == want
    assert {r["query_id"] for r in got} == {1, 2} and not [r for r in got if r["id"] % 4 == 0]
    with pytest.raises(ValueError, match="2 weights for 1 lists"):
        retrieval.fuse([frames], [1.0, 2.0], 3)


def test_batches_keep_the_best_of_a_task():
    rng = np.random.default_rng(0)
    q, s = rng.integers(0, 3, 200), rng.integers(0, 20, 200).astype(float)
    keep = set(retrieval._best(q, s, 5, 4).tolist())
    for k in range(3):
        floor = np.sort(s[q == k])[-4]
        assert {i for i in keep if q[i] == k} == set(np.flatnonzero((q == k) & (s >= floor)).tolist())


def test_index_of_cells_finds_nearly_all(spark, tmp_path):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    frames = spark.read.parquet(path).selectExpr("vec_id id", "concat('v', label) video_id", "vec_id frame_id", "vec_id shot_id", "embedding")
    queries = frames.where("id % 50 = 0").selectExpr("id query_id", "embedding")
    centroids = ann.write_index(frames, str(tmp_path / "index"), cells=16)
    probes = ann.fit_probes(frames, centroids)
    rows, again = ann.read_index(spark, str(tmp_path / "index"))
    assert np.allclose(again, centroids) and rows.count() == frames.count()
    exact = {(r["query_id"], r["id"]) for r in retrieval.top_k_batch(frames, queries, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in ann.search_batch(rows, centroids, queries, 10, probes).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    vector = list(queries.first()["embedding"])
    one = ann.search(rows, centroids, vector, 10, probes)
    assert "cell" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 10
    assert ann.with_cell(spark.createDataFrame([(1, None)], "id long, embedding array<float>"), centroids).first()["cell"] == -1


def test_terms_of_languages(spark):
    df = spark.createDataFrame([("The Ponies of the buses, and classes!", "en"), ("The Ponies", "fr"), (None, "en")], "t string, l string")
    got = [r[0] for r in df.select(retrieval.analysed(F.col("t"), F.col("l"))).collect()]
    assert got == [["pony", "buse", "classe"], ["the", "ponies"], []]
    index = retrieval.postings(df.withColumn("id", F.monotonically_increasing_id()), "id", "t", "l")
    assert index.where("term is null").count() == 1 and index.where("term = 'the'").count() == 1


def test_objects_in_any_shape(spark):
    docs = ['{"objects": {" Car ": 2, "car": "3", "x": -1}}', '{"objects": {}, "detections": ["Car", {"name": "dog", "quantity": "2"}, 5, null, {"class": "dog"}]}', '{"labels": [{"label": "", "query": "Cat", "count": 2.9}]}', "[1]", "oops", None, "{}", '{"objects": "car"}']
    df = spark.createDataFrame(list(enumerate(docs)), "i long, d string")
    got = {r["i"]: r["m"] for r in df.select("i", objects.summary(F.col("d")).alias("m")).collect()}
    assert got == {0: {"car": 5, "x": 1}, 1: {"car": 1, "dog": 3}, 2: {"cat": 2}, 3: {}, 4: {}, 5: {}, 6: {}, 7: {}}


def test_contexts_of_results_and_trays(spark):
    rows = [(0, "v", "007", "3", 0.5, None), (1, None, "5", None, None, "/x.png"), (2, None, "5", None, 0.1, None), (3, "v", "9", None, float("nan"), ""), (4, "v", "9", None, float("inf"), "")]
    df = spark.createDataFrame(rows, "pos long, video_id string, frame_id string, shot_id string, score double, thumbnail string")
    got = {r["pos"]: (r["path"], r["score"]) for r in shaping.context_of_results(df).collect()}
    assert got == {0: ("/keyframes/v/007.png", 0.5), 1: ("/x.png", None), 3: ("/keyframes/v/9.png", None), 4: ("/keyframes/v/9.png", None)}
    tray = spark.createDataFrame([(0, "12"), (1, "x"), (2, "3abc"), (3, None), (4, "-1")], "pos long, frame_id string")
    assert [r["pos"] for r in answers.tray_order(tray).collect()] == [4, 1, 3, 2, 0]
    hits = spark.createDataFrame([(1, ("v", 2)), (2, None)], "id long, entity struct<video_id:string,id:long>")
    assert [tuple(r) for r in shaping.hit_rows(hits).collect()] == [(1, "v"), (2, None)]


def test_collection_and_corpus(spark, tmp_path):
    rows = [(i, f"v{i % 2}", i * 10, [1.0, float(i % 4 == 2)]) for i in range(8)]
    frames = spark.createDataFrame(rows, "id int, video_id string, frame_id int, embedding array<double>")
    shots = spark.createDataFrame([("v0", 1, 0, 25), ("v0", 2, 40, 100), ("v1", 1, 0, 100)], "video_id string, shot_id long, start long, end long")
    kept, stats = corpus.build_corpus(frames, shots, dimension=2)
    assert [f.name for f in kept.schema] == [f.name for f in corpus.COLLECTION] and kept.schema["embedding"].dataType == corpus.COLLECTION["embedding"].dataType
    assert {r["id"]: r["shot_id"] for r in corpus.shots_of_frames(frames, shots).collect()} == {0: 1, 2: 1, 4: 2, 6: 2, 1: 1, 3: 1, 5: 1, 7: 1}
    assert sum(r["frames"] for r in stats.collect()) == 8 and kept.count() == sum(r["kept"] for r in stats.collect()) < 8
    writers.write_corpus(kept, str(tmp_path / "corpus"))
    assert (tmp_path / "corpus" / "video_id=v0").is_dir() and spark.read.parquet(str(tmp_path / "corpus")).count() == kept.count()
    for bad, said in ((frames.withColumn("ocr_text", F.repeat(F.lit("x"), 65536)), "ocr_text is longer than 65535 bytes"), (frames, "embedding must have 3 numbers")):
        with pytest.raises(Exception, match=said):
            corpus.collection(bad, 3 if bad is frames else None).collect()


def test_keyframe_maps_and_lookups(spark, tmp_path):
    (tmp_path / "L22_V024.csv").write_text("\ufeffn,pts_time,fps,frame_idx\n174,701.0,25.0,17525\n175,705.08,25.0,17627\n", encoding="utf-8")
    (tmp_path / "L21_V006.csv").write_text("n,pts_time,fps,frame_idx\n1,4.0,25.0,100\n")
    keys = keyframes.usable_map(readers.read_keyframe_maps(spark, str(tmp_path)))
    asked = spark.createDataFrame([("L22_V024", 17630.0), ("L21_V006", 100.0)], "video_id string, frame_id double")
    shown = keyframes.nearest_keyframe(asked, keys).select("video_id", scalars.thumbnail("/keyframes/{video_id}/{keyframe_number}.jpg", F.col("video_id"), F.lit(""), F.col("frame_id"), F.col("keyframe_number")).alias("t")).collect()
    assert {r["t"] for r in shown} == {"/keyframes/L22_V024/175.jpg", "/keyframes/L21_V006/001.jpg"}
    (tmp_path / "Frames.csv").write_text("video_id,frame_id,shot_id\nv,5,1\nv,x,2\n")
    assert [tuple(r) for r in readers.read_frame_lookup(spark, str(tmp_path / "Frames.csv")).collect()] == [("v", 5, "1")]
    numbers = spark.createDataFrame([(12.0, "12.0", True, 1e300), (-3.7, " +4 ", False, float("nan"))], "d double, s string, b boolean, x double")
    got = [tuple(r) for r in numbers.select(*[scalars.whole_number(F.col(c)) for c in "dsbx"], scalars.plain_number(F.col("d"))).collect()]
    assert got == [(12, None, 1, None, "12"), (-3, 4, 0, None, "-3.7")]
