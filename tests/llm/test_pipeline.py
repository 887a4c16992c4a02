"""The pipeline's stages on a small corpus."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from framequery.llm import jaccard, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(3), tmp_path_factory.mktemp("tables")
    bad = ["vile", "scum", "moron"]
    docs, labels = [], []
    for i in range(300):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
        if i % 3 == 0:
            w += rng.choices(bad, k=5)
            rng.shuffle(w)
        docs.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        if i < 240:
            labels.append((i, 1, int(i % 3 == 0)))
    clean = [d for d in docs if d[0] % 3]
    docs += [(1000 + k, d[1], *d[2:]) for k, d in enumerate(clean[:20])]
    docs += [(2000 + k, d[1] + " more", *d[2:]) for k, d in enumerate(clean[:20])]
    docs += [(3000, "token = abcdefgh12345678 " + " ".join(f"word{j}" for j in range(40)), "en", "s1", 0), (3001, None, None, None, None)]
    docs = [(*d[:4], len(d[1] or "")) for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        path = f"{folder}/out-{k}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
        seen[name] = docs.collect()
    ids = {n: [r["doc_id"] for r in rows] for n, rows in seen.items()}
    toxic_left = [i for i in ids["toxicity"] if i < 300 and i % 3 == 0]
    assert len(toxic_left) <= 3 and sum(i < 300 and i % 3 > 0 for i in ids["toxicity"]) >= 198
    assert not [i for i in ids["ngram_jaccard_join"] if 1000 <= i < 3000]
    assert {i for i in ids["ngram_jaccard_join"] if i < 300} == {i for i in ids["toxicity"] if i < 300}
    assert sorted(ids["secret_scan"]) == sorted(ids["ngram_jaccard_join"])
    assert 3000 in ids["toxicity"] and 3000 in ids["ngram_jaccard_join"]
    masked = next(r for r in seen["secret_scan"] if r["doc_id"] == 3000)
    assert masked["text"].startswith("<secret> ") and masked["n_chars"] == len(masked["text"])
    assert set(ids["source_mix"]) <= set(ids["secret_scan"])
    assert {r["doc_id"] for r in seen["best_fit_packing"]} == set(ids["source_mix"])
    assert corpus_pipeline.run(spark, folder).count() == len(seen["best_fit_packing"])


def test_run_on_odd_tables(spark, folder, tmp_path):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, __b int, root string, `taken` long"
    long_text = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, "some words in a text", "en", "a", 20, 1, "r", 5), (1, "some words in a text", "en", "a", 20, 1, "r", 5), (1, "another text under one id", "en", "a", 25, 1, "r", 5)]
    rows += [(None, "a text without an id", None, None, None, None, None, None), (None, None, "en", "b", None, 1, "r", 5), (7, "", "en", "b", 0, 1, "r", 5), (8, long_text, "en", "b", len(long_text), 1, "r", 5), (9, " \n", "en", "b", 2, 1, "r", 5)]
    for name, given in (("odd", rows), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame(given, schema).write.parquet(f"{at}/documents.parquet")
        labels.limit(0).write.parquet(f"{at}/labels.parquet")
        docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            docs = f(spark, docs, str(at))
            docs.write.parquet(f"{at}/out-{k}.parquet")
            docs = spark.read.parquet(f"{at}/out-{k}.parquet")
            seen[stage] = docs.collect()
            if k < 4:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__b", "root", "taken"]
        if not given:
            assert not any(seen.values())
            continue
        assert len(seen["toxicity"]) == len(rows)  # nothing is toxic without labels
        left = [(r["doc_id"], r["text"]) for r in seen["ngram_jaccard_join"]]
        assert sorted(map(str, left)) == sorted(map(str, [(1, rows[0][1]), (1, rows[2][1]), (None, rows[3][1]), (8, long_text), (7, "")]))
        assert len(seen["secret_scan"]) == len(left)
        assert all(r["text"].strip() for r in seen["source_mix"])
        cut = [r for r in seen["best_fit_packing"] if r["doc_id"] == 8]
        assert len({r["sequence_id"] for r in cut}) == len(cut) > 1 and all(r["length"] <= 2048 for r in seen["best_fit_packing"])


def test_near_copies_go_by_row_not_by_id(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    rows = [(None if i % 3 == 0 else i, text(i)) for i in range(30)]
    rows += [(100, text(100)), (105, text(105)), (105, text(100) + " more"), (None, text(1)), (105, text(105)), (None, text(3) + " more")]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept = sorted(((r["doc_id"], r["text"]) for r in left), key=str)
    assert len(kept) == 32 and {x for x in kept if x[0] is not None} == {(i, text(i)) for i in range(30) if i % 3} | {(100, text(100)), (105, text(105))}
    assert {t.split()[0] for i, t in kept if i is None} == {f"t{i}w0" for i in range(0, 30, 3)}


def test_each_operator_is_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    answer = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in answer.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*order).collect()))) == sorted(map(str, answer.fetchall()))


def test_near_copies_in_many_blocks_are_tied_once_for_each_pair_of_blocks(spark, monkeypatch):
    texts = [" ".join([f"w{k}" for k in range(100)] + [f"x{n}"]) for n in range(60)] + ["some other text of a few words"]
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    monkeypatch.setattr(jaccard, "MOST", 10)
    ties, components = {}, jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges, name: [ties.update({name: edges.count()}), components(edges, name)][1])
    stay = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in stay.collect()) == [0, 60]
    assert ties["classes"] == (60 - 6) + 6 * 5 // 2
