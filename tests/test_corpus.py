"""Sentence and language models, staged scoring, the cache source and SQL functions on hand-made and odd rows."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import tables as U
from millrace.operators import language as G
from millrace.operators.heads import HeadStore
from millrace.sources import cache_source as C

#: Sentences by hand; the corpus they make has each abbreviation several times, and the words around them elsewhere.
SENTENCES = """The plant was opened by Dr. Miller in March.|It makes steel, i.e. long products, for builders.|Prof. Okoro and Mr. Lind spoke first.|The price was approx. 300 euros per ton.|J. R. Weber wrote the report.
Was it enough?|Nobody knew!|The firm (est. 1990) grew fast.|Costs fell by 3.5 percent.|The board met Mr. Lind again.|Dr. Miller left in May.|Output rose to approx. 40 tons.|He asked: "Is it true?"
They said it was.|Prof. Okoro agreed.|On the 3. of May work began.|It uses scrap, i.e. old steel.|Mrs. Alba and Dr. Chen won.|The sum was approx. 12 million.|A. Novak signed it.|Mr. Lind paid.|The mill (est. 1950) closed.
Mrs. Alba stayed until the end.|She saw the furnace.|Prof. Weber taught the class.|The class ended.|Few came back.|Work went on for a year.|i.e. it never stopped.|Later the team moved.|Nobody spoke of it.|It was over.""".replace("\n", "|").split("|")


def corpus():
    rng, docs, want = random.Random(2), [], {}
    names = {"Miller", "March", "Okoro", "Lind", "Weber", "May", "Alba", "Chen", "Novak"}
    filler = sorted({w if (w := raw.strip('.,:()"?!')) in names else w.lower() for t in SENTENCES for raw in t.split()} - {"dr", "mr", "mrs", "prof", "approx", "est", "i.e", "j", "r", "a", "3", ""})
    for k in range(200):
        chosen = [rng.choice(SENTENCES) if n % 2 else (first := rng.choice(filler))[:1].upper() + first[1:] + " " + " ".join(rng.choice(filler) for _ in range(11)) + "." for n in range(16)]
        docs.append((k, " \n".join(chosen)))
        want[k] = [" ".join(s.split()) for s in chosen]
    return docs, want


def test_sentences_of_a_labelled_corpus(spark):
    docs, want = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    short = {r["base"] for r in G.abbreviations(G.word_statistics(rows, "text")).collect()}
    assert {"dr", "mr", "prof", "approx", "est", "i.e"} <= short and not short & {"steel", "it", "end", "march", "class"}
    got = {}
    for r in G.split_sentences(rows, "doc_id", "text").orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    ends = lambda parts: {sum(len(p.split()) for p in parts[: n + 1]) for n in range(len(parts))}
    right = sum(len(ends(got[k]) & ends(want[k])) for k in want)
    found, true = sum(len(v) for v in got.values()), sum(len(v) for v in want.values())
    assert right / found >= 0.95 and right / true >= 0.95


def test_sentences_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "No id! Here."), (5, "... ! ?"), (6, "word " * 50_000)], "doc_id long, text string")
    got = {(r["doc_id"], r["position"]): r["sentence"] for r in G.split_sentences(rows, "doc_id", "text").collect()}
    assert {k for k in got if k[0] == 4} == {(4, 0)} and got[None, 0] == "No id!" and got[None, 1] == "Here."
    assert not {1, 2, 3} & {k[0] for k in got} and len(got[6, 0]) == 249_999
    assert G.split_sentences(rows.limit(0), "doc_id", "text").count() == 0


def test_languages_are_learned_and_voted(spark):
    words = {"aa": "kala mata pola sika", "bb": "schrung tsetz wolf grunt"}
    rng = random.Random(1)
    text = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    docs = spark.createDataFrame([(k, text("aa" if k % 2 else "bb", 60), "aa" if k % 2 else "bb") for k in range(40)] + [(90, None, "aa"), (91, "ab", None), (92, "zz", "cc")], "doc_id long, text string, lang string")
    models = G.learn_languages(docs, "text", "lang")
    assert models.names == ("aa", "bb")  # two characters are no trigram
    fresh = spark.createDataFrame([(1, text("aa", 50)), (1, text("aa", 50)), (1, text("bb", 50)), (2, text("bb", 50)), (3, "kala"), (4, None)], "doc_id long, chunk string")
    got = {r["doc_id"]: tuple(r)[1:] for r in G.document_languages(fresh, fresh, "doc_id", "chunk", models).collect()}
    assert got == {1: ("aa", 2, 3), 2: ("bb", 1, 1), 3: ("en", 0, 0), 4: ("en", 0, 0)}
    none = G.learn_languages(docs.limit(0), "text", "lang")
    assert G.language_scores(fresh, "chunk", none).filter("language is not null").count() == 0


def documents(spark):
    chunk = "array<struct<text:string,chunk_id:string>>"
    return spark.createDataFrame([(1, [("good one", "a"), ("bad two", "b")], "x"), (2, [], "x"), (3, [(None, "c")], "y"), (4, None, "z"), (5, [(f"text {k}", str(k)) for k in range(100)], "z")], f"doc_id long, chunks {chunk}, scored string")


def models():
    def length(texts):
        return pd.DataFrame({"label": ["long" if len(t) > 6 else "short" for t in texts], "score": [float(len(t)) for t in texts]})

    def fails(texts):
        if "bad two" in set(texts):
            raise RuntimeError("out of memory")
        return length(texts)

    return length, fails


def test_heads_run_in_order_once_each(spark, tmp_path):
    length, fails = models()
    store = HeadStore(spark, str(tmp_path / "s"), ("first", "second"))
    store.create(documents(spark))
    assert store.run("second", length) == 0  # the first has not been
    assert not any(r["first_analyzed"] for r in store.documents().collect())
    assert store.run("first", length) == 5 and store.run("first", fails) == 0
    assert store.run("second", fails) == 5 and store.pending("second").count() == 0
    rows = {r["doc_id"]: r for r in store.documents().collect()}
    assert all(r["first_analyzed"] and r["second_analyzed"] for r in rows.values())
    assert [(c["chunk_id"], c["first_label"], c["first_score"], c["second_label"]) for c in rows[1]["chunks"]] == [("a", "long", 8.0, None), ("b", "long", 7.0, None)]
    assert rows[2]["chunks"] == [] and rows[4]["chunks"] is None and rows[3]["chunks"][0]["second_label"] in ("short", None) and rows[1]["scored"] == "x"
    assert [c["first_score"] for c in rows[5]["chunks"]] == [float(len(f"text {k}")) for k in range(100)]


def test_a_document_scored_twice_counts_once(spark, tmp_path):
    store = HeadStore(spark, str(tmp_path / "s"), ("only",))
    store.create(documents(spark))
    store.run("only", models()[0])
    spark.read.parquet(f"{store.path}/head=only").write.mode("append").parquet(f"{store.path}/head=only.copy")
    spark.read.parquet(f"{store.path}/head=only.copy").write.mode("append").parquet(f"{store.path}/head=only")
    assert store.documents().count() == 5


@pytest.fixture
def cache(tmp_path):
    def put(name, content):
        path = tmp_path / "cache" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("a_2019_prep.json", json.dumps({"pdf_path": "a", "company_id": "001", "year": 2019, "chunks": ["x", "y"], "chunk_ids": ["p"]}, indent=2))
    put("year=2024/b.json", json.dumps({"pdf_path": "b", "year": 2024, "chunks": []}))
    put("year=2020/c.json", "\n".join([json.dumps({"pdf_path": "c1", "year": "2020", "chunks": [{"chunk_id": "q", "text": "t"}]}), "{broken", json.dumps({"pdf_path": "c2"})]))
    put("list.json", json.dumps([{"pdf_path": "d", "year": None}, 7]))
    put("wrong.json", json.dumps({"pdf_path": "e", "year": "soon"}))
    put("cut.json", '{"pdf_path": ')
    put("bytes.json", b"\xff\xfe\x00")
    put("empty.json", "")
    put("_SUCCESS", "")
    put("other.txt", "no")
    return str(tmp_path / "cache")


def test_cache_rows_errors_and_lineage(spark, cache):
    rows = C.scan_cache(spark, cache).collect()
    good = {r["pdf_path"]: r for r in rows if r["_error"] is None}
    assert set(good) == {"a", "b", "c1", "c2", "d"} and good["a"]["company_id"] == "001" and good["c1"]["year"] == 2020
    assert [tuple(c) for c in good["a"]["chunks"]] == [("p", "x"), ("chunk_001", "y")] and good["b"]["chunks"] == [] and good["c2"]["chunks"] is None
    assert sorted(r["_source_file"] for r in rows if r["_error"]) == ["bytes.json", "cut.json", "list.json", "wrong.json", "year=2020/c.json"]
    through_spark = C.scan_cache(spark, "file:" + cache).collect()
    assert sorted(map(str, rows)) == sorted(map(str, through_spark))


def test_years_are_pruned_before_files_are_opened(spark, cache):
    reader = C.DocumentCache({"path": cache}).reader(None)
    reader.tests = [("LessThan", 2020)]
    names = {os.path.basename(p) for part in reader.partitions() for p in part.paths}
    assert "a_2019_prep.json" in names and not {"b.json", "c.json"} & names
    assert {r["pdf_path"] for r in C.scan_cache(spark, cache, before=2020).filter("_error is null").collect()} == {"a", "d"}
    assert {r["pdf_path"] for r in C.scan_cache(spark, cache).filter("year >= 2020").collect()} == {"b", "c1"}
    with pytest.raises(ValueError):
        C.local_path("s3a://bucket/x")
    assert C.scan_cache(spark, cache, suffix=".none").count() == 0


def test_stores_that_python_cannot_open_are_read_by_spark(spark, cache, monkeypatch):
    monkeypatch.setattr(C, "local_path", lambda path: (_ for _ in ()).throw(ValueError(path)))
    rows = C.scan_cache(spark, "file:" + cache, before=2021).collect()
    assert {r["pdf_path"] for r in rows if r["_error"] is None} == {"a", "c1", "c2", "d"} and sum(r["_error"] is not None for r in rows) == 5


def test_sql_functions_on_odd_rows(spark):
    U.register(spark)
    spark.createDataFrame([(1, "abcdef"), (2, ""), (3, None)], "id long, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, c.position, c.chunk FROM texts, LATERAL chunks(t, 4, 1) c ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, 0, "abcd"), (1, 1, "def")]
    assert spark.sql("SELECT * FROM texts, LATERAL chunks(t, 2, 2) c").count() == 0
    rows = spark.createDataFrame([("g", "b"), ("g", "b"), ("g", "a"), ("g", "a"), ("g", None), ("h", None)], "k string, v string")
    assert {r["k"]: r["commonest"] for r in U.commonest(rows, ["k"], F.col("v")).collect()} == {"g": "a", "h": None}
