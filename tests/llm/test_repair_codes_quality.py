"""Repair of conversations, vector codes and the quality discriminant against brute force, DuckDB and held-out rows, and odd inputs."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import codes, conversations, discriminant, queries, reference_sql
from millrace.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, _later boolean, state string"


# ---------------------------------------------------------------- conversations


def cheapest(rows):
    """All edits of a few (role, text, must, cut) rows, tried one by one: least (cost, audit) and what it leaves."""
    best = None

    def go(i, state, audit, cost, out, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in conversations.FINAL and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        word = conversations.WANTED[state]
        then, name = conversations.NEXT[state][word], conversations.ROLES[word]
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, state, audit + "D", cost + 4, out, 0)
            if not must:
                if role[:1] in conversations.NEXT[state]:
                    go(i + 1, conversations.NEXT[state][role[:1]], audit + "K", cost + 3 * cut, [*out, f"{role}:{text}"], 0)
                go(i + 1, then, audit + "R", cost + 3 + 3 * cut, [*out, f"{name}:{text}"], 0)
        if inserted < 3:
            go(i, then, audit + "I", cost + 3, [*out, f"{name}:"], inserted + 1)

    go(0, 0, "", 0, [], 0)
    return best


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_repair_is_the_cheapest_and_least_of_all(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(250):
        raw = [(rng.choice(["user", "assistant", "system", " ", "tool", "", "user", "assistant"]), rng.choice(["a.", "b", "c!", "d ", " \n", "e. ", "f?"])) for _ in range(rng.randint(0, 7))]
        talk, seen, rows = conversations.Conversation(), set(), []
        for k, row in enumerate(raw):
            sound = row[1].rstrip(conversations.BLANKS)
            rows.append((*row, not sound or row in seen, bool(sound) and row not in seen and sound[-1] not in ".!?"))
            talk.add(k, *row, row in seen)
            seen.add(row)
        got, (cost, audit, left) = talk.end(), cheapest(rows)
        assert got[5:] == (cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def test_a_long_conversation_holds_few_undecided_edits():
    rng, talk = random.Random(3), conversations.Conversation()
    for k in range(20_000):
        talk.add(k, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"x{k}.", False)
    *_, audit, _ = talk.end()
    assert sum(c != "I" for c in audit) == 20_000 and max(map(len, talk._audit)) < 3 * conversations.BLOCK


def odd_talk(spark):
    rows = [(1, None, "user", "a"), (1, None, "user", "a"), (1, 3, "user", "a"), (1, 0, None, None), (None, 4, "assistant", "B."), (None, 5, "user", "B."), (None, None, "assistant", "z"), (2, 1, "", ""), (3, 7, "user", "x " * 40_000 + "."), (3, 7, "assistant", "same!"), (3, 7, "assistant", "same!"), (3, 9, "assistant", "same!")]
    rows += [(10 + k, t, ("user", "assistant", "system")[(k + t) % 3], f"text {t} of {k}" + "." * (t % 2)) for k in range(40) for t in range(k % 9)]
    return spark.createDataFrame([(*r, True, "s") for r in rows], TALK)


def rows_of(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def sql_rows(sql, views):
    con = duckdb.connect()
    for name, path in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(str(tuple(row[names.index(c)] for c in sorted(names))) for row in found.fetchall())


def test_repair_of_odd_rows_equals_sql(spark, tmp_path):
    odd_talk(spark).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert rows_of(got) == sql_rows(reference_sql.OP11_SQL, {"conversations": f"{tmp_path}/conversations.parquet/*.parquet"})


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_vector_codes"])
def test_queries_equal_sql(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    assert rows_of(got) == sql_rows(queries.oracle_sql()[name], {t: f"{FOLDER}/{t}.parquet" for t in ("conversations", "embeddings")})


def test_conversations_that_lose_all_rows_stay_and_empty_tables_give_none(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    talk = spark.createDataFrame([(gone, 0, "user", "hello.", False, "")], TALK)
    row = conversations.audits(conversations.damaged(talk), "_gone").first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.audits(conversations.damaged(spark.createDataFrame([], TALK)), "_gone").count() == 0


def test_repaired_rows_are_those_of_the_digest(spark):
    talk = odd_talk(spark)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in conversations.audits(talk).collect()}
    lines = {}
    for r in conversations.repaired_turns(talk).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert digests == {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in digests}


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts, entries, rounds):
    """Python integers, component by component; rows of (id, list of integers)."""
    rows, cut = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), lambda v: [list(map(int, p)) for p in np.array_split(np.array(v, object), parts)]
    split = [cut(v) for _, v in rows]
    books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda s, p: min(range(len(books[p])), key=lambda e: (apart(s[p], books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for s in split:
                groups.setdefault(nearest(s, p), []).append(s[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    return [(i, "".join(f"{nearest(s, p):02x}" for p in range(parts)), sum(apart(s[p], books[p][nearest(s, p)]) for p in range(parts))) for (i, _), s in zip(rows, split)], books


@pytest.mark.parametrize("width,parts,entries", [(16, 8, 4), (11, 4, 3), (8, 8, 40)])
def test_codes_equal_plain_integers(spark, width, parts, entries):
    rng = np.random.default_rng(width)
    rows = [(None if k == 3 else k // 2, rng.normal(size=width).round(3).tolist(), k % 3) for k in range(90)]
    rows += [(500, None, 1), (501, [1.0] * (width - 1) + [None], 1), (502, [float("nan")] * width, 1), (503, [float("inf")] + [0.0] * (width - 1), 1), (504, [], 1), (505, [0.5] * (width + 1), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, books = codes.compress(df, parts, entries, 3)
    whole = [(i, [int(np.floor(4096 * x)) for x in v]) for i, v, _ in rows[:90]]
    want, plain = plain_codes(whole, parts, entries, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert [b.tolist() for b in books.books] == plain
    assert books.digest() == hashlib.sha256(",".join(str(v) for p in plain for e in p for v in e).encode()).hexdigest()


def test_huge_components_stay_exact_and_labels_meet_with_null(spark):
    rows = [(k, [1e30 if k == 1 else -1e30 if k == 2 else float(k)] * 64, None if k % 2 else 7) for k in range(40)]
    got = codes.compressed_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == 40 and all(0 <= r["error"] <= r["label_error"] for r in got)
    for label in (None, 7):
        assert {r["label_error"] for r in got if (rows[r["vec_id"]][2]) == label} == {sum(r["error"] for r in got if rows[r["vec_id"]][2] == label)}


def test_no_vectors_give_no_rows(spark):
    assert codes.compressed_vectors(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_codes_decode_to_their_entries(spark):
    df = spark.createDataFrame([(k, [k / 8, -k / 4, 0.5, 1.0], 0) for k in range(12)], "vec_id long, embedding array<double>, label int")
    got, books = codes.compress(df, 2, 12, 0)
    back = codes.decode(got, books).orderBy("vec_id").collect()
    assert [r["vector"] for r in back] == [[k / 8, -k / 4, 0.5, 1.0] for k in range(12)]
    assert codes.decode(spark.createDataFrame([(None,), ("0",)], "code string"), books).filter("vector is not null").count() == 0


# ---------------------------------------------------------------- quality


def test_densities_are_those_of_two_gaussians():
    rng, p = np.random.default_rng(1), len(discriminant.FEATURES)
    clouds = [rng.normal(size=(400, p)) @ rng.normal(size=(p, p)) * 0.2 + k for k in (0, 1)]
    sums = [discriminant.Moments(len(c), c.sum(0), c.T @ c) for c in clouds]
    model = discriminant.discriminant(*sums, 0.3, 0.1, 0.5)
    pooled = sum(np.cov(c.T) * (len(c) - 1) for c in clouds) / 798
    x, logs = rng.normal(size=(20, p)), []
    for c in clouds:
        s = 0.9 * (0.7 * np.cov(c.T) + 0.3 * pooled) + 0.1 * np.diag(np.diag(pooled))
        d = x - c.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    assert np.allclose(model.ratio(x), logs[1] - logs[0])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(0.5 * (logs[1] - logs[0])))))


def documents(spark, n=600):
    rng, rows, marks = random.Random(5), [], []
    for k in range(n):
        poor = k % 5 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        if poor:
            words = [w.upper() + "!!" for w in words] if k % 2 else [words[0]] * len(words)
        rows.append((k, " ".join(words) + ".", "en", "s", None, k))
        marks.append((k, int(not poor), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = documents(spark)
    got = {r["doc_id"]: r for r in discriminant.classify(docs, labels).collect()}
    out = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in out) for k in got)
    assert np.mean([got[k]["predicted"] == (k % 5 > 0) for k in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_and_other_columns_do_not_matter_and_splits_neither(spark):
    docs, labels = documents(spark, 300)
    flipped = labels.withColumn("quality", F.when(discriminant.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).repartition(7)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(discriminant.classify(docs, labels)) == rows(discriminant.classify(other, flipped))


def test_odd_documents_are_scored(spark):
    docs, labels = documents(spark, 200)
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (900, "", "", "", 0, 1), (900, "", "", "", 0, 1), (901, "long " * 200_000, None, None, 1, 1), (902, " \n", None, None, 1, 1)], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (900, None, 0), (5, 7, 0), (3, 1, 1), (3, 1, 1)], labels.schema))
    got = discriminant.classify(docs.unionByName(odd), more).collect()
    assert len(got) == 205 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (900, 902, None)}) == 1
    assert {r["score"] for r in discriminant.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert len({r["score"] for r in discriminant.classify(docs, labels.filter("quality = 1")).collect()}) == 1
    assert discriminant.classify(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_quality_query_on_the_tables(spark):
    got = queries.op13_quality_discriminant(spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
