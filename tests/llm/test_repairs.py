"""What earlier rounds got wrong: markup after scripts, shared headings, long assignment texts, commits during compaction, rows without id."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import html, jaccard, rollup, secrets

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize("raw", ["<script>// i<n don't\n</script>", "<style>a<b {content: '}</style>", "<textarea>x<y isn't</textarea>", "<script>if (a<b && c>\"d) x='</p>'</script>", "<SCRIPT>i<n 'x</SCRIPT >"])
def test_what_raw_elements_hold_is_no_markup(spark, raw):
    page = f"<body><article>{raw}<p>It's main text of the page</p>{raw}<p>And more, isn't it</p></article></body>"
    assert texts(spark, [(1, "http://a.example.com/", page)])[1] == "It's main text of the page\nAnd more, isn't it"


def test_headings_that_articles_share_are_content(spark):
    page = lambda i: f"<header>The site</header><nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p>Story {i} tells of {i * i} days.</p>" + (f"<h2>Conclusion</h2><p>End {i} came after {i + 7} weeks.</p>" if i < 16 else "") + "</article><footer>foot</footer>"
    got = texts(spark, [(i, f"http://a.example.com/{i}", page(i)) for i in range(20)])
    for i in range(20):
        assert got[i] == f"Title {i}\nStory {i} tells of {i * i} days." + (f"\nConclusion\nEnd {i} came after {i + 7} weeks." if i < 16 else "")


def neutral(host, i):
    """A page without telling tags or names: what is template only other pages of the host can say."""
    top = f"<div class=k1><div class=k2>{host} gazette of all the northern towns and their people</div><div class=k3>Monday papers and pictures for everyone in the county</div></div>"
    story = f"<div class=k7>Title {i} on {host}</div><div class=k8>Story {i} tells of {i * i} days.</div><div class=k8>It went on for {i + 3} more pages in book {i * 7}.</div>"
    sold = "<div class=k9>Join nine thousand readers who get our letter each morning before the sun is up and the coffee is made</div>"
    end = "<div class=k4><div class=k5>All of our offices are closed between noon and three on working days</div><div class=k6>Write to the editor at the old mill</div></div>"
    return f"<html><body>{top}<div class=k0>{story}{sold}</div>{end}</body></html>", f"Title {i} on {host}\nStory {i} tells of {i * i} days.\nIt went on for {i + 3} more pages in book {i * 7}."


def test_on_neutral_pages_the_classes_make_the_texts_right(spark):
    made = {100 * h + i: neutral(f"h{h}", i) for h in range(3) for i in range(12)}
    rows = [(k, f"http://h{k // 100}.example.com/{k}", page) for k, (page, _) in made.items()]
    got = texts(spark, rows)
    assert got == {k: want for k, (_, want) in made.items()}
    alone = {k: "\n".join(html.main_blocks(html.pieces(page), None)) for k, (page, _) in made.items()}
    assert not any(alone[k] == want for k, (_, want) in made.items())


def test_long_texts_of_assignments_take_time_in_proportion(spark):
    def seconds(text):
        began = time.perf_counter()
        n = sum(1 for _ in secrets.candidates(text))
        return time.perf_counter() - began, n

    for part in ("k=v&", "key='a' ", "password=x!!!!!", "a:b;", "token is "):
        text = part * (1_000_000 // len(part))
        assert seconds(text)[0] < 20
    assert seconds("!" * 300_000 + "secret=" + "!" * 300_000 + "x")[0] < 20
    found = dict(secrets.candidates("x?token=abcd1234efgh&next=1 password: hunter2Xy9!! end"))
    assert "hunter2Xy9" in found.values()


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    names = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
    row = lambda n: spark.createDataFrame([("a", "en", "v", n, 10 * n, 50 * n)], names)
    fields = {f.split()[0] for f in names.split(", ")}
    assert set(rollup.KEYS) | set(rollup.MEASURES) == fields
    kept = rollup.Rollup(spark, str(tmp_path / "r"))
    kept.commit("one", row(1))
    plain = rollup.Rollup._sums

    def meanwhile(self, *state):
        rollup.Rollup(spark, self.folder).commit("two", row(1))
        return plain(self, *state)

    monkeypatch.setattr(rollup.Rollup, "_sums", meanwhile)
    kept.compact()
    monkeypatch.setattr(rollup.Rollup, "_sums", plain)
    assert [r["n_docs"] for r in kept.totals().collect()] == [2]
    kept.compact()
    assert [r["n_docs"] for r in kept.totals().collect()] == [2] and kept.batches() == {"one", "two"}


def test_a_row_without_id_has_the_component_of_its_text(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(5, text), (7, text), (None, text), (None, "other words that nobody else has"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.link_documents(docs).collect()), key=str)
    assert got == [(5, 5), (7, 5), (None, 5), (None, None), (None, None)]
    assert jaccard.one_of_each(docs).count() == 4  # one of the two, and all rows without id


def test_regions_above_the_task_bound_are_split_by_pivots(spark, monkeypatch):
    called, plain = [], jaccard.voronoi
    monkeypatch.setattr(jaccard, "voronoi", lambda *a: called.append(1) or plain(*a))
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(700):
        words = list(base)
        words[(i * 7) % 200], words[(i * 31) % 200] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(words)))
    got = {r["component_id"] for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), work=8_000_000).collect()}
    assert called and got == {0}
