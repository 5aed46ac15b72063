"""Toxicity, page text, the pipeline: held-out accuracy, exact cases, stage effects."""

import math

import corpus_pipeline
import pytest
from fixtures import awkward, frame, prose
from orrery.llm import html_extract, queries, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def test_folding():
    assert toxicity.fold("1D1OT").split() == toxicity.fold("іdіоt").split() == toxicity.fold("ｉｄｉｏｔ").split() == ["idiot"]
    assert toxicity.fold("mo​ron! (x)").split()[0].startswith("moron")
    assert toxicity.fold("m\u0336o\u0336r\u0336on 𝐦𝐨𝐫𝐨𝐧").split() == ["moron", "moron"] and toxicity.fold("été").split() == ["été"]


def _labelled(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(i, 40) + (" what a gr1mpy zorgo" if bad else " zorgology is fine" if i % 4 == 1 else "") + f" {prose(900 + i, 5)}"
        rows.append((i, text))
        marks.append((i, int(bad)))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_lexicon_and_exceptions(spark):
    docs, labels = _labelled(spark)
    lexicon = toxicity.learn(docs, labels)
    assert any("zorgo".startswith(x) or x.startswith("zorgo") or x.startswith("grimp") for x in lexicon.weights)
    out = toxicity.score(docs.select("doc_id", "text"), lexicon).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert out.where("predicted <> toxic").count() == 0


def _brute_density(lexicon, text):
    """Every entry at every word, by plain string search."""
    folded, total = toxicity.fold(text or ""), 0.0
    covered = {at + i for x in lexicon.exceptions for at in range(len(folded)) if folded.startswith(f" {x} ", at) for i, c in enumerate(f" {x}") if c == " "}
    for at in range(len(folded)):
        if folded[at] == " " and at not in covered:
            total += max((w for x, w in lexicon.weights.items() if folded.startswith(f" {x}", at)), default=0.0)
    return total / math.log2(8 + folded.count(" "))


def test_score_equals_brute_force(spark):
    docs, labels = _labelled(spark)
    lexicon = toxicity.learn(docs, labels)
    lexicon.exceptions += ["zorgo hut", "zorgos"]
    lexicon.weights["x "] = 2.0
    texts = ["zorgo hut", "a zorgo hut zorgo", "zorgos zorgoss", "x xx x", "x", "", None, "Z0RGO gr1mpy " * 300, prose(3, 50)]
    match = lexicon.matcher()
    assert [lexicon.density(t or "", match) for t in texts] == pytest.approx([_brute_density(lexicon, t) for t in texts])
    got = toxicity.score(frame(spark, list(enumerate(texts))), lexicon)
    assert got.columns.count("score") == 1 and [r.score for r in got.orderBy("doc_id").collect()] == pytest.approx([lexicon.score(_brute_density(lexicon, t)) for t in texts])


def test_pairs_that_clean_documents_use_are_exceptions(spark):
    rows = [(i, f"{prose(i, 20)} zorgo {prose(5000 + i, 5)}", 1) for i in range(300)] + [(1000 + i, f"{prose(900 + i, 20)} zorgo hut {prose(7000 + i, 5)}", 0) for i in range(8)] + [(2000 + i, prose(3000 + i, 30), 0) for i in range(200)]
    lexicon = toxicity.learn(frame(spark, rows), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "zorgo hut" in lexicon.exceptions and lexicon.density("the zorgo hut", lexicon.matcher()) == 0 < lexicon.density("the zorgo", lexicon.matcher())


def test_beginnings_end_where_words_part():
    found = toxicity.beginnings([("zorgo", True), ("zorgos", True), ("zorba", True), ("zor", False), ("zo", True)])
    assert {x for _, x in found} == {"zorgo", "zorgos", "zorba", "zor", "zo "}
    assert ("zorgos", "zor") in found and ("zo", "zo ") in found and ("zor", "zor") in found


def test_awkward_scores(spark):
    docs, labels = _labelled(spark)
    lexicon = toxicity.learn(docs, labels)
    rows = awkward()
    out = toxicity.score(frame(spark, rows).select("doc_id", "text"), lexicon).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    blank = toxicity.learn(docs, labels.where("false"))
    assert all(r.score < 1e-9 for r in toxicity.score(docs.select("doc_id", "text"), blank).collect())
    assert toxicity.score(docs.where("false").select("doc_id", "text"), lexicon).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    hit = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    tp, fp, fn = hit.get((1, 1), 0), hit.get((0, 1), 0), hit.get((1, 0), 0)
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.7


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.labelled_pages())


def test_unseen_shapes(model):
    pages = html_extract.labelled_pages(40, 123)
    right = sum(set(html_extract.extract(p, model).split("\n")) == good for p, good in pages)
    assert right >= 34


def test_broken_markup(model):
    said = "This is a long first paragraph of the story, and it ends as it should, with a full stop."
    page = lambda inner: f"<html><body><article>{inner}<p>{said}</p></article></body></html>"
    for inner in (f'<p class="lead>{said}</p>', f"<p>{said}</p><svg><g>", f"<p>{said}</p><noscript>", f"<p title='x>{said}</p>"):
        assert html_extract.extract(page(inner), model) == f"{said}\n{said}"


def test_parsing_time_is_linear():
    import time

    page = "<div>" * 40_000 + "</foo>" * 40_000 + "<p><div>" + "<foo>" * 20_000 + "</p><address>" * 20_000 + "<svg>" * 20_000
    began = time.process_time()
    assert len(html_extract.parse(page)) > 80_000 and time.process_time() - began < 5


def test_page_by_hand(model):
    page = '<html><head><title>t</title><script>if (a<b) x("</p>")</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie">We use cookies.</div><article><h1>The&nbsp;title &amp; more</h1><p>First   para\ngraph&#33;<p>Second <b>bold</b><br>line, which goes on a little so that it is text.</article><footer>&copy; us</footer>'
    assert html_extract.extract(page, model) == "The title & more\nFirst para graph!\nSecond bold line, which goes on a little so that it is text."
    for odd in ("", "<", "<p", "&amp", "plain", "<p>" * 3000, "<div>" * 500 + "x", "<!--", "</p></div>"):
        assert isinstance(html_extract.extract(odd, model), str)


def test_messages_are_exact_marginals(model):
    import itertools

    nodes = html_extract.parse("<article><h1>a b</h1><p>Long enough text here.</p></article><footer>x</footer>")
    own, pair = html_extract._potentials(model, html_extract.features(nodes))
    total, sums = 0.0, [0.0] * len(nodes)
    for s in itertools.product((0, 1), repeat=len(nodes)):
        w = 1.0
        for i in range(len(nodes)):
            w *= own[i] if s[i] else 1.0
            if i:
                w *= pair[html_extract.edge_kind(nodes, i)][2 * s[nodes[i].parent] + s[i]]
        total += w
        for i in range(len(nodes)):
            sums[i] += w * s[i]
    got, _ = html_extract.messages(nodes, own, pair)
    assert got == pytest.approx([x / total for x in sums])


def test_page_table(spark, model):
    rows = [(1, "u", "<article><p>Some words of text, enough of them.</p></article>"), (1, "u", None), (None, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "n_chars": F.lit(5)})
    out = html_extract.extract_text(df, model).collect()
    assert sorted((r.text, r.n_chars) for r in out) == [("", 0), ("", 0), ("Some words of text, enough of them.", 35)]
    assert html_extract.extract_text(df.where("false"), model).count() == 0


def test_pages_of_the_tables(spark):
    import html
    import re

    def truth(page):
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)[1]
        body = re.sub(r"<[^>]*>?", "", re.sub(r"</?(h1|p)>|<br>", "\n", body))
        return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\n")) if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op3_pages(spark, DATA).collect()}
    assert all(got[i] == truth(p) for i, p in pages.items())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.join(docs, corpus_pipeline.COLUMNS[0], "left_semi").count() == kept.count()
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    assert kept.join(marks.where("toxic = 0"), "doc_id").count() >= 0.99 * docs.join(marks.where("toxic = 0"), "doc_id").count()
    rows = frame(spark, awkward()).select("doc_id", "text", "lang", "source", "n_chars")
    lines = corpus_pipeline.drop_lines(spark, rows, DATA)
    assert lines.count() == rows.count() and lines.where("n_chars <> char_length(text)").count() == 0
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, DATA).collect()}
    assert 1 in near and 2 not in near and 3 not in near and {4, 5, 6, 7, 10} <= near


def test_passages_of_two_unlike_documents_go(spark):
    passage = prose(70, 60)
    near = prose(75, 200)
    docs = [(1, prose(71, 90) + "\n" + passage), (2, passage + "\n" + prose(72, 90)), (3, near + "\nlast line"), (4, near + "\nother line")]
    rows = frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_lines(spark, rows, DATA), DATA).collect()}
    assert got == {i: (t, len(t)) for i, t in ((1, docs[0][1]), (2, prose(72, 90)), (3, docs[2][1]))}


def test_short_lines_of_many_documents_go(spark):
    docs = [(i, f"All rights reserved.\n{prose(i, 40)}\nPage {i} of 30\n\n{i}\n{'Menu' if i < 9 else 'Home'}") for i in range(18)]
    rows = frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, rows, DATA).collect()}
    want = {i: "\n".join(x for x in t.split("\n") if not (i and x == "All rights reserved.") and not (i and x.startswith("Page"))) for i, t in docs}
    assert got == want


def test_mix_repeats_documents(spark):
    rows = frame(spark, [(i, prose(i, 30), "abc"[i % 3]) for i in range(30)]).select("doc_id", "text", "lang", "source", "n_chars")
    from orrery.llm import mixing

    taken = {r.doc_id: r.taken for r in mixing.mix_sources(rows).collect()}
    got = {}
    for r in corpus_pipeline.mix(spark, rows, DATA).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}


def test_stages_decide_by_row(spark):
    a, b = prose(80, 60), prose(81, 60)
    docs = [(1, a), (None, a), (3, b), (3, b), (5, a), (5, prose(82, 50)), (None, prose(83, 40)), (None, prose(83, 40))]
    rows = frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, rows, DATA).collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (5, prose(82, 50)), (None, prose(83, 40))], key=repr)


def test_mix_of_repeated_and_null_ids(spark):
    from orrery.llm import mixing

    docs = [(None if i % 4 == 0 else i // 3, prose(i, 10 + i % 7), "abc"[i % 3]) for i in range(40)] + [(7, "", "a"), (7, None, "a")]
    rows = frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")
    want, got = {}, {}
    for r in mixing.mix_sources(rows).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    for r in corpus_pipeline.mix(spark, rows, DATA).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert got == {k: v for k, v in want.items() if v}


def test_pipeline_end_to_end(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
