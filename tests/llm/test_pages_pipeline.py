import html
import itertools
import random
import re
import time
from types import SimpleNamespace

import cases
import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from panelloom.llm import batches, jaccard, mincut, packing, toxicity
import panelloom.llm.queries  # noqa: F401  (registers the queries)
from panelloom.llm.registry import ORACLES, QUERIES
from panelloom.operators import batches as arrow
from pyspark import TaskContext

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>
<header class="site"><a href=/>Home</a></header><div id="cookie-notice"><p>We use cookies and such on this page, please
click here to agree with all of it.</p></div><div class="content"><h2>A title &amp; more</h2><p>This is a long paragraph
of   real text,&#32;which has many words and <a href=x>one link</a> in it, so it should stay.</p><div class="ad">Buy now</div>
<p>Short.</p><ul><li>One item<li>Two</ul></div><aside><p>Side text that is long enough to look like text but lies in the
sidebar of the page.</p></aside><section id="comments"><article class="comment"><p>I think this is a really good article,
thank you so much for writing it.</p></article></section><form><label>Name</label><input></form><footer><p>(c) x</p></footer></body></html>"""


def test_article_without_its_surroundings():
    assert mincut.main_text(PAGE).split("\n") == [
        "A title & more", "This is a long paragraph of real text, which has many words and one link in it, so it should stay.",
        "Short.", "One item", "Two"]


def test_page_without_names():
    words = "words of an ordinary page without any names, just words and again words, so many of them in it"
    page = (f"<div><ul><li><a href=x>Home</a></li><li><a>About</a></li></ul></div><div><h1>Title</h1><p>First {words}</p><p>Tiny.</p>"
            f"<p>Second {words}</p></div><div><a>Imprint</a> | <a>Privacy</a></div>")
    assert mincut.main_text(page).split("\n") == ["Title", f"First {words}", "Tiny.", f"Second {words}"]


def test_cut_is_the_smallest_of_all():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [rng.randint(-12, 12) for _ in range(n)]
        joined = {(i, j): rng.randint(1, 6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def price(kept):
            return (sum(abs(c) for c, k in zip(costs, kept) if (c > 0) != k and c) +
                    sum(w for (i, j), w in joined.items() if kept[i] != kept[j]))

        assert price(mincut.content(costs, joined)) == min(map(price, itertools.product([True, False], repeat=n)))


def test_settled_blocks_and_flow_equal_the_flow_alone():
    """Settling by dominant costs gives the smallest source side of the minimum cut, as the flow on all blocks does."""
    rng = random.Random(9)
    for n in (1, 2, 50, 400):
        for high in (2, 5, 20):
            costs = [rng.randint(-high, high) for _ in range(n)]
            joined = {(i, j): rng.randint(1, 6) for i in range(n) for j in (i + 1, i + 3) if j < n and rng.random() < 0.8}
            assert mincut.content(costs, joined) == mincut.Flow(costs, joined).source_side()


def nameless(seed):
    """A page of plain div elements, and whether each block is content."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["word", "and", "another", "of", "these", "long,"]) for _ in range(n)).capitalize()
    page, truth = "<div>" + "".join(f"<div><a href=x>{say(2)}</a></div>" for _ in range(6)) + "</div>", [False] * 6
    page, truth = page + f"<div><h1>{say(6)}</h1>", truth + [True]
    for _ in range(rng.randint(4, 12)):
        kind = rng.random()
        if kind < 0.25:
            page, truth = page + f"<div>{say(2)}</div>", truth + [True]       # a short line of a poem or talk
        elif kind < 0.35:
            page, truth = page + f"<ul><li>{say(3)}</li><li>{say(4)}</li></ul>", truth + [True] * 2
        else:
            page, truth = page + f"<p>{say(rng.randint(12, 60))}.</p>", truth + [True]
    page, truth = page + f"<p>{say(40)}.</p></div><div><a>{say(1)}</a> | <a>{say(2)}</a></div><div>© {say(3)}</div>", truth + [True, False, False]
    return page, truth


def test_cut_decides_on_pages_without_names():
    """Of these blocks the cut turns about a seventh, short lines among paragraphs, nearly all from wrong to right."""
    blocks = changed = by_cost = by_cut = 0
    for seed in range(200):
        page, truth = nameless(seed)
        found, costs, kept = mincut.labelled(page)
        assert len(found) == len(truth)
        blocks += len(truth)
        changed += sum((c > 0) != k for c, k in zip(costs, kept))
        by_cost += sum((c > 0) != t for c, t in zip(costs, truth))
        by_cut += sum(k != t for k, t in zip(kept, truth))
    assert changed > blocks / 10 and by_cost > blocks / 10 and by_cut < by_cost / 5


WORDS = "words of a text that is long enough, with commas, to be one"


@pytest.mark.parametrize("page, text", [
    (f"<p title=it's>One: {WORDS}.</p><p>Two.</p><p>It's three.</p>", f"One: {WORDS}.\nTwo.\nIt's three."),
    (f'<p class="a"">{WORDS}.</p>', f"{WORDS}."),
    (f'<p class="a>{WORDS}.</p>', f"{WORDS}."),
    (f"<p data-x='a>b' title = \"c>d\">{WORDS}.</p>", f"{WORDS}."),
    (f"<a href=/x?a=b&c='d'>x</a><p>{WORDS}.</p>", f"{WORDS}."),
    (f"<form id=page><div><h1>Title</h1><p>{WORDS}.</p><p>Short.</p></div></form>", f"Title\n{WORDS}.\nShort."),
    (f'<div class="post with-sidebar"><p>{WORDS}.</p></div>', f"{WORDS}."),
    (f'<article class="post comment-open"><p>{WORDS}.</p></article>', f"{WORDS}."),
    (f'<article><p>{WORDS}.</p><div class="ad-box"><p>{WORDS}!</p></div><form><p>{WORDS}?</p><label>Mail</label></form></article>', f"{WORDS}."),
    (f"<p>{WORDS}.</p><div hidden><p>{WORDS}!</p></div><div style='display: none'>{WORDS}</div><p>{WORDS}?</p>", f"{WORDS}.\n{WORDS}?"),
])
def test_quotes_forms_and_names(page, text):
    assert mincut.main_text(page) == text


def test_very_long_pages():
    """Work grows with the number of blocks (it took a quarter of an hour when it grew with its square)."""
    rng = random.Random(1)
    parts = [f"<p>{'word ' * rng.randint(1, 12)}.</p>" if rng.random() < 0.6 else f"<li><a href=x>{'w ' * rng.randint(1, 5)}</a></li>" for _ in range(100_000)]
    start = time.process_time()
    assert mincut.main_text("<div>" + "".join(parts) + "</div>")
    assert time.process_time() - start < 30


def test_every_page_of_the_tables(spark, sf):
    """The synthetic pages hold their text in one article element."""
    from pyspark.sql import functions as F

    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op4_html_mincut"](spark, sf).collect()
    assert len(got) == len(source)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>cut <b"), (2, "u", "<p>cut <b"), (3, "u", "<div>" * 3000 + "deep " * 60_000),
                                 (4, "u", "<script>x")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    texts = sorted(r.text for r in mincut.extract(odd).collect())
    assert texts == ["", "", "", "cut", "cut", " ".join(["deep"] * 60_000)]
    assert mincut.extract(odd.limit(0)).count() == 0


def test_search_query_equals_sql(spark, sf):
    from compare import compare, database

    assert compare(QUERIES["op1_mtree_search"](spark, sf), database(sf), ORACLES["op1_mtree_search"]) == []


def test_stages_keep_columns_and_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    counts = [docs.count()]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.dtypes == last.dtypes
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted(tuple(r) for r in docs.collect())


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_and_empty_tables(spark, sf, at):
    for docs in (cases.documents(spark, clashing=at < 4), cases.empty(spark)):
        out = corpus_pipeline.STAGES[at][1](spark, docs, sf)
        assert at == 4 or out.columns == docs.columns
        assert out.count() >= 0


@pytest.mark.parametrize("before", [
    "<head><title>t</title><meta charset=utf-8><style>p{}</style><body>", "<head><title>t</title>", "<head><body><noscript><img src=x>",
    "<body><template>", "<body><iframe src=x>", "<body><object data=x>", "<body><div><svg><path d=x></div>", "<body><math>",
    "<body><noscript><noscript><p>Turn on scripts</noscript>", "<body><svg><!-- </svg> -->", "<body><iframe src=x><script>'</iframe>'</script>"])
def test_elements_without_an_end_tag_hide_nothing(before):
    text = "This is a long paragraph of real text which has many words in it, so it should stay."
    assert mincut.main_text(f"<html>{before}<article><p>{text}</p></article>") == text


def test_closed_unseen_elements_stay_unseen():
    page = "<head><title>t</title></head><article><p>Some real words here.<object><object>a</object>b</object><svg><text>c</text></svg></article>"
    assert mincut.main_text(page) == "Some real words here."


def test_workers_give_memory_back_after_each_task(spark, monkeypatch):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(r.doc_id, i % 2) for i, r in enumerate(docs.select("doc_id").distinct().collect())], "doc_id long, toxic int")
    tasks = []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a: tasks.append(run) or real(self, run, *a))
    model = toxicity.train(docs, labels)
    toxicity.clean(docs, model), toxicity.score(docs, model), jaccard.keep(docs)
    packing.tokenise(docs, public_tokenizers.path(corpus_pipeline.VOCABULARY))
    given = []
    monkeypatch.setattr(batches, "give_back", lambda: given.append(1))
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    assert len(tasks) >= 7
    for run in tasks:
        before = len(given)
        list(run(iter([])))
        assert len(given) > before


def test_batches_of_texts_are_small(spark):
    spark.conf.unset(arrow.SETTING)
    docs = spark.range(0, 100, 1, 1).selectExpr("id as doc_id", "repeat('word ', 40000) as text")
    sizes = batches.small_batches(docs).mapInArrow(lambda found: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in found), "size long").collect()
    assert sum(1 for _ in sizes) > 1 and max(r["size"] for r in sizes) <= (2 << 20) + 400_000
