"""Personal data and main text on input that is odd on purpose: long digit runs, unclosed tags, missing bodies, deep nesting."""

from __future__ import annotations

import random
import time

import pytest

from tests.llm.test_llm import docs, plain_spans
from wayline.llm import html_extract, pii


def test_octets_of_any_number_of_zeros_count_as_their_value(spark):
    texts = [f"ip 1.{'0' * 5000}.3.{'0' * 4999}25 end", f"1.2.3.{'9' * 5000}", f"0.{'0' * 9}256.1.1", "000.000.000.000"]
    assert [len(pii.base_spans(t)) for t in texts] == [1, 0, 0, 1]
    assert [r.n_ip for r in pii.find(docs(spark, texts)).orderBy("doc_id").collect()] == [1, 0, 0, 1]


def test_overlaps_equal_a_look_at_all_spans():
    rng = random.Random(5)
    for _ in range(300):
        spans = sorted((s, rng.randrange(5), s + rng.randint(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randint(0, 12))))
        known = pii.Spans(spans)
        for _ in range(20):
            a = rng.randrange(60)
            b = a + rng.randint(1, 12)
            assert known.near(a, b) == [x for x in spans if x[0] < b and x[2] > a]


def test_many_matches_take_linear_time():
    took = []
    for n in (10_000, 40_000):
        text = "ann@x.org said it and " * n
        began = time.process_time()
        spans = pii.base_spans(text)
        spans = sorted([*spans, *pii.secret_spans(text, spans)])
        pii.context(text, spans)
        took.append(time.process_time() - began)
    assert len(spans) == 40_000 and took[1] < 10 * took[0] + 1
    short = "ann@x.org 1.2.3.4 " * 50
    assert pii.base_spans(short) == plain_spans(short)


@pytest.mark.parametrize("page,want", [
    ("<h1>T</h1><p>a long article stands here</p><div>x</div>", "T\na long article stands here\nx"),
    ("<head><title>t</title><body><p>hi there</p></body>", "hi there"),
    ("<title>t</title>loose text<p>and a block", "loose text\nand a block"),
    ("<head><meta charset=x><p>no end of the head", "no end of the head"),
    ("<p>one</p><body class='home'><p>two</p>", "one\ntwo"),
    ("plain < 3 text", "plain < 3 text"),
])
def test_a_body_is_implied_where_there_is_none(page, want):
    assert html_extract.extract(page, None) == want


ODD_PAGES = {
    "open tags": "<a " * 100_000, "nested": "<div>" * 60_000 + "<p>deep</p>", "headings": "<h1><b>" * 30_000 + "<li>x" * 20_000,
    "quotes": "<a '\">" * 50_000, "open quotes": '<a x="\'>' * 40_001, "inline": "<b>" * 40_000 + "<i>x</i>" * 20_000,
    "script": "<script>" + "</script " * 50_000, "declarations": "<!x" * 100_000, "stray ends": "<b><div>" + "<h1>" * 20_000 + "</b>" * 40_000,
    "comment": "<p>seen</p><!-- " + "<p>x " * 50_000,
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_pages_of_odd_tags_take_linear_time(name):
    page = ODD_PAGES[name]
    began = time.process_time()
    text = html_extract.extract(page, None)
    assert time.process_time() - began < 6
    if name in ("nested", "comment"):
        assert text == {"nested": "deep", "comment": "seen"}[name]


def test_tags_end_at_the_first_bracket_outside_quotes():
    names = lambda page: [(end + name, rest) for _, _, end, name, rest in html_extract.tokens(page) if name]
    assert names("<a href='x>y' b=\"<\">t</A>") == [("a", " href='x>y' b=\"<\""), ("/a", "")]
    assert names("<a b='open>t<i>") == [("a", " b='open"), ("i", "")]
    assert names("1 < 2 <3 <!-- <b> --><u/><? x ><p") == [("u", "/")]


def test_every_capture_of_a_page_is_judged(spark):
    import datetime

    from wayline.llm import url_filter

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    entries = spark.createDataFrame([("l", "a.org", 1, day(10), "block"), ("l", "b.org", 2, day(0), "allow")], "list string, key string, entry_id long, at timestamp, action string")
    seen = [(1, "http://a.org/x", day(5)), (1, "http://a.org/x", day(15)), (1, "http://a.org/x", day(15)), (2, "http://a.org/y", day(20)), (2, "http://b.org/y", day(20)), (3, None, day(20)), (4, "http://a.org", None)]
    captures = spark.createDataFrame(seen, "page_id long, url string, fetched_at timestamp")
    for most in (10**6, 0):
        found = sorted((r.page_id, r.verdict) for r in url_filter.judge(captures, entries, max_broadcast=most).collect())
        assert found == [(1, "block"), (1, "none"), (2, "allow"), (2, "block"), (3, "none"), (4, "none")]
