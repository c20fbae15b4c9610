"""HTML to text, held against the standard library's parser."""

from html.parser import HTMLParser

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.functions.html import html_to_text


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "noscript")))

    def handle_data(self, data):
        if not self.hidden:
            self.found += data.split()


def parsed(html):
    parser = Visible()
    parser.feed(html)
    parser.close()
    return " ".join(parser.found)


def texts(spark, pages):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string")
    return [r[1] for r in df.select("k", html_to_text("html")).orderBy("k").collect()]


PAGES = [
    "", "abc <p cl", "abc <p", "abc <", "abc </", "abc </p", 'abc <p a="x>y">z', 'abc <p a=x"y>z', "a <!-- x", "a<!-- x>y -->b", "a<!--x-- >b", "a<!doct", "a<!doctype x>b", "a<?php x>b", "a<?php", "a</3>b", "a< b>c",
    "a<3>b", "a<b/>c", "a<script>x<b>y", "a<script>x</script >b", "a<script>x</scripty>b</script>c", "a<script/>b", "a<SCRIPT src='x>y'>x</Script>b", "a<scripty>b</scripty>", "a<title>x<b>y</title>z", "&am", "&amp", "&ampx",
    "&notit;", "&notin;", "&#65", "&#x41;b", "&#0;", "&#00065;", "&#128;", "&#x81;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#11;x", "&#xb;y", "&#xFFFE;z", "&#127;z", "&nosuch;", "a&b", "&", "&&amp;&", "&amp;lt;", "&lt;b&gt;",
    "</noscript>a", "a<noscript>x<b>y</noscript>c", "a<noscript>x", "<p\n>a", "a<b c='>'>d", 'a<b c = ">">d', "a<svg:x>b", "a<é>b", "a\xa0b\x1cc d", "a<style>b{}</style><!-- c --><script>d</script>e", "a<br>b<br/>c", "x&nbsp;y", "&CounterClockwiseContourIntegral;", "&#x1D400;&#128512;",
    "<a href=/x?a=1&amp;b=2>q</a>", "a>b", "a<b>c<d", "<" * 3000, "<b " + "x='>' " * 3000 + ">z", "<!--" + "-" * 50_000 + "-->z", "&amp;" * 5000, "a" * 100_000 + "<" + "b" * 100_000,
]


def test_pages_of_every_kind(spark):
    assert texts(spark, [*PAGES, None]) == [*map(parsed, PAGES), None]


def test_the_pages_of_the_tables(spark):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.tolist()
    got = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", html_to_text("html")).collect()}
    assert all(got[p] == parsed(p) for p in pages)


PIECES = ["<p>", "</p>", "<br/>", "<!-- c > d -->", "<script>", "</script>", "<style>", "</style>", "<a href='x'>", '<i t="a>b">', "a", " b ", "\n", "&amp;", "&lt", "&#65;", "&copy", "&x;", "&", "<", ">", "é", "<!x>", "1<2"]


@pytest.fixture(scope="module")
def judge(spark):
    def run(pages):
        return texts(spark, pages)

    return run


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=60, max_size=60))
def test_pages_of_pieces(judge, pages):
    assert judge(pages) == list(map(parsed, pages))


def test_it_is_an_expression(spark):
    plan = spark.createDataFrame([("x",)], "html string").select(html_to_text(F.col("html")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" not in plan
