"""Filings are parsed once each, by more than the one task that a small file is."""

import os

import pytest

import __spark_entry__ as entry
from gavelyard.sources import parse, read

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def parsed_once_in_parallel(text):
    return text.count("MapInArrow") == 1 and "EvalPython" not in text and "REPARTITION_BY_NUM" in text


@needs_data
def test_parse_tables_once(spark):
    assert parsed_once_in_parallel(plan(spark, "parse_tables"))


def test_bare_tags_read_as_by_the_parser():
    for text in ("a<td>b</td>c", "<table><tr><td>Okres:</td><td>Nitra</td></tr></table>", "x<br/>y<BR />z", "1 < 2<p>b", "a</br/>b", "<td class='x'>a", "a<!-- <td> -->b", "<script>a<b></script>c"):
        want = parse._Plain.__new__(parse._Plain)
        parse.HTMLParser.__init__(want, convert_charrefs=True)
        want.out = []
        want.feed(text)
        want.close()
        assert parse._Plain(text).out == want.out, text


@needs_data
def test_parse_filings_once(spark):
    assert parsed_once_in_parallel(plan(spark, "parse_filings"))


@needs_data
def test_parse_tax_once(spark):
    assert parsed_once_in_parallel(plan(spark, "parse_tax"))


@needs_data
def test_parse_decrees_once(spark):
    assert parsed_once_in_parallel(plan(spark, "parse_decrees"))


def test_rows_of_pages_go_out_in_small_batches(spark):
    """A page's rows are many times the page's own, so a batch of pages must not become one batch of rows."""
    line = "<tr><td><a href='/x?actId={:06x}'>N</a></td><td>A</td><td>B</td><td>C</td><td></td><td>1.2.2031</td></tr>"
    pages = [("<table class='search_results'>" + "".join(line.format(20 * p + k) for k in range(20)) + "</table>",) for p in range(200)]
    rows = read.register_rows(spark.createDataFrame(pages, "html string").coalesce(1))
    assert rows.count() == 4000 and "MapInPandas" not in rows._jdf.queryExecution().executedPlan().toString()
