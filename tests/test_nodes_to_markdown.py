"""Pages to Markdown on tables of nodes, held against the tree passes page by page."""

import random

import pytest

from loomdown.kernel import convert, surgery
from loomdown.kernel.html_tree import parse
from loomdown.kernel.serialize import Serializer
from loomdown.operators import inline, page, rewrite
from loomdown.operators import nodes as N
from loomdown.sources.files import settled

PLAIN = "<p>|</p>|<div>|</div>|<b>|</b>|<i>|</i>|<em>x</em>|<a href='/u'>|</a>|<code>c * d</code>|<br>| word |te_xt|<h2>|</h2>|<h3>T</h3>|<hr>|<pre> a\n b </pre>|<blockquote>|</blockquote>|<ul>|</ul>|<ol>|</ol>|<li>|</li>|<table>|<tr>|<td>|</td>|</tr>|</table>|<span>|</span>|<section>|</section>|<!--c-->|<center>|</center>|\n| |<u>:</u>|[x](y)|<b></b>|<td>c1<td>c2<tr>|<a href='b c'>q]</a>|<a href='/z'>](t</a>".split("|")
VENDOR = "<p>|</p>|<div>|</div>|<b>|</b>|<b> </b>|<i>|</i>|<em>:</em>|<em> <i></i></em>|<u>=</u>|<a href='/u'>|</a>|<a>›</a>|<br>| word |te_xt|<h2>|</h2>|<h3>12k</h3>|<hr>|<span>|</span>|<section>|</section>|\n| |​|<div style='display:flex'>|<div>x</div>|<table>|<table border=1>|<table role=none>|<table>|<tr>|<tr>|<tr>|<td>|<td>|<td>|<td>|</td>|</tr>|</table>|</table>|<th>|<caption>c</caption>|<td>c1<td>c2<tr>|<td><p>one</p>|<td><div>|</div>".split("|")


def pages(rng, parts, n):
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 45))) for _ in range(n)] + ["", "<p>"]


def nodes_of(spark, htmls):
    return N.explode_nodes(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").repartition(3))


def blocks_of(nodes):
    out = {}
    for r in sorted(page.page_blocks(nodes).collect(), key=lambda r: (r.doc_id, r.pos)):
        assert r.pos == len(out.setdefault(r.doc_id, []))
        out[r.doc_id].append(r.block)
    return out


def plain_blocks(html):
    root = parse(html)
    surgery.prune(root)
    surgery.clean_texts(root)
    return Serializer(root).blocks()


@pytest.mark.parametrize("parts, rewrites, want", [(PLAIN, False, plain_blocks), (VENDOR, True, convert.blocks)])
def test_blocks_agree_with_the_tree_passes(spark, parts, rewrites, want):
    htmls = pages(random.Random(3), parts, 150)
    nodes = nodes_of(spark, htmls)
    got = blocks_of(rewrite.rewritten(nodes) if rewrites else settled(page.cleaned(nodes), "nodes"))
    assert {i: got.get(i, []) for i in range(len(htmls))} == {i: want(h) for i, h in enumerate(htmls)}


def test_inline_fold(spark):
    html = ["<p><b>bold <i>both</i></b>, a_b <code> x*y <u>z</u></code><br><a href=/u>l <em>k</em></a><b></b><b> </b>", "<p><a href='/'>·</a><a href='/a b'>t</a><a href=/x/>/x</a><code> </code>", "<p>"]
    got = {r.doc_id: r.markdown for r in inline.inline_markdown(nodes_of(spark, html), N.F.col("name") == "p").collect()}
    assert got == {0: "**bold *both***, a\\_b `x*y z`\n[l *k*](/u)", 1: "t/x", 2: ""}


def test_tables_in_tables_from_the_innermost(spark):
    deep = "<table><tr><td>" * 12 + "x" + "</table>" * 12
    mixed = "<table><tr><td>a<td><table><tr><td>b<td> <table border=1><tr><td>1<td>2<tr><td>3<td>4</table></table><tr><td><td> </table>"
    assert blocks_of(rewrite.rewritten(nodes_of(spark, [deep, mixed]))) == {0: ["x"], 1: ["a", "b", "| 1   | 2   |\n| --- | --- |\n| 3   | 4   |"]}


def test_empty_tables_and_pages_without_html(spark):
    df = spark.createDataFrame([(1, None)], "page_id long, html string")
    for rows in (df, df.limit(0)):
        assert page.page_blocks(settled(page.cleaned(N.explode_nodes(rows)), "nodes")).count() == 0
