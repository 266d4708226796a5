import os

import pytest
from conftest import SMALL
from oracle import connect, same
from pyspark.sql import functions as F

from loomdown.functions import markdown as M
from loomdown.operators import blocks as B
from loomdown.operators import nodes as N
from loomdown.plans import catalogue
from loomdown.sources import files

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SMALL), duck, catalogue.oracle_sql()[name])


def page_by_page(name):
    """What the queries without SQL give, by plain loops over pages."""
    import re
    from collections import defaultdict
    from urllib.parse import urlsplit

    import pyarrow.parquet as pq

    from loomdown.kernel import convert, surgery
    from loomdown.kernel.html_tree import parse

    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()]
    vendor = [(i, u, h.replace("<article>", catalogue.VENDOR)) for i, u, h in rows]
    if name == "html_blocks":
        return [(i, k, b) for i, _, h in rows for k, b in enumerate(convert.blocks(h))]
    if name in ("html_to_markdown", "streamed_markdown"):
        return [(i, convert.markdown(h)) for i, _, h in rows]
    if name == "vendor_markdown":
        return [(i, convert.markdown(h), False) for i, _, h in vendor]
    if name == "html_nodes":
        return [(i, *n[:7], n[8]) for i, _, h in rows for n in convert.nodes(h)]
    if name == "corpus_stats":
        by = defaultdict(lambda: [0, 0, 0, 0])
        for _, u, h in rows:
            md = convert.markdown(h)
            own = (1, len(md), len(md.split("\n")), len(re.findall(r"\[([^\]\n]+)\]\([^)\n]*\)", md)))
            by[urlsplit(u).netloc] = [a + b for a, b in zip(by[urlsplit(u).netloc], own, strict=True)]
        return [(k, *v) for k, v in by.items()]
    out = []
    for i, _, h in vendor:
        root = parse(h)
        number = {id(n): k for k, n in enumerate(root.walk())}
        if name == "visible_nodes":
            surgery.prune(root)
            out += [(i, number[id(n)], n.name or None, surgery.clean(n.text) if n.kind == "text" else None if n.kind == "element" else n.text) for n in root.walk()]
            continue
        tables = root.named("table")
        if name == "nearest_table":
            found = [(n, next((t for t in n.above() if t.name == "table"), None)) for n in root.named("tr", "td", "th", "thead", "table")]
            out += [(i, number[id(n)], n.name, number[id(t)]) for n, t in found if t]
        for t in tables:
            sizes = [len(surgery.cells_of(r)) for r in surgery.rows_of(t)]
            if name == "data_tables":
                out.append((i, number[id(t)], len(sizes), min(sizes, default=0), max(sizes, default=0), surgery.is_data(t)))
            elif name == "node_pipe_tables" and surgery.is_data(t) and len(sizes) > 1:
                cells = [[" ".join(c.full_text().split()) for c in surgery.cells_of(r)] for r in surgery.rows_of(t)]
                columns = [c for c in zip(*cells, strict=True) if any(c)]
                widths = [max(3, *map(len, c)) for c in columns]
                line = lambda row: "|" + "".join(f" {c:<{n}} |" for c, n in zip(row, widths, strict=True))  # noqa: E731, B023
                head, *body = zip(*columns, strict=True)
                out.append((i, number[id(t)], "\n".join([line(head), line(["-" * n for n in widths]), *map(line, body)])))
    return out


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_the_others_page_by_page(spark, name):
    assert sorted(map(tuple, catalogue.queries()[name](spark, SMALL).collect()), key=repr) == sorted(page_by_page(name), key=repr)


def test_arrays_and_windows_agree(spark):
    lines = catalogue.line_blocks(spark, SMALL)
    arrays = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("b"))
    for array_form, table_form in ((M.drop_empty_sections, B.drop_empty_sections), (M.compress_levels, B.compress_heading_levels), (lambda b: M.join_link_rows(b, 80), B.join_link_rows)):
        a = {r[0]: r[1] for r in arrays.select("doc_id", array_form(F.col("b"))).collect()}
        b = table_form(lines).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("b"))
        assert a == {r[0]: r[1] for r in b.collect()}


def test_stream_equals_batch(spark):
    batch, stream = (catalogue.queries()[n](spark, SMALL) for n in ("html_to_markdown", "streamed_markdown"))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_output_does_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    out = [sorted(map(tuple, files.with_markdown(pages.repartition(n)).select("page_id", "markdown").collect())) for n in (1, 7)]
    assert out[0] == out[1]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<h2>T</h2><p>é")
    md = files.with_markdown(files.read_html_files(spark, str(tmp_path / "in")))
    files.write_markdown(md, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == "# T\n\né\f"


def pages_of(spark, *htmls):
    return N.explode_nodes(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))


def test_node_operators(spark):
    nodes = pages_of(
        spark,
        '<p>a<!--c--><o:p>z</o:p><i style="visibility:hidden">h</i></p><h3>9k</h3><em>=</em><em> </em><a href=u>t</a><a>›</a>',
        "<table><tr><td>a<td>b<tr><td>c<td><table border=1><tr><td>1<td>2<tr><td>3<td>4</table></table>",
    )
    nodes = nodes.cache()
    assert [r.text for r in N.visible(nodes).where("doc_id = 0 and kind = 'text'").orderBy("node_id").collect()] == ["a", "9k", "=", " ", "t", "›"]
    assert [(r.href, r.text) for r in N.anchors(nodes).collect()] == [("u", "t")]
    assert [r.stat for r in N.stat_headings(nodes).collect()] == ["9k"]
    assert sorted(r.action for r in N.empty_emphasis(nodes).collect()) == ["drop", "unwrap"]
    assert {r.doc_id: r.min_level for r in N.min_heading_level(nodes).collect()} == {0: 3, 1: 7}
    tables = N.data_tables(nodes).orderBy("table_id").collect()
    assert [(r.n_rows, r.min_cells, r.max_cells, r.is_data) for r in tables] == [(2, 2, 2, False), (2, 2, 2, True)]
    inner = N.table_cells(nodes).where(F.col("table_id") == tables[1].table_id)
    assert B.pipe_tables(inner).first()["text"] == "| 1   | 2   |\n| --- | --- |\n| 3   | 4   |"
    flags = N.block_flags(nodes).where("doc_id = 0").collect()
    assert any(r.block_child for r in flags)


def test_nodes_against_plain_loops(spark):
    html = [
        "<table><tr><td>a<br><table><tr><td>b<table><tr><td>c</table></table></td></tr><tr><td><p>d</table><p>e<b>f<i>g</i></b><br>",
        "<div><div><h2> <b></b></h2><h3>x</h3></div><ul><li>1<ul><li>2<br></ul></ul></div>",
        "",
    ]
    nodes = pages_of(spark, *html).cache()
    rows = nodes.collect()
    by = {(r.doc_id, r.node_id): r for r in rows}
    below = lambda r: [x for x in rows if x.doc_id == r.doc_id and r.node_id < x.node_id <= r.last_desc]
    elements = [r for r in rows if r.kind == "element"]
    want = {(r.doc_id, r.node_id): "".join(x.text for x in below(r) if x.kind == "text") for r in elements}
    assert {(r.doc_id, r.node_id): r.subtree_text for r in N.subtree_text(nodes, F.col("kind") == "element").collect()} == want
    want = {(r.doc_id, r.node_id): r.name == "br" or any(x.name == "br" for x in below(r)) for r in elements}
    assert {(r.doc_id, r.node_id): r.has_break for r in N.subtree_has_break(nodes).collect()} == want

    def above(r):
        while r.parent_id is not None:
            r = by[r.doc_id, r.parent_id]
            yield r

    names = ("tr", "td", "table", "p")
    want = {(r.doc_id, r.node_id): next((x.node_id for x in above(r) if x.name == "table"), None) for r in elements if r.name in names}
    assert {(r.doc_id, r.node_id): r.table_id for r in N.nearest_table(nodes, names).collect()} == {k: t for k, t in want.items() if t is not None}
    assert {r.doc_id: r.min_level for r in N.min_heading_level(nodes).collect()} == {0: 7, 1: 3, 2: 7}


def test_pages_without_html_keep_their_row(spark):
    nodes = N.explode_nodes(spark.createDataFrame([(1, None), (2, "<h1>a")], "page_id long, html string"))
    assert sorted((r.doc_id, r.min_level) for r in N.min_heading_level(nodes).collect()) == [(1, 7), (2, 1)]
    assert [r.doc_id for r in N.subtree_text(nodes, F.col("name") == "h1").collect()] == [2]


def test_block_steps_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 0, "# a", 7), (1, 1, "# b", 8), (1, 2, "### c", 9)], "doc_id long, pos long, block string, level long").withColumns({"next": F.lit("n"), "rank": F.lit("r"), "used": F.lit("u"), "reach": F.lit("x")})
    assert B.drop_empty_sections(df).columns == df.columns
    got = B.compress_heading_levels(df).orderBy("pos").collect()
    assert [(r.block, r.level, r.next, r.used) for r in got] == [("# a", 7, "n", "u"), ("# b", 8, "n", "u"), ("## c", 9, "n", "u")]
    nodes = pages_of(spark, "<p>a<!--c-->").withColumn("reach", F.lit(1))
    assert N.visible(nodes).columns == nodes.columns


def test_lists_in_lists(spark):
    rows = [(1, 0, None, True, " one "), (1, 1, 0, False, "a  b"), (1, 2, 1, True, "deep"), (1, 3, 0, False, ""), (1, 4, None, True, ""), (1, 5, None, True, "three"), (2, 0, None, False, ""), (3, 0, None, False, " "), (3, 1, 0, False, "x")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, parent long, ordered boolean, item string")
    got = {r.doc_id: r.text for r in B.nested_list(df).collect()}
    assert got == {1: "1. one\n  - a b\n    1. deep\n3. three", 3: "-\n  - x"}


def test_sql_functions(spark):
    M.register(spark)
    pages = spark.createDataFrame([(1, "<h2>T</h2><p>x"), (2, None), (3, "<h3>a</h3><h2>b</h2><a href=/1>one</a><p><a href=/2>two</a></p><![if x]>y<![endif]><p>z")], "id long, html string")
    pages.createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT id, node_id, name FROM html_nodes(TABLE(SELECT id, html FROM some_pages)) WHERE kind = 'element' AND id = 1 ORDER BY node_id").collect()
    assert [r.name for r in rows] == ["html", "head", "body", "h2", "p"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM html_blocks(TABLE(SELECT id, html FROM some_pages)) ORDER BY id, pos LIMIT 2").collect()] == [(1, 0, "# T"), (1, 1, "x")]
    native = pages.select("id", M.html_to_markdown(F.col("html"), 60).alias("m"))
    scalar = spark.sql("SELECT id, html_to_markdown(html, 60) AS m FROM some_pages")
    assert sorted(map(tuple, scalar.collect())) == sorted(map(tuple, native.collect()))


def test_the_scalar_agrees_with_the_columns(spark):
    M.register(spark)
    pages = catalogue.vendor_pages(spark, SMALL)
    got = pages.select("page_id", F.expr("html_to_markdown(html, 80)").alias("a"), M.html_to_markdown(F.col("html")).alias("b")).collect()
    assert len(got) == 50 and all(r.a == r.b for r in got)


def test_lists_and_tables_of_one_document_take_time_in_proportion(spark):
    import time

    i = F.col("id")
    items = spark.range(100_000).select(F.lit(1).alias("doc_id"), i.alias("pos"), F.when(i % 4 > 0, i - 1).alias("parent"), (i % 2 == 0).alias("ordered"), i.cast("string").alias("item"))
    cells = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("table_id"), (i / 4).cast("int").alias("row"), (i % 4).alias("col"), i.cast("string").alias("cell"))
    began = time.perf_counter()
    lines = B.nested_list(items).first()["text"].split("\n")
    assert (len(lines), lines[3], lines[4]) == (100_000, "      - 3", "2. 4")
    rows = B.pipe_tables(cells).first()["text"].split("\n")
    assert (len(rows), rows[0], rows[-1]) == (25_001, "| 0     | 1     | 2     | 3     |", "| 99996 | 99997 | 99998 | 99999 |")
    assert time.perf_counter() - began < 90


def test_lists_of_one_kind_in_one_item_count_apart(spark):
    rows = [(1, 0, None, True, "a", 0), (1, 1, 0, True, "b", 1), (1, 2, 0, True, "c", 2), (1, 3, 0, True, "d", 2)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, parent long, ordered boolean, item string, list long")
    assert B.nested_list(df).first()["text"] == "1. a\n  1. b\n  1. c\n  2. d"


def test_many_moves_take_little_time():
    import time

    from loomdown.kernel import convert

    began = time.process_time()
    convert.blocks("<b> </b>x" * 16000)
    assert time.process_time() - began < 10
    began = time.process_time()
    for page in ("<b>x" * 4000, "<b> " * 4000, "<i>:</i>" * 20000, "<table><tr><td>x" * 800):
        convert.blocks(page)
    assert time.process_time() - began < 30


def test_native_line_functions_agree_with_the_kernel(spark):
    import random

    from loomdown.functions import text as X
    from loomdown.kernel import serialize, wrap

    rng = random.Random(8)
    parts = ["\\u2013", "\\u{1F9E0}", "\\ud83e\\udde0", "\\U0001F9E0", "\\ud83e", "\\u{}", "\\u{110000}", "\\u{000000041}", "\\uFEFF", "\\", "\\U00110000", "u", "{", "}", "a", "4", " ", "\n", "- ", "* ", "_", "---", "[x]: ", "[x]:", "```", "~~~", "1. ", "\xa0", "+", "\\u{0}"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(9))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string")
    found = df.select("t", X.decode_unicode_escapes(F.col("t")).alias("d"), X.escape_text(F.col("t")).alias("e"), X.is_fence(F.col("t")).alias("f"), X.is_reference(F.col("t")).alias("r"), X.is_thematic_break(F.col("t")).alias("b"), X.list_mark(F.col("t")).alias("m"))
    for r in found.collect():
        core = r.t.lstrip(wrap.BLANK)
        assert r.d == serialize.decode_escapes(r.t)
        assert r.e == serialize.escape(r.t)
        assert r.f == r.t.startswith(wrap.FENCES)
        if "\n" not in r.t:
            assert (r.r, r.b, r.m) == (wrap.REFERENCE.match(core) is not None, bool(core) and wrap.is_break(core), wrap.MARKS.match(r.t)["item"] if r.t[:1] not in " >" else r.m)
    assert "–🧠🧠🧠" in catalogue.queries()["decode_unicode_escapes"](spark, SMALL).where("text like '%–🧠🧠🧠%'").first().text


def test_flex_rows(spark):
    nodes = pages_of(spark, '<div style="display:flex"><div>a</div><div style="display:flex"><i>b</i><i>c</i></div></div><div style="DISPLAY:flex"><b>x</b><b>y</b></div>')
    assert [r.n_kids for r in N.flex_rows(nodes).collect()] == [2]


def test_permissive_and_null_pages(spark):
    df = files.with_markdown(spark.createDataFrame([(1, None), (2, "<p>x")], "page_id long, html string"))
    assert sorted((r.page_id, r.markdown, r.failed) for r in df.collect()) == [(1, None, False), (2, "x", False)]


def test_filled_lines_agree_with_plain_python(spark):
    import random

    from loomdown.functions import text as X
    from loomdown.kernel.wrap import wrap

    rng = random.Random(1)
    parts = ["word", "a", "[x y](u v)", "\\[x y\\](u v)", "[a\\]b](c)", "`c d`", "`", "[", "]", "(", ")", "\\", "\\\\", "![i j](k)", "\n", "\n", "```\n", "~~~", "> ", "- ", "12. ", "# ", "| ", "[r]: ", "    ", "\t", "\xa0", "* * *", "---", "é🧠", "[q](r\\)s t)", "x" * 50, "\\]("]
    rows = [("".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(30))),) for _ in range(2000)]
    for width in (40, 72):
        for r in spark.createDataFrame(rows, "t string").select("t", X.wrap_lines(F.col("t"), width).alias("w")).collect():
            assert r.w == wrap(r.t, width)


def test_long_tokens_and_lines_are_filled(spark):
    from loomdown.functions import text as X

    texts = ["a" * 300_000, "[ " + "a " * 100_000, "\\[" + "b c " * 50_000 + "\\](x)", "`" * 100_001, "```\n" + "x\n" * 100_000, "[" + "\\\\" * 5000, "w " * 100_000]
    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.wrap_lines(F.col("t"), 72).alias("w")).collect()}
    for t in texts:
        assert got[t].split() == t.split()
    assert max(map(len, got[texts[-1]].split("\n"))) <= 72


def test_escapes_of_any_length(spark):
    from loomdown.functions import text as X

    assert spark.range(1).select(X.decode_unicode_escapes(F.lit("\\u{" + "0" * 1200 + "41}x\\u{0}"))).first()[0] == "Ax\x00"
