"""Queries whose faults showed on larger tables: how often pages are parsed, and how many nodes are held at once."""

import pyarrow as pa
from conftest import SMALL
from oracle import connect, same

from loomdown.functions import markdown as M
from loomdown.kernel.convert import nodes
from loomdown.operators import blocks as B
from loomdown.operators import nodes as N
from loomdown.operators import rewrite as R
from loomdown.plans import catalogue
from loomdown.sources.files import settled

PAGE = "<p>x<table border=1><caption>c<tr><td>1<td><i>R</i><tr><td>n<td><table role=none><tr><td>a<th>b</table></table><td>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_queries_parse_each_page_once_and_move_nodes_once(spark):
    for query in ("deepest_tables", "own_table_parts", "table_verdicts"):
        plan = plan_of(catalogue.QUERIES[query](spark, SMALL))
        assert plan.count("ArrowEvalPython") == 1
        assert plan.split("ArrowEvalPython")[0].count("Exchange") == 1


def test_chosen_nodes_keep_their_numbers(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>no table")], "page_id long, html string")
    names = ("table", "td")
    got = N.explode_nodes(pages, names=names, fields=("node_id", "last_desc", "name", "attrs")).collect()
    assert sorted((r.doc_id, r.node_id, r.last_desc, r.name, tuple(sorted(r.attrs.items()))) for r in got) == sorted((1, n[0], n[2], n[6], tuple(sorted(n[7].items()))) for n in nodes(PAGE) if n[6] in names)
    whole = N.explode_nodes(pages).where("kind is not null").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in whole} == {i: len(nodes(h)) for i, h in ((1, PAGE), (3, ""), (4, "<p>no table"))}


def test_batches_of_pages_are_not_held_as_objects(spark, monkeypatch):
    held = []
    monkeypatch.setattr(M, "node_arrays", lambda rows, fields, whole=M.node_arrays: (held.append(len(rows)), whole(rows, fields))[1])
    found = M.nodes_of(pa.array([PAGE, None] * 2000), None, range(len(M.FIELDS)))
    size = len(nodes(PAGE))
    assert len(found) == 4000 and found.null_count == 2000
    assert sum(held) == 2000 * size and max(held) < M.NODES_AT_ONCE + size
    assert found[3998].as_py()[-1]["node_id"] == size - 1


def test_tables_of_nodes_leave_python_in_small_batches(spark):
    pages = [PAGE, None, "", "<p>" + "<i>x</i>" * 5000] * 500
    wanted = ("node_id", "name", "attrs", "text")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["doc_id", "html"])
    out = list(M.node_rows(wanted)(iter([batch.slice(0, 1000), batch.slice(1000)])))
    assert max(b.num_rows for b in out) < 2 * M.NODES_AT_ONCE
    assert sum(b.num_rows for b in out) == 500 * sum(len(nodes(p)) if p is not None else 1 for p in pages[:4])
    plan = plan_of(N.explode_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string")))
    assert "MapInArrow" in plan and "Generate" not in plan


def test_nodes_of_pages_without_html_are_one_row_of_nulls(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", None), ("c", "")], "page_id string, html string").repartition(1)
    found = N.explode_nodes(pages)
    assert found.dtypes == [("doc_id", "string"), *((f, t) for f, t in (k.split(":") for k in M.kind_of(M.FIELDS)))]
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted([(key, *n) for key, page in (("a", PAGE), ("c", "")) for n in nodes(page)] + [("b", *[None] * 9)], key=repr)


def test_pipe_tables_deal_cells_out_once(spark):
    places = [(1, 0, 0, 0, "a"), (1, 0, 0, 2, "[b](/c)"), (1, 0, 1, 0, "x"), (1, 0, 1, 0, "y\nz"), (1, 0, 1, 1, " "), (1, 0, 3, 2, "wide one"), (1, 5, 0, 0, ""), (1, 5, 1, 1, ""), (2, 0, 0, 0, "alone")]
    cells = spark.createDataFrame(places, "doc_id long, table_id long, row int, col int, cell string")
    for some in (cells, cells.where("table_id = 0").withColumn("table_id", N.F.lit(0))):
        plan = plan_of(B.pipe_tables(some))
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 2  # one, read by both sides of a join
    got = {(r.doc_id, r.table_id): r.text for r in B.pipe_tables(cells).collect()}
    assert got == {
        (1, 0): "| a   | [b](/c)        |\n| --- | -------- |\n| y z |          |\n|     | wide one |",
        (1, 5): "|     |     |\n| --- | --- |\n|     |     |",
    }


def test_rewrites_read_each_node_once(spark):
    html = "<p>a<b> </b><i>:</i> b<table><tr><td>1<td><h2>2</table><div style='display:flex'><div>x</div><div>y</div></div>"
    nodes = settled(R.spread_out(N.explode_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))), "nodes")
    is_cell, is_text = N.F.col("name") == "td", N.F.col("kind") == "text"
    steps = N.counted_below(nodes, is_cell, texts=is_text), R.restored(nodes), N.subtree_text(nodes, is_cell), R.settle_emphasis(nodes)
    assert [plan_of(step).count("Scan parquet") for step in steps] == [1, 1, 2, 3]
    assert "Filter" in plan_of(steps[0])  # what is neither chosen nor counted is not moved
    got = R.settle_emphasis(nodes).where("kind = 'text' or kind is null").collect()
    assert [r.text for r in sorted(got, key=lambda r: (r.doc_id, r.node_id or 0))] == ["a ", ":", " b", "1", "2", "x", "y", None]


def test_only_nodes_in_tables_go_through_the_rounds(spark, monkeypatch):
    html = "<p>a<i>b</i></p>" * 50 + "<table><tr><td>1<td><table><tr><td>2</table></table>"
    nodes = settled(R.spread_out(N.explode_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))), "nodes")
    seen = []
    monkeypatch.setattr(R, "flatten_layout", lambda n, layout, whole=R.flatten_layout: (seen.append(n.count()), whole(n, layout))[1])
    flat = R.flatten_tables(nodes)
    assert len(seen) == 2 and max(seen) < 15
    assert flat.where("name = 'p'").count() == 51 and flat.where("name = 'i' and depth = 4").count() == 50


def test_what_is_shuffled_for_a_written_table_goes(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}

    before = shuffled()
    rows = spark.range(1000).groupBy((N.F.col("id") % 7).alias("k")).count()
    assert settled(rows, "counts").count() == 7
    left = shuffled() - before
    assert len({b.split("_")[1] for b in left}) <= 1  # that of the count just made
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_equal_pages_are_made_once(spark):
    rows = [(5, "<p>a"), (2, "<p>a"), (9, None), (3, "<p>b"), (7, None), (8, "<p>a ")]
    orders, pages = catalogue.told_apart(spark.createDataFrame(rows, "o_orderkey long, html string"))
    assert sorted(map(tuple, orders.collect())) == [(2, 2), (3, 3), (5, 2), (7, 7), (8, 8), (9, 7)]
    assert sorted(map(tuple, pages.collect())) == [(2, "<p>a"), (3, "<p>b"), (7, None), (8, "<p>a ")]


def pages_told_apart(spark, monkeypatch, query):
    """How many orders a query's pages are of, and how many it converts; its rows are those of its SQL."""
    seen = []
    monkeypatch.setattr(catalogue, "told_apart", lambda p, whole=catalogue.told_apart: (seen.append(whole(p)), seen[-1])[1])
    same(catalogue.QUERIES[query](spark, SMALL), connect(SMALL), catalogue.SQL[query])
    ((orders, pages),) = seen
    return orders.count(), pages.count()


def test_equal_orders_are_converted_once_table_markdown(spark, monkeypatch):
    orders, pages = pages_told_apart(spark, monkeypatch, "table_markdown")
    assert pages < orders == spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey").distinct().count()


def test_orders_go_slice_by_slice_table_cells(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalogue, "PAGES_AT_ONCE", 150)
    monkeypatch.setattr(N, "table_cells", lambda n, whole=N.table_cells: (made.append(n), whole(n))[1])
    orders, pages = pages_told_apart(spark, monkeypatch, "table_cells")
    assert pages < orders and len(made) == -(-pages // 600) > 1
    assert all(spark.read.parquet(n.settled_path).isEmpty() for n in made)


def test_orders_are_rewritten_slice_by_slice(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalogue, "PAGES_AT_ONCE", 1000)
    monkeypatch.setattr(R, "flatten_tables", lambda n, whole=R.flatten_tables: (made.append(whole(n)), made[-1])[1])
    orders, pages = pages_told_apart(spark, monkeypatch, "rewrite_tables")
    assert pages < orders and len(made) == -(-pages // 1000) > 1
    assert all(spark.read.parquet(m.settled_path).isEmpty() for m in made)
