"""Steps over tables of blocks (doc_id, pos, block) and cells, as windows and aggregates.

A document's blocks are few, so windows are partitioned by document and never wider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import release, settled

DOC = "doc_id"


def explode_blocks(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    return df.select(F.col(key).alias(DOC), F.posexplode(blocks).alias("pos", "block"))


def drop_empty_sections(blocks: DataFrame) -> DataFrame:
    level, order = X.block_level(F.col("block")), W.partitionBy(DOC).orderBy("pos")
    judged = blocks.select(F.struct("*").alias("row"), F.coalesce(F.lead(level).over(order) > level, F.lit(True)).alias("keep"))
    return judged.where("keep").select("row.*")


def compress_heading_levels(blocks: DataFrame) -> DataFrame:
    """Heading levels as ranks of those in use, if there are two or more; the other columns stay."""
    level = X.block_level(F.col("row.block"))
    df = blocks.select(F.struct("*").alias("row")).withColumn("level", level)
    rank = F.dense_rank().over(W.partitionBy(f"row.{DOC}", F.col("level").isNull()).orderBy("level"))
    df = df.withColumns({"rank": rank, "used": F.size(F.collect_set("level").over(W.partitionBy(f"row.{DOC}")))})
    ranked = F.concat(F.repeat(F.lit("#"), F.col("rank")), F.regexp_replace("row.block", r"\A#*", ""))
    block = F.when(F.col("level").isNotNull() & (F.col("used") >= 2), ranked).otherwise(F.col("row.block"))
    return df.select(*(block.alias(c) if c == "block" else F.col("row")[c].alias(c) for c in blocks.columns))


def join_link_rows(blocks: DataFrame, width: int = 80) -> DataFrame:
    """Gaps and islands: a run of short links is an island, and so is each other block."""
    order = W.partitionBy(DOC).orderBy("pos")
    df = blocks.withColumn("short", X.is_short_link(F.col("block")))
    df = df.withColumn("island", F.sum(F.when(F.col("short") & F.coalesce(F.lag("short").over(order), F.lit(False)), 0).otherwise(1)).over(order))
    df = df.groupBy(DOC, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("run"))
    line = F.array_join(F.transform("run", lambda x: x["block"]), " · ")
    first = F.get("run", F.lit(0))["pos"]
    fits = (F.size("run") >= 2) & (X.visible_width(line) <= width)
    runs = F.when(fits, F.array(F.struct(first.alias("pos"), line.alias("block")))).otherwise(F.col("run"))
    return df.select(DOC, F.explode(runs).alias("b")).select(DOC, "b.pos", "b.block")


def assemble(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the blocks in order, a blank line between each two."""
    run = F.array_sort(F.collect_list(F.struct("pos", "block")))
    out = blocks.groupBy(DOC).agg(F.array_join(F.transform(run, lambda x: x["block"]), "\n\n").alias("text"))
    return out.withColumn("text", X.collapse_blank_runs(F.col("text")))


def number_list(items: DataFrame, ordered: bool = True, depth: int = 0) -> DataFrame:
    """(doc_id, text) of items (doc_id, pos, item): numbers count skipped blank items too."""
    n = F.row_number().over(W.partitionBy(DOC).orderBy("pos"))
    mark = F.concat(n.cast("string"), F.lit(". ")) if ordered else F.lit("- ")
    lines = items.withColumn("line", F.concat(F.lit("  " * depth), mark, X.one_line(F.col("item")))).where(X.one_line(F.col("item")) != "")
    run = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(DOC).agg(F.array_join(F.transform(run, lambda x: x["line"]), "\n").alias("text"))


def nested_list(items: DataFrame) -> DataFrame:
    """(doc_id, text) of lists in lists: items (doc_id, pos, parent, ordered, item) and perhaps `list`, in document order.

    pos numbers the items of a document; parent is the pos of the item that a list stands in, null at the top, and `ordered` is
    that list's kind. Numbers count from 1 in each list: `list` tells apart lists of one kind in one item, where it is given. An item is left out if
    it has neither text nor items below it, but it is counted; one without text that has some keeps its mark. Each level indents by two spaces.

    Depths come from joins of items with what they stand in: each round doubles how far up is known, so that there are as many as the depth has
    binary digits, and no more rows than items.
    """
    own = items.select(DOC, "pos", "parent", "ordered", F.col("list") if "list" in items.columns else F.lit(None).alias("list"), X.one_line(F.col("item")).alias("item"))
    own = own.withColumn("n", F.row_number().over(W.partitionBy(DOC, "parent", "ordered", "list").orderBy("pos")))
    # `up` is an item above, `depth` how many levels; null once that is known to be all.
    known = settled(own.select(DOC, "pos", F.when(F.col("parent") < F.col("pos"), F.col("parent")).alias("up"), F.coalesce(F.col("parent") < F.col("pos"), F.lit(False)).cast("int").alias("depth")), "depths")
    while known.where("up is not null").limit(1).count():
        above = known.select(DOC, F.col("pos").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        known, old = settled(known.join(above, [DOC, "up"], "left").select(DOC, "pos", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths"), known
        release(old)
    holds = own.where("parent is not null").select(DOC, F.col("parent").alias("pos")).distinct().withColumn("holds", F.lit(True))
    shown = own.join(known.drop("up"), [DOC, "pos"]).join(holds, [DOC, "pos"], "left").where("item <> '' or holds")
    mark = F.when(F.col("ordered"), F.concat(F.col("n").cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    line = F.rtrim(F.concat(F.repeat(F.lit("  "), F.col("depth")), mark, F.col("item")))
    run = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return shown.groupBy(DOC).agg(F.array_join(F.transform(run, lambda x: x["line"]), "\n").alias("text"))


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, table_id, row, col, cell) without the columns that are blank throughout, unless all are."""
    table = (DOC, "table_id")
    full = cells.groupBy(*table, "col").agg(F.bool_or(F.col("cell") != "").alias("full"))
    full = full.withColumn("any", F.bool_or("full").over(W.partitionBy(*table))).where("full or not any").select(*table, "col")
    return cells.join(full, [*table, "col"], "left_semi")


def pipe_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, text): cells as pipe tables, the first row as head; tables with one row vanish.

    Cells are dealt out by table once, and all that follows stays where they are: columns are measured over the table, cells are put into rows, and rows
    into tables, so that nothing looks at more than its own row. Repeated (row, col) places keep the cell that sorts last.
    """
    # One value as key, which stays the same where the number of the table is a constant, so that what was dealt out by it is not dealt out again.
    key = F.struct(DOC, "table_id").alias("t")
    df = cells.select(key, "row", "col", X.one_line(F.col("cell")).alias("cell")).repartition("t").groupBy("t", "row", "col").agg(F.max("cell").alias("cell"))
    df = df.withColumn("width", X.visible_width(F.col("cell")))
    columns = df.groupBy("t", "col").agg(F.greatest(F.lit(3), F.max("width")).alias("n"), F.bool_or(F.col("cell") != "").alias("full"))
    sizes = columns.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("col", "n", "full"))).alias("sizes"))
    some = F.exists("sizes", lambda s: s["full"])
    sizes = sizes.withColumn("sizes", F.when(some, F.filter("sizes", lambda s: s["full"])).otherwise(F.col("sizes")))
    # What a row has, by columns; the rest of the row is filled with blanks.
    rows = df.groupBy("t", "row").agg(F.map_from_entries(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", F.struct("cell", "width"))))).alias("own"))
    line = lambda part: F.concat(F.lit("|"), F.array_join(F.transform("sizes", part), ""))

    def cell(s: Column) -> Column:
        own = F.try_element_at("own", s["col"])
        return F.concat(F.lit(" "), F.coalesce(own["cell"], F.lit("")), F.repeat(F.lit(" "), s["n"] - F.coalesce(own["width"], F.lit(0))), F.lit(" |"))

    rule = line(lambda s: F.concat(F.lit(" "), F.repeat(F.lit("-"), s["n"]), F.lit(" |")))
    rows = rows.join(sizes, "t").select("t", "row", line(cell).alias("line"), "sizes")
    run = F.array_sort(F.collect_list(F.struct("row", "line")))
    out = rows.groupBy("t").agg(run.alias("run"), F.any_value("sizes").alias("sizes")).where(F.size("run") >= 2).withColumn("rule", rule)
    lines = F.transform("run", lambda x: x["line"])
    whole = F.concat(F.slice(lines, 1, 1), F.array("rule"), F.slice(lines, F.lit(2), F.size("run")))
    return out.select(f"t.{DOC}", "t.table_id", F.array_join(whole, "\n").alias("text"))
