import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomdown.functions import markdown as M
from loomdown.functions import text as X
from loomdown.kernel.serialize import decode_escapes, visible_width

LINES = [json.loads(x) for x in (Path(__file__).parent.parent / "FIXTURES.md").read_text().splitlines() if x.startswith("{")]
GOLDENS = [x for x in LINES if "id" in x]
CASES = [x for x in LINES if "op" in x]


def test_whole_pages(spark):
    for width in {g["width"] for g in GOLDENS}:
        own = [(g["id"], g["html"], g["md"]) for g in GOLDENS if g["width"] == width]
        df = spark.createDataFrame(own, "id string, html string, md string").withColumn("out", M.html_to_markdown(F.col("html"), width, permissive=False))
        wrong = {r["id"]: (r["out"], r["md"]) for r in df.where("not (out <=> md)").collect()}
        assert not wrong


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c['op']} {c['in']!s:.30}")
def test_operator_cases(spark, case):
    op, given, out = case["op"].split(" ")[0], case["in"], case["out"]
    if op == "decode_unicode_escapes":
        assert decode_escapes(given) == out
    elif op in ("drop_empty_sections", "compress_heading_levels"):
        f = {"drop_empty_sections": M.drop_empty_sections, "compress_heading_levels": M.compress_levels}[op]
        assert spark.createDataFrame([(given,)], "b array<string>").select(f(F.col("b"))).first()[0] == out
    else:
        f = {"visible_width": X.visible_width, "block_heading_level": X.block_level, "is_stat_text": X.is_stat, "is_decorative_glyph": X.is_glyph, "wrap_width": X.wrap_width}[op]
        assert spark.createDataFrame([(given,)], "s string").select(f(F.col("s"))).first()[0] == out


def test_null_empty_and_width(spark):
    df = spark.createDataFrame([(None,), ("",), ("<p>x",)], "html string")
    assert [r[0] for r in df.select(M.html_to_markdown(F.col("html"), 7)).collect()] == [None, "", "x"]


def test_ragged_tables_are_padded():
    from loomdown.kernel.convert import blocks

    html = "<table><thead><tr><th>A</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"
    assert blocks(html) == ["| A   |     |\n| --- | --- |\n| 1   | 2   |"]


def test_visible_width_of_links():
    assert visible_width("[a b](http://u) [c](d)") == 5
