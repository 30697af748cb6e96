"""Inline Markdown is made where blocks are, and what is kept for rendering is small."""

from __future__ import annotations

from blockloom.operators import render
from blockloom.sources import decode

PAGE = "<h1>a <b>x_y</h1><p>one <b>two <b>three <i>four</i> <a href='u?a'>five</a></p><ul><li>l <b>m</li><li>n<pre>code</pre></li></ul><table><tr><td>c <b>d<td>e</table><p>end <s>z</s>"


def test_kept_for_rendering(spark):
    """Runs of cells and lists only, each mark once; the same Markdown, that of a list with more than paragraphs included."""
    blocks = decode.blocks(spark.createDataFrame([("p", PAGE.encode())], "doc_id string, content binary"), "html")
    kept = render.with_inline(blocks)
    assert kept.where("runs is not null and parent_uid is null and list_id is null").count() == 0
    assert kept.where("exists(runs, r -> size(r.marks) <> size(array_distinct(r.marks)))").count() == 0 < blocks.where("exists(runs, r -> size(r.marks) <> size(array_distinct(r.marks)))").count()
    plain, made = (render.to_markdown(x).collect() for x in (blocks.withColumn("runs", blocks["runs"]), kept))
    assert plain == made and "**x\\_y**" in made[0]["markdown"] and "<ul><li>" in made[0]["markdown"] and "[**five**](u?a)" in made[0]["markdown"]
