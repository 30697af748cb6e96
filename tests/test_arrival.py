"""Files that arrive as a stream: each content once, over restarts and batches that run again."""

from __future__ import annotations

from blockloom.streaming import ingest


def test_replay_and_repeats(spark, tmp_path):
    """Equal files in one batch and in later ones add nothing; a batch whose commit was lost runs again and leaves the same; no table of what was seen."""
    for name in ("in", "out", "ck"):
        (tmp_path / name).mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)

    def run():
        query = ingest.start(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), formats=("markdown", "docx", "pptx"))
        query.awaitTermination()
        return query, sorted(r.text for r in spark.read.parquet(str(tmp_path / "out" / "blocks")).collect())

    put("a.md", "# one\n"), put("b.md", "# one\n"), put("c.txt", "none")
    assert run()[1] == ["one"]
    put("d.md", "# one\n"), put("e.md", "# two\n"), put("f.md", "# two\n")
    query, texts = run()
    assert texts == ["one", "two"] and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for lost in (last, last.with_name(f".{last.name}.crc")):
        lost.unlink(missing_ok=True)
    put("g.md", "# two\n"), put("h.md", "# three\n")
    assert run()[1] == ["one", "three", "two"]
    assert not (tmp_path / "out" / "seen").exists() and spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
