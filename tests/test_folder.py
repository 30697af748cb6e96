"""One command for a folder: every file has a row, and failures end nothing."""

from __future__ import annotations

from blockloom.__main__ import main


def test_folder(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    (source / "a.md").write_text("# One\n\ntwo")
    (source / "deep" / "b.html").write_text("<p>three</p>")
    (source / "c.docx").write_bytes(b"no zip")
    (source / "d.xyz").write_text("?")
    assert main([str(source), str(out)], spark) == 1
    said = capsys.readouterr().out
    assert said.startswith("2 converted, 1 failed, 1 unsupported\n") and "c.docx: " in said
    rows = {r.doc_id: r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert {k: r.status for k, r in rows.items()} == {"a": "converted", "b": "converted", "c": "failed", "d": "unsupported"}
    assert rows["d"].reason == "no decoder for extension .xyz" and rows["c"].fmt == "docx"
    assert {r.doc_id for r in spark.read.parquet(f"{out}/json").collect()} == {"a", "b"}
    assert main([str(source), str(tmp_path / "flat"), "--flat"], spark) == 1
    assert capsys.readouterr().out.startswith("1 converted, 1 failed, 1 unsupported\n")
