"""A decoder's task holds a bounded number of bytes, however large documents are."""

from __future__ import annotations

from blockloom.sources import decode


def test_rows_are_handed_on_by_bytes():
    docs = [(str(i), "markdown", b"word " * 60_000) for i in range(20)]
    got = list(decode.decoded(docs, {}, False))
    assert [r["doc_id"] for rows, _ in got for r in rows] == [str(i) for i in range(20)]
    assert max(sum(len(r["text"]) for r in rows) for rows, _ in got) < 2 * decode.BYTES
    assert all(len(rows) == len(errors) for rows, errors in got)
