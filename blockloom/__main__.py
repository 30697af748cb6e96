"""python -m blockloom SOURCE OUT: converts a folder of documents; exits with 1 if a file failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.convert import convert_folder

#: Failures that are named on the screen; all are in OUT/summary.
SHOWN = 20


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = argparse.ArgumentParser(prog="blockloom", description="Converts documents to blocks, JSON and Markdown.")
    asked.add_argument("source", help="folder of documents, at any address that Spark reads")
    asked.add_argument("out", help="folder for blocks, json, markdown, blobs, errors and summary")
    asked.add_argument("--flat", action="store_true", help="leave out the folders below source")
    given = asked.parse_args(args)
    session = spark or SparkSession.builder.appName("blockloom").getOrCreate()
    told = convert_folder(session, given.source, given.out, recursive=not given.flat)
    counts = {r["status"]: r["count"] for r in told.groupBy("status").count().collect()}
    print(", ".join(f"{counts.get(s, 0)} {s}" for s in ("converted", "failed", "unsupported")))
    for r in told.where("status = 'failed'").orderBy("source_path").limit(SHOWN).collect():
        print(f"{r['source_path']}: {r['reason']}")
    return 1 if counts.get("failed") else 0


if __name__ == "__main__":
    sys.exit(main())
