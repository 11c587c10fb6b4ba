"""Command line: ingest recordings into a store of tables, queue files again, or show what recordings hold."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import monitor, mutate, recordings
from .sources import tables, ts


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="telesift", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in (("ingest", ("mount", "tables")), ("reingest", ("path", "tables")), ("reingest-program", ("program", "tables")), ("dump", ("mount",))):
        sub = verbs.add_parser(verb)
        for name in names:
            sub.add_argument(name)
        if verb == "ingest":
            sub.add_argument("--exclude", action="append", default=[])
            sub.add_argument("--include", action="append", default=[])
            sub.add_argument("--streams", help="folder of the caption streams; those that are missing are made first")
            sub.add_argument("--batch", type=int, default=10_000, help="files that are claimed and committed together")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "dump":
        for r in recordings.dump_files(ts.listing(spark, a.mount)).orderBy("path", "no").toLocalIterator():
            print(f"{r['path']}  {r['line']}")
        return
    store = tables.Store(spark, a.tables)
    if a.verb == "ingest":
        disk = ts.listing(spark, a.mount)
        store.change(lambda t: mutate.enqueue(mutate.crash_recovery(t), disk, tuple(a.exclude), tuple(a.include)))
        if a.streams:
            recordings.regenerate_next(store, disk, a.streams)
        recordings.ingest_all(store, disk, a.batch)
        store.compact()
    elif a.verb == "reingest":
        if store.load().ts_files.where(F.col("path") == a.path).isEmpty():
            raise KeyError(f"no such file: {a.path}")
        store.change(lambda t: mutate.reset_files(t, t.ts_files.where(F.col("path") == a.path).select("ts_file_id")))
    else:
        store.change(lambda t: mutate.reset_program(t, int(a.program)))
    print(monitor.summary_counts(store.load()).first().asDict())


if __name__ == "__main__":
    main()
