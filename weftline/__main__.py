"""python -m weftline list | run NAME SF_DIR [--out PATH] | rebuild ROOT SF_DIR [--apply] | recluster ROOT SF_DIR DAY: queries and builds from a shell.

rebuild writes the weighted edges as a new build below ROOT and makes it current; without
--apply it tells what is active. recluster does the same with the clusters of the active
build, once per day."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession

from weftline.config import CONFIG
from weftline.operators.lifecycle import rebuild, recluster
from weftline.operators.state import VersionedTable
from weftline.plans import catalogue


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    parts = parser.add_subparsers(dest="command", required=True)
    parts.add_parser("list", help="names of the queries")
    run = parts.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(catalogue.QUERIES), metavar="NAME")
    run.add_argument("sf_dir")
    run.add_argument("--out", help="write Parquet there instead of showing rows")
    build = parts.add_parser("rebuild", help="write and activate a build of the edges")
    cluster = parts.add_parser("recluster", help="cluster the active build, once per day")
    for part in (build, cluster):
        part.add_argument("root", help="folder of the builds")
        part.add_argument("sf_dir")
    build.add_argument("--apply", action="store_true")
    cluster.add_argument("day", help="day of the run, as 2026-07-01")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    if given.command in ("rebuild", "recluster"):
        spark, edges = SparkSession.builder.getOrCreate(), VersionedTable(f"{given.root}/edges")
        made = lambda name: catalogue.QUERIES[name](spark, given.sf_dir)
        if given.command == "rebuild":
            print(rebuild(edges, uuid.uuid4().hex, lambda: made("q_weighted_edges"), apply=given.apply))
        elif not (active := edges.active()):
            raise SystemExit("no active build")
        else:
            print(recluster(VersionedTable(f"{given.root}/clusters"), active, f"{given.day}-{CONFIG.version}", lambda: made("q_clusters")))
        return
    df = catalogue.QUERIES[given.name](SparkSession.builder.getOrCreate(), given.sf_dir)
    if given.out:
        df.write.parquet(given.out)
    else:
        df.show(20, truncate=False)


if __name__ == "__main__":
    main()
