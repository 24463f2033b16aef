"""``python -m sparklode FOLDER QUERY``: search a folder tree."""

from __future__ import annotations

import argparse
import sys

from sparklode.operators.search import on_content, search
from sparklode.plans.compile import Options
from sparklode.plans.literals import QueryError
from sparklode.plans.query import parse
from sparklode.session import session
from sparklode.sources.extract import binary_files, scanned, texts
from sparklode.sources.tables import printed


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparklode")
    p.add_argument("folder")
    p.add_argument("query")
    p.add_argument("--target", choices=("name", "content", "both"), default="name")
    p.add_argument("--mode", choices=("substring", "word", "wildcard", "regex"), default="substring")
    p.add_argument("--case-sensitive", action="store_true")
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--packages", action="store_true")
    p.add_argument("--max-size", type=int, default=0)
    p.add_argument("--limit", type=int, default=2000)
    a = p.parse_args(argv)
    o = Options(a.target, a.mode, a.case_sensitive, a.hidden, a.packages, a.max_size)
    try:
        node = parse(a.query)
    except QueryError as e:
        print(e, file=sys.stderr)
        return 2
    spark = session()
    files = scanned(spark, a.folder)
    if on_content(node, o) or o.target == "both":
        from pyspark.sql import functions as F

        found = texts(binary_files(spark, a.folder), a.max_size).withColumn("path", F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""))
        files = files.drop("text").join(found, "path", "left")
    lines = printed(search(files, a.query, o, limit=a.limit)).toLocalIterator()
    n = 0
    for n, row in enumerate(lines, 1):
        print(row["value"])
    print(f"{n} results")
    return 0


if __name__ == "__main__":
    sys.exit(main())
