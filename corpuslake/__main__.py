"""``python -m corpuslake query --lake FOLDER (--sql TEXT | --file PATH) [--limit N]``, ``tables --lake FOLDER``, ``run QUERY --lake FOLDER``."""

from __future__ import annotations

import argparse
import sys

from corpuslake.session import build_session
from corpuslake.views import register_folder, run_sql


def main(arguments: list[str]) -> int:
    p = argparse.ArgumentParser(prog="corpuslake")
    p.add_argument("command", choices=("query", "tables", "run"))
    p.add_argument("name", nargs="?", help="a query of the catalogue, for run")
    p.add_argument("--lake", required=True)
    p.add_argument("--sql")
    p.add_argument("--file")
    p.add_argument("--limit", type=int, default=100, help="rows shown")
    a = p.parse_args(arguments)
    spark = build_session("corpuslake")
    if a.command == "run":
        from corpuslake.plans.catalogue import QUERIES

        QUERIES[a.name](spark, a.lake).show(a.limit, truncate=False)
        return 0
    names = register_folder(spark, a.lake)
    if a.command == "tables":
        print("\n".join(names))
    else:
        run_sql(spark, a.sql, a.file).show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
