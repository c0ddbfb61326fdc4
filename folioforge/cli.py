"""Command line: run a named query over a folder of tables and write or show its rows.

    python -m folioforge.cli list
    python -m folioforge.cli run QUERY --tables DIR [--out DIR] [--rows 20]
    python -m folioforge.cli init NAME --root DIR
    python -m folioforge.cli artifacts HOME
    python -m folioforge.cli step NAME --home HOME [--tables DIR] [--set key=value ...]
"""

from __future__ import annotations

import argparse

from . import workspace
from .plans import catalogue


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioforge")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("--tables", required=True)
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=20)
    init = sub.add_parser("init")
    init.add_argument("name")
    init.add_argument("--root", default=".")
    art = sub.add_parser("artifacts")
    art.add_argument("home")
    step = sub.add_parser("step")
    step.add_argument("name")
    step.add_argument("--home", required=True)
    step.add_argument("--tables", default="")
    step.add_argument("--set", action="append", default=[], metavar="key=value")
    a = p.parse_args(argv)
    if a.what == "list":
        print("\n".join(sorted(catalogue.queries())))
    elif a.what == "init":
        print(workspace.init_project(a.root, a.name))
    elif a.what == "artifacts":
        print("\n".join(workspace.list_artifacts(a.home)))
    elif a.what == "step":
        import json

        from pyspark.sql import SparkSession

        from .steps import STEPS

        options: dict = dict(x.split("=", 1) for x in a.set)
        answers = {k.removeprefix("answer."): options.pop(k) for k in list(options) if k.startswith("answer.")}
        spark = SparkSession.builder.appName("folioforge").getOrCreate()
        print(json.dumps(STEPS.run(a.name, spark=spark, home=a.home, tables=a.tables, answers=answers, **options), indent=2, default=str))
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("folioforge").getOrCreate()
        df = catalogue.queries()[a.query](spark, a.tables)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
