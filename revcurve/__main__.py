"""Command line: run one query on a sales table, or write the three models.

    python -m revcurve run s13_sign_by_code --sales /data/sales.csv --format csv
    python -m revcurve run m13_subscription_mart --sales /data/sales/ --out /data/out/mrr
    python -m revcurve models --sales /data/sales/ --out /data/models
    python -m revcurve list

Cluster settings (master, memory, shuffle partitions, ``spark.checkpoint.dir``) come from
``spark-submit`` / ``spark-defaults.conf``; the session only adds the AQE settings.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="revcurve")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the query IDs")
    run = sub.add_parser("run", help="run one query on a sales table")
    run.add_argument("query")
    run.add_argument("--sales", required=True, help="path of the raw sales table")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc", "json"])
    run.add_argument("--out", help="write the result as Parquet here (default: show it)")
    run.add_argument("--rows", type=int, default=50, help="rows to show without --out")
    models = sub.add_parser("models", help="write staging and both marts")
    models.add_argument("--sales", required=True)
    models.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc", "json"])
    models.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    from revcurve.plans import registry

    if args.cmd == "list":
        print("\n".join(registry.operators()))
        return 0

    from revcurve.plans.session import build_session
    from revcurve.sources.files import read_sales, write_model

    spark = build_session()
    sales = read_sales(spark, args.sales, fmt=args.format)
    if args.cmd == "models":
        from revcurve.plans.models import write_models

        for name, path in write_models(spark, sales, args.out).items():
            print(f"{name}\t{path}")
        return 0
    ops = registry.operators()
    if args.query not in ops:
        print(f"unknown query {args.query!r}; see `python -m revcurve list`", file=sys.stderr)
        return 2
    df = ops[args.query](sales)
    if args.out:
        write_model(df, args.out)
    else:
        print(f"first {args.rows} rows (--out writes all of them)")
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
