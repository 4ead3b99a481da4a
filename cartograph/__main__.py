"""Run one registered query: ``python -m cartograph NAME [SF_DIR] [--explain] [--rows N]``.

``python -m cartograph --list`` prints the registered names.
"""

from __future__ import annotations

import argparse

from cartograph.plans.registry import load_all
from cartograph.session import get_session


def main() -> None:
    ap = argparse.ArgumentParser(prog="cartograph")
    ap.add_argument("name", nargs="?")
    ap.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("--explain", action="store_true", help="print the formatted physical plan")
    ap.add_argument("--rows", type=int, default=20, help="rows to show")
    ap.add_argument("--list", action="store_true", help="list registered queries")
    args = ap.parse_args()
    queries = load_all()
    if args.list or not args.name:
        for name, q in queries.items():
            print(f"{name}{'' if q.oracle else '  (no SQL oracle)'}")
        return
    spark = get_session(app=f"cartograph-{args.name}")
    df = queries[args.name].build(spark, args.sf_dir)
    if args.explain:
        df.explain("formatted")
    df.show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
