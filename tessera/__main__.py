"""python -m tessera [--root FOLDER] [--parquet FOLDER NAME...] SQL"""

from __future__ import annotations

import argparse

from tessera.engine import Engine
from tessera.render import lines
from tessera.session import session


def main() -> None:
    a = argparse.ArgumentParser(prog="tessera")
    a.add_argument("sql")
    a.add_argument("--root")
    a.add_argument("--parquet", nargs="+", default=[])
    args = a.parse_args()
    engine = Engine(session("tessera"), args.root)
    if args.parquet:
        engine.register_parquet(*args.parquet)
    df = engine.sql(args.sql)
    print("\t".join(df.columns))
    print("\n".join(lines(df)))


if __name__ == "__main__":
    main()
