"""Command line: ``python -m tidemark.cli --root URI COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from tidemark.catalog import Catalog
from tidemark.database import Database
from tidemark.session import spark_session
from tidemark.sources import tables


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description="Named, versioned databases on Spark.")
    parser.add_argument("--root", required=True, help="folder of the databases, on any file system that Spark reads")
    parser.add_argument("--key", help="private key (base64) for databases with an owner")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, extra in {
        "create": [], "drop": [], "tables": [], "query": ["sql"], "execute": ["sql"], "migrate": ["file"], "fork": ["target"],
        "export": ["path"], "import": ["path"], "archive": ["path"], "restore": ["path"], "shell": [],
    }.items():
        own = sub.add_parser(name)
        for arg in ["database", *extra]:
            own.add_argument(arg)
    args = parser.parse_args(argv)
    spark = spark_session()
    catalog = Catalog(spark, args.root)
    if args.command == "create":
        Database.create(spark, args.root, args.database)
        return 0
    if args.command == "restore":
        tables.import_archive(catalog, args.path, args.database)
        return 0
    if args.command == "drop":
        catalog.drop(args.database)
        return 0
    db = Database(spark, args.root, args.database, args.key)
    if args.command == "tables":
        print(db.describe())
    elif args.command == "query":
        for row in db.rows(args.sql):
            print(row)
    elif args.command == "execute":
        got = db.execute(args.sql)
        got.show(truncate=False) if isinstance(got, DataFrame) else print(got)
    elif args.command == "migrate":
        results = db.run_script(Path(args.file).read_text())
        for statement, error in results:
            print(f"{'failed: ' + error if error else 'ok'}: {statement[:70]}")
        return int(any(error for _, error in results))
    elif args.command == "fork":
        db.fork(args.target)
    elif args.command == "export":
        tables.export_database(db, args.path)
    elif args.command == "import":
        print(tables.import_database(db, args.path))
    elif args.command == "archive":
        tables.export_archive(db, args.path)
    elif args.command == "shell":
        shell(db)
    return 0


def shell(db: Database) -> None:
    """Statements from standard input, each up to its semicolon; a transaction lasts until it ends."""
    held, session = "", None
    for line in sys.stdin:
        held += line
        if not line.rstrip().endswith(";"):
            continue
        verb = held.split(None, 1)[0].rstrip(";").upper() if held.split() else ""
        try:
            got = db.execute(held.strip().rstrip(";"), session)
            got.show(truncate=False) if isinstance(got, DataFrame) else print(got)
            session = got if verb in ("BEGIN", "START") else None if verb in ("COMMIT", "ROLLBACK") else session
        except Exception as error:  # said, and the shell goes on
            print(str(error).splitlines()[0], file=sys.stderr)
        held = ""


if __name__ == "__main__":
    sys.exit(main())
