"""Command line: ``monitorar``, ``buscar``, ``listar``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from acervo.operators.search import listing, printed, search
from acervo.sources.config import read_settings
from acervo.streaming.watch import ingest_folder, open_index, successes, watch

VERSION = "0.1.0"


def show(rows: DataFrame) -> None:
    """Print the rows in their order."""
    lines = printed(rows).collect()
    print("\n".join(r.linhas for r in lines) if lines else "nenhum documento encontrado")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="acervo")
    parser.add_argument("--versao", action="version", version=VERSION)
    parser.add_argument("--config")
    parser.add_argument("--uma-vez", action="store_true", help="end after the backlog")
    commands = parser.add_subparsers(dest="comando")
    commands.add_parser("monitorar")
    find = commands.add_parser("buscar")
    find.add_argument("termo")
    find.add_argument("--limite", type=int, default=20)
    commands.add_parser("listar").add_argument("--limite", type=int, default=20)
    args = parser.parse_args(argv)
    settings = read_settings(args.config) if args.config else read_settings()
    spark = spark or SparkSession.builder.appName("acervo").getOrCreate()
    settings.make_folders(spark)
    index = open_index(spark, settings.index)
    if args.comando == "buscar":
        show(search(index, args.termo, args.limite))
    elif args.comando == "listar":
        show(listing(index, args.limite))
    else:
        if done := successes(ingest_folder(spark, settings)):
            print(f"{done} documento(s) pendente(s) processado(s)")
        if not args.uma_vez:
            query = watch(spark, settings, f"{settings.index}-checkpoint")
            try:
                query.awaitTermination()
            except KeyboardInterrupt:
                query.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
