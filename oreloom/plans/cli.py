"""Command line: python -m oreloom.plans.cli SOURCE_DIR --output-dir OUT [--overwrite]."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.scan import read_registry
from .mining import mine_tree
from .sink import clean_legacy, write_registry, write_skills

#: Starter domains, each with its own folders below the data root.
DOMAINS = ("sample_python_source", "bioinformatics", "computer_science", "data_science")


def paths(args: argparse.Namespace) -> tuple[str, str]:
    """Source and output folder: the domain before the folder given, else the first domain."""
    domain = args.domain or (None if args.source_dir else DOMAINS[0])
    source = f"{args.data_root}/sample_source/{domain}" if domain else args.source_dir
    return source, args.output_dir or f"{args.data_root}/output_skills/{domain or Path(source).name}"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="oreloom", description="Mine a source tree into packaged skills.")
    out.add_argument("source_dir", nargs="?")
    out.add_argument("--domain")
    out.add_argument("--data-root", default="data")
    out.add_argument("--output-dir")
    out.add_argument("--overwrite", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s", level=logging.INFO)
    source, output = paths(args)
    if not Path(source).is_dir():
        raise SystemExit(f"source directory does not exist: {source}")
    spark = SparkSession.builder.appName("oreloom").getOrCreate()
    mined = mine_tree(spark, source)
    for name, counts in mined.counts.items():  # counts only: code and texts are nobody's log
        logging.getLogger("oreloom").info("%s: %s", name, ", ".join(f"{k} {v}" for k, v in counts.items()))
    clean_legacy(output)
    write_skills(mined.packages, output, args.overwrite)
    existing = None if args.overwrite else read_registry(spark, f"{output}/skills_registry.json")
    write_registry(mined.registry, output, existing)
    for row in mined.packages.select("skill_id").distinct().orderBy("skill_id").toLocalIterator():
        print(f"{output}/{row['skill_id']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
