"""Corpus jobs from the command line, with options from an INI file.

    python -m docweave.jobs init ROOT
    python -m docweave.jobs categories | select NEEDLE | features | spot UNITS QUANTITIES | extract ID | fetch ENDPOINT QUERYFILE NAME

Options of a job come from the file named by --config, else from the first of ``PLACES`` that is there; --processes goes
before the file.  Results are written below the results folder.
"""

from __future__ import annotations

import argparse
import configparser
import logging
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import corpus, html_tree, knowledge, quantity
from .session import ship
from .sources import readers, sinks

PLACES = ("docweave.conf", ".docweave.conf", "~/docweave.conf", "~/.docweave.conf", "~/.config/docweave.conf")
#: option, section and key in the file
KEYS = {"documents": ("DATA", "DocumentsDir"), "other": ("DATA", "OtherDataDir"), "cache": ("DATA", "CacheDir"), "results": ("DATA", "ResultsDir"), "processes": ("PERFORMANCE", "NumberOfProcesses")}
log = logging.getLogger("docweave.jobs")


class MissingConfig(ValueError):
    pass


@dataclass
class Config:
    documents: str | None = None
    other: str | None = None
    cache: str | None = None
    results: str | None = None
    processes: int | None = None

    def need(self, name: str) -> str:
        value = getattr(self, name)
        if value is None:
            raise MissingConfig(f"{KEYS[name][1]} isn't configured")
        return value


def read_config(path: str | None = None) -> Config:
    """The options of a file; values may refer to others as ${Key}.  A named file must exist, without any all are unset."""
    if path is not None and not Path(path).is_file():
        raise MissingConfig(f"{path} doesn't exist")
    found = path or next((str(p) for p in (Path(x).expanduser() for x in PLACES) if p.is_file()), None)
    if found is None:
        log.warning("no configuration file in %s", ", ".join(PLACES))
        return Config()
    parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    parser.read(found)
    values = {name: parser.get(section, key, fallback=None) for name, (section, key) in KEYS.items()}
    return Config(**{**values, "processes": int(values["processes"]) if values["processes"] else None})


def write_config(root: str, path: str) -> None:
    """A first configuration for a root folder, which is made; an existing file stays and is an error."""
    if Path(path).exists():
        raise FileExistsError(f"{path} already exists")
    Path(root).mkdir(parents=True, exist_ok=True)
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    parser["DATA"] = {"Root": root, "DocumentsDir": "${Root}/documents", "OtherDataDir": "${Root}/other", "CacheDir": "${Root}/cache", "ResultsDir": "${Root}/results"}
    parser["PERFORMANCE"] = {"NumberOfProcesses": "4"}
    with open(path, "w") as f:
        parser.write(f)


def run_categories(spark, config, args) -> None:
    sinks.write_categories(readers.metadata(spark, readers.require(spark, config.need("other"), args.file)), f"{config.need('results')}/categories")


def run_select(spark, config, args) -> None:
    docs = readers.documents(spark, config.need("documents"))
    sinks.write_ids(corpus.containing(docs, args.needle), f"{config.need('results')}/selected", order_col="doc_id")


def run_features(spark, config, args) -> None:
    docs = corpus.containing(readers.documents(spark, config.need("documents")), "ltx_unit")
    sinks.write_features(corpus.unit_features(html_tree.nodes(docs, id_col="doc_id")), f"{config.need('results')}/features")


def run_spot(spark, config, args) -> None:
    quantities = readers.checked_csv(spark, args.quantities, ["quantity", "quantityLabel", "dimension", "super_quantities", "symbols_ltx"])
    units = readers.checked_csv(spark, args.units, ["unit", "unitLabel", "quantities", "SIamounts", "SIunit", "notations", "altLabels"])
    index = readers.cached(spark, config.cache, "notations", lambda: knowledge.knowledge_base(units, quantities)["notations"])
    first = index.groupBy("notation").agg(F.min("unit_id").alias("unit_id"))
    finds = quantity.spot(readers.documents(spark, config.need("documents")))
    sinks.write_occurrences(quantity.occurrences(finds, first), f"{config.need('results')}/occurrences")


def run_extract(spark, config, args) -> None:
    markup = readers.open_document(spark, config.need("documents"), args.id)
    target = Path(args.target or ".", f"{args.id.replace('/', '').removesuffix('.html')}.html")
    target.write_text(markup, encoding="utf-8")


def run_fetch(spark, config, args) -> None:
    readers.fetched_csv(args.endpoint, Path(args.query).read_text(), config.need("other"), args.name)


#: job, its function, its own arguments
JOBS = {
    "categories": (run_categories, [("--file", {"default": "metadata.jsonl"})]), "select": (run_select, [("needle", {})]), "features": (run_features, []), "spot": (run_spot, [("units", {}), ("quantities", {})]),
    "extract": (run_extract, [("id", {}), ("--target", {})]), "fetch": (run_fetch, [("endpoint", {}), ("query", {}), ("name", {})]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docweave.jobs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--log-file", default="stdout", help="a file, stdout or stderr")
    parser.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    parser.add_argument("--config")
    parser.add_argument("--processes", type=int)
    jobs = parser.add_subparsers(dest="job")
    jobs.add_parser("init").add_argument("root")
    for name, (_, own) in JOBS.items():
        job = jobs.add_parser(name)
        for flag, options in own:
            job.add_argument(flag, **options)
    args = parser.parse_args(argv)
    to = {"stream": getattr(sys, args.log_file)} if args.log_file in ("stdout", "stderr") else {"filename": args.log_file, "filemode": "w"}
    logging.basicConfig(format="%(process)6d %(asctime)s [%(levelname)s] %(name)s: %(message)s", level=args.log_level, **to)
    if args.job is None:
        parser.print_help()
    elif args.job == "init":
        write_config(args.root, str(Path(args.config or "~/.docweave.conf").expanduser()))
    else:
        config = read_config(args.config)
        config.processes = args.processes or config.processes
        if spark is None and args.job != "fetch":
            builder = SparkSession.builder.appName(f"docweave {args.job}")
            if config.processes:
                builder = builder.config("spark.sql.shuffle.partitions", str(config.processes * 4))
            spark = builder.getOrCreate()
        log.info("job %s begins", args.job)
        JOBS[args.job][0](ship(spark) if spark is not None else None, config, args)
        log.info("job %s is done", args.job)


if __name__ == "__main__":
    main()
