"""Command line: version, init, validate, explain, apply, schema, run, dashboard, fuzzy-templates, quickstart."""

from __future__ import annotations

import argparse
import json
import sys

from kinweave import __version__


def _spark(store: str):
    """A session whose checkpoints, unless the cluster names a folder, go beside the store, which all executors reach."""
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("kinweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{store.rstrip('/')}/_checkpoints")
    return spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("kinweave")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("fuzzy-templates")
    commands.add_parser("schema")
    for name in ("validate", "explain"):
        commands.add_parser(name).add_argument("config")
    start = commands.add_parser("init", help="write a configuration to start from; with --folder, one for the Parquet tables there")
    start.add_argument("config")
    start.add_argument("--folder")
    start.add_argument("--tables", default="", help="names, separated by commas")
    apply_ = commands.add_parser("apply", help="write a configuration to the metadata tables of a database")
    apply_.add_argument("config")
    apply_.add_argument("--database", required=True)
    board = commands.add_parser("dashboard", help="write the monitoring views as one HTML page")
    board.add_argument("--store", required=True)
    board.add_argument("--out", required=True)
    run = commands.add_parser("run")
    run.add_argument("config")
    run.add_argument("--store", required=True)
    run.add_argument("--folder", help="read sources from FOLDER/<table>.parquet instead of the catalog")
    run.add_argument("--mode", default="FULL")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--max-iters", type=int, help="bound of the rounds of label contraction")
    run.add_argument("--strict", action="store_true", help="no fuzzy matching")
    quick = commands.add_parser("quickstart")
    quick.add_argument("--store", required=True)
    quick.add_argument("--persons", type=int, default=2500)
    args = parser.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "fuzzy-templates":
        from kinweave.functions.text import fuzzy_templates

        print(json.dumps(fuzzy_templates(), indent=2))
        return 0
    if args.command == "schema":
        from kinweave.sources.store import SCHEMAS

        print(json.dumps(SCHEMAS, indent=2))
        return 0
    from kinweave.plans.config import Config, ConfigError, Rule, Source, Survivorship, load
    from kinweave.plans.engine import Engine, RunConfig
    from kinweave.sources.store import Store

    if args.command == "init":
        from kinweave.plans.discover import guessed, template

        text = template()
        if args.folder:
            spark = _spark(args.folder)
            text = guessed({t: spark.read.parquet(f"{args.folder}/{t}.parquet").columns for t in args.tables.split(",") if t})
        with open(args.config, "x", encoding="utf-8") as f:
            f.write(text)
        return 0
    if args.command == "dashboard":
        from kinweave.sources.views import dashboard

        with open(args.out, "w", encoding="utf-8") as f:
            f.write(dashboard(Store(_spark(args.store), args.store)))
        return 0
    if args.command == "quickstart":
        from kinweave.sources.datagen import customers

        people = customers(_spark(args.store), args.persons)
        source = Source("demo", "demo_customers", "customer_id", (("EMAIL", "email"), ("PHONE", "phone"), ("LOYALTY", "loyalty_id")), (("first_name", "first_name"), ("email", "email")), watermark="created_at")
        config = Config((source,), (Rule("EMAIL"), Rule("PHONE", "DIGITS_ONLY"), Rule("LOYALTY", "NONE")), survivorship=(Survivorship("first_name", "FREQUENCY"), Survivorship("email", "RECENCY")))
        result = Engine(_spark(args.store), config, lambda s: people, Store(_spark(args.store), args.store)).run()
    else:
        try:
            config = load(args.config)
        except (ConfigError, OSError) as e:
            print(f"invalid: {e}", file=sys.stderr)
            return 2
        if args.command == "apply":
            from kinweave.sources import metadata

            metadata.write(_spark("."), config, args.database)
            print(config.fingerprint())
            return 0
        if args.command != "run":
            print(config.fingerprint() if args.command == "validate" else json.dumps(config.to_dict(), indent=2))
            return 0
        from kinweave.sources.readers import catalog_reader

        spark = _spark(args.store)
        result = Engine(spark, config, catalog_reader(spark, args.folder), Store(spark, args.store)).run(RunConfig(args.mode, args.dry_run, args.strict, args.max_iters))
    print(json.dumps(vars(result), indent=2, default=str))
    return 1 if result.status == "FAILED" else 0


if __name__ == "__main__":
    sys.exit(main())
