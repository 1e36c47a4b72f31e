"""Table access: catalog tables, Parquet parts, CSV seeds, introspection."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.config import Config, ConfigError, Source

_PART = re.compile(r"(?P<table>.+?)(?:_part_\d+)?\.parquet$")


def catalog_reader(spark: SparkSession, folder: str | None = None, prefix: str = "") -> Callable[[Source], DataFrame]:
    """Read a source by its format, from a catalog table, or from ``folder/<table>.parquet``; ``prefix``: a catalog or database put before table names."""

    def read(source: Source) -> DataFrame:
        if source.format:
            options = {"header": "true", "inferSchema": "true"} if source.format == "csv" else {}
            return spark.read.format(source.format).options(**options).load(source.table if folder is None else f"{folder}/{source.table}")
        if folder is not None:
            return spark.read.parquet(f"{folder}/{source.table}.parquet")
        return spark.table(f"{prefix}.{source.table}" if prefix else source.table)

    return read


def grouped_parts(paths: list[str]) -> dict[str, list[str]]:
    """Parquet files by table: ``orders_part_0001.parquet`` and its like belong to ``orders``."""
    out: dict[str, list[str]] = defaultdict(list)
    for p in sorted(paths):
        if m := _PART.match(p.rsplit("/", 1)[-1]):
            out[m["table"]].append(p)
    return dict(out)


def read_parts(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(*files) for name, files in grouped_parts(paths).items()}


def load_tables(spark: SparkSession, paths: list[str], database: str) -> list[str]:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in read_parts(spark, paths).items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
    return sorted(grouped_parts(paths))


def read_seed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


#: Rows that ``query`` brings to the driver at most.
MOST_ROWS = 100_000


def query(spark: SparkSession, sql: str, args: list | None = None, most: int = MOST_ROWS, **named) -> list[dict]:
    """Rows of a query with named (``:name``) or positional (``?``) parameters; more than ``most`` are an error, not a cut."""
    rows = spark.sql(sql, args=args if args is not None else named).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the query has more than {most} rows")
    return [r.asDict() for r in rows]


def statements(script: str) -> list[str]:
    """The statements of a script, split at semicolons outside quotes and comments."""
    parts = re.findall(r"(?:'(?:[^'\\\\]|\\\\.|'')*'|\"(?:[^\"\\\\]|\\\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+", script, re.S)
    bare = [re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip() for p in parts]
    return [p.strip() for p, b in zip(parts, bare) if b]


def run_script(spark: SparkSession, script: str) -> int:
    """Run each statement of a script, in order; returns how many there were."""
    found = statements(script)
    for s in found:
        spark.sql(s)
    return len(found)


def query_one(spark: SparkSession, sql: str, **args):
    row = spark.sql(sql, args=args).first()
    return None if row is None else row[0]


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def columns(df: DataFrame) -> list[dict]:
    return [{"name": n.lower(), "type": t} for n, t in df.dtypes]


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def findings(spark: SparkSession, config: Config, read: Callable[[Source], DataFrame]) -> DataFrame:
    """(level, source, finding): what stands against running a configuration. Only schemas are read."""
    out = []
    if not config.active_sources():
        out.append(("ERROR", "", "no active source"))
    if not config.rule_of():
        out.append(("WARNING", "", "no active rule"))
    types = set(config.rule_of())
    if any(r.strategy in ("PRIORITY", "SOURCE_PRIORITY") and not r.priority and r.active for r in config.survivorship):
        for s in config.active_sources():
            if s.trust_rank is None:
                out.append(("WARNING", s.table_id, "no trust rank, but an attribute goes by priority without a list"))
    ranks = [s.trust_rank for s in config.active_sources() if s.trust_rank is not None]
    for s in config.active_sources():
        if s.trust_rank is not None and ranks.count(s.trust_rank) > 1:
            out.append(("WARNING", s.table_id, f"trust rank {s.trust_rank} stands twice"))
        if s.entity_type != "PERSON":
            out.append(("WARNING", s.table_id, f"entity type {s.entity_type} is recorded only: sources are not kept apart by it"))
    for r in config.rules:
        if r.max_group_size is not None and r.max_group_size < 2:
            out.append(("WARNING", r.identifier_type, "a cap below 2 matches nothing"))
    for s in config.active_sources():
        try:
            df = read(s)
        except Exception as e:  # noqa: BLE001  any failure to read is the finding
            out.append(("ERROR", s.table_id, f"cannot be read: {type(e).__name__}"))
            continue
        for name, expression in (("key", s.key), *s.identifiers, *s.attributes):
            try:
                df.select(F.expr(expression))
            except Exception:  # noqa: BLE001
                out.append(("WARNING", s.table_id, f"{name}: {expression} does not fit the table"))
        if not s.identifiers:
            out.append(("WARNING", s.table_id, "no identifiers"))
        for name, _ in s.identifiers:
            if name not in types:
                out.append(("WARNING", s.table_id, f"{name} has no active rule"))
        if not s.attributes and config.survivorship:
            out.append(("WARNING", s.table_id, "no attributes"))
    return spark.createDataFrame(out, "level string, source string, finding string")


def preflight(spark: SparkSession, config: Config, read: Callable[[Source], DataFrame]) -> list[str]:
    """Raise on an error; return the warnings."""
    rows = findings(spark, config, read).collect()
    errors = [f"{r.source}: {r.finding}" for r in rows if r.level == "ERROR"]
    if errors:
        raise ConfigError("; ".join(errors))
    return [f"{r.source}: {r.finding}" for r in rows]
