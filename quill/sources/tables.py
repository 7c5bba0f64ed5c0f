"""Stored tables: schemas, appends and replacements by commits, migrations, health."""

from __future__ import annotations

import hashlib
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.operators import store
from quill.sources import commits
from quill.sources.shared import checkpoint

SCHEMAS = {
    "papers": "id string, title string, authors array<string>, abstract string, categories array<string>, published_at date, pdf_sha256 string, ingested_at timestamp",
    "chunks": (
        "chunk_id long, paper_id string, ordinal long, section_path string, content string, embed_input string, token_count long, page_start int, page_end int, char_start long, char_end long, "
        "content_sha256 string, embed_input_sha256 string, chunk_config string, chunk_config_sha256 string"
    ),
    "embeddings": "chunk_id long, model string, dim int, vec array<float>, chunk_config_sha256 string",
    "query_logs": "created_at timestamp, question string, config string, retrieved_ids array<long>, stage_timings string, tokens int, cost decimal(10,6), refused boolean",
}
#: How tables are laid out: filters by these columns prune.
PARTITIONS = {"chunks": ["chunk_config_sha256"], "embeddings": ["model", "chunk_config_sha256"]}
#: Models and the dimension of their vectors.
MODELS = {"BAAI/bge-small-en-v1.5": 384, "BAAI/bge-base-en-v1.5": 768}


def dimension_of(model: str) -> int:
    if model not in MODELS:
        raise KeyError(f"unknown model {model!r}; known are {', '.join(sorted(MODELS))}")
    return MODELS[model]


def create(spark: SparkSession, database: str = "default") -> None:
    """The tables that are not there yet."""
    for name, schema in SCHEMAS.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            empty = spark.createDataFrame([], schema)
            empty.write.partitionBy(*PARTITIONS.get(name, [])).saveAsTable(f"{database}.{name}")


def table_for(model: str) -> str:
    """The name under which a model's vectors are known: by their dimension. All are in one table, parted by model."""
    return f"embeddings_{dimension_of(model)}"


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path of any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder; 0 if it isn't there."""
    files, where = _files(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


def append_batch(df: DataFrame, path: str, name: str) -> bool:
    """Append df to the Parquet table at path as its folder batch=name, whole or not at all; False if that batch is there already.

    Rows are written beside the table (readers pass over names with an underscore) and
    moved by one rename.
    """
    spark = df.sparkSession
    files, target = _files(spark, f"{path}/batch={name}")
    if files.exists(target):
        return False
    _, staged = _files(spark, f"{path}/_staged-{uuid.uuid4().hex}")
    try:
        df.write.parquet(staged.toString())
        return bool(files.rename(staged, target))
    finally:
        files.delete(staged, True)


def log_of(spark: SparkSession, table: str) -> commits.Log:
    """The log of commits of a table of the catalog, in its folder."""
    location = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first().data_type
    return commits.Log(spark, location)


def version(spark: SparkSession, table: str) -> int:
    return log_of(spark, table).adopt().version


def read(spark: SparkSession, table: str, at: int | None = None) -> DataFrame:
    """The table's rows as its last commit left them, whatever writers do meanwhile."""
    log = log_of(spark, table)
    last = log.adopt()
    return log.read(last if at is None else log.state(at), spark.read.table(table).schema)


def _parts(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def refresh(spark: SparkSession, table: str) -> None:
    """Let the catalog see what commits have brought."""
    log_of(spark, table).settle()
    if _parts(spark, table):
        spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def append_new(new: DataFrame, table: str, key: tuple[str, ...], order: tuple = ()) -> int:
    """Append rows whose key the table has not, in one commit; how many. A second call appends none; if another writer's commit comes between, its keys are looked at too."""
    spark, log = new.sparkSession, log_of(new.sparkSession, table)
    schema, parts = spark.read.table(table).schema, _parts(spark, table)
    count = 0

    def make(state: commits.State) -> tuple[str | None, list[str]]:
        nonlocal count
        rows = checkpoint(store.insert_ignore(log.read(state, schema), new, key, order).select(schema.names))
        count = rows.count()
        return log.stage(rows, partitions=parts) if count else None, []

    commits.update(log, make)
    refresh(spark, table)
    return count


def replace(df: DataFrame, table: str, seen: int | None = None) -> None:
    """Put df, which may read the table, in the table's place, in one commit. seen: the version that df was made from (now's, unless given); commits.Conflict if there is a later one."""
    spark, log = df.sparkSession, log_of(df.sparkSession, table)
    state = log.adopt()
    if seen is not None and seen != state.version:
        raise commits.Conflict(f"{table} is at version {state.version}, not {seen}")
    staged = log.stage(df.select(spark.read.table(table).columns), partitions=_parts(spark, table))
    log.commit(state, staged, list(state.files))
    refresh(spark, table)


def log_query(spark: SparkSession, table: str, question: str, config: str, ids: list[int], timings: str, refused: bool) -> None:
    row = spark.createDataFrame([(question, config, ids, timings, refused)], "question string, config string, retrieved_ids array<long>, stage_timings string, refused boolean")
    full = row.withColumns({"created_at": F.current_timestamp(), "tokens": F.lit(None).cast("int"), "cost": F.lit(None).cast("decimal(10,6)")})
    log = log_of(spark, table)
    log.commit(log.adopt(), log.stage(full.select(spark.read.table(table).columns)), rebase=True)
    spark.catalog.refreshTable(table)


class MigrationError(Exception):
    pass


def discover(folder: str) -> list[tuple[int, str, str, str]]:
    """(version, name, checksum, sql) of NNN_name.sql files by number."""
    path = Path(folder)
    if not path.is_dir():
        raise MigrationError(f"no such folder: {folder}")
    out = []
    for file in sorted(path.glob("*.sql")):
        m = re.fullmatch(r"(\d{3})_([a-z0-9_]+)\.sql", file.name)
        if not m:
            raise MigrationError(f"not NNN_name.sql: {file.name}")
        sql = file.read_text()
        out.append((int(m[1]), m[2], hashlib.sha256(sql.encode()).hexdigest(), sql))
    versions = [v for v, *_ in out]
    if double := {v for v in versions if versions.count(v) > 1}:
        raise MigrationError(f"versions twice: {sorted(double)}")
    return sorted(out)


def pending(found: list[tuple[int, str, str, str]], applied: dict[int, str]) -> list[tuple[int, str, str, str]]:
    """Migrations to apply. One that changed after it was applied, or that is new below the newest applied, is an error."""
    for version, name, checksum, _ in found:
        if version in applied and applied[version] != checksum:
            raise MigrationError(f"{version:03d}_{name} has changed since it was applied")
    rest = [m for m in found if m[0] not in applied]
    if rest and applied and rest[0][0] < max(applied):
        raise MigrationError(f"{rest[0][0]:03d}_{rest[0][1]} comes before {max(applied):03d}, which is applied")
    return rest


def status(spark: SparkSession, folder: str, table: str = "schema_migrations") -> list[tuple[int, str, bool]]:
    """(version, name, whether applied) of all migrations; one that can't be applied is an error."""
    applied = {r.version: r.checksum for r in spark.read.table(table).select("version", "checksum").collect()} if spark.catalog.tableExists(table) else {}
    found = discover(folder)
    pending(found, applied)
    return [(v, name, v in applied) for v, name, *_ in found]


def migrate(spark: SparkSession, folder: str, table: str = "schema_migrations") -> list[int]:
    """Apply what is pending, each statement by Spark SQL; the versions applied."""
    if not spark.catalog.tableExists(table):
        spark.createDataFrame([], "version int, name string, checksum string, applied_at timestamp").write.saveAsTable(table)
    applied = {r.version: r.checksum for r in spark.read.table(table).select("version", "checksum").collect()}
    done = []
    for version, name, checksum, sql in pending(discover(folder), applied):
        for statement in filter(str.strip, re.sub(r"--[^\n]*", "", sql).split(";")):
            spark.sql(statement)
        row = spark.createDataFrame([(version, name, checksum)], "version int, name string, checksum string").withColumn("applied_at", F.current_timestamp())
        row.write.mode("append").insertInto(table)
        done.append(version)
    return done


def health(spark: SparkSession, tables: tuple[str, ...] = ("papers", "chunks", "embeddings")) -> dict:
    """What works; never raises."""
    try:
        return {"ok": True, "spark": spark.version, "tables": {t: spark.catalog.tableExists(t) for t in tables}}
    except Exception as error:  # noqa: BLE001
        return {"ok": False, "error": str(error)[:200]}
