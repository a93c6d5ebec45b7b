"""Stored tables: the tables of a run, the state that lives on between runs, and the folder that a cluster shares.

A run's rows lie in the partition of its ``run_id``, in versions of which the newest whole one counts; a run written again replaces its own rows and no others.
Plain Parquet has no transaction over several tables: a run that failed half way is completed by writing it again.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a run and of the state.
RUN_TABLES = ("filings", "news_items", "signal_candidates", "detected_signals", "compound_events", "analyst_briefs", "market_outcomes", "replay_runs", "scoring_history")
STATE_TABLES = ("feedback", "outcomes", "profiles", "graph_nodes", "graph_edges", "watchlist", "alerts", "audit")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares; a local one only where all runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        top = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def _versions(spark: SparkSession, folder: str, table: str) -> dict[str, int]:
    """The newest stored version of each run of a table."""
    try:
        files = spark.read.parquet(f"{folder}/{table}").inputFiles()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return {}
    out: dict[str, int] = {}
    for run_id, version in re.findall(r"/run_id=([^/]+)/version=(\d+)/", "\n".join(files)):
        out[unquote(run_id)] = max(out.get(unquote(run_id), 0), int(version))
    return out


def write_partition(rows: DataFrame, folder: str, table: str, run_id: str) -> None:
    """Put rows into the run's partition of a table in place of what it held; an empty result leaves an empty partition.

    The rows are written as a new version beside the last one, and readers take the newest version that was written to its end: a rewrite that fails leaves the
    run as it was. Older versions are left for readers that have begun.
    """
    last = _versions(rows.sparkSession, folder, table).get(run_id, 0)
    rows.drop("run_id", "version").write.mode("overwrite").parquet(f"{folder}/{table}/run_id={run_id}/version={last + 1}")


def store_run(tables: Mapping[str, DataFrame], folder: str, run_id: str) -> None:
    """Write the tables of one run; writing it again gives the same tables."""
    unknown = set(tables) - set(RUN_TABLES)
    if unknown:
        raise ValueError(f"no tables of a run: {sorted(unknown)}")
    for name, rows in tables.items():
        write_partition(rows, folder, name, run_id)


def save_state(name: str, rows: DataFrame, folder: str, run_id: str) -> None:
    """Append what a run adds to a state table; the same run appends once."""
    if name not in STATE_TABLES:
        raise ValueError(f"no state table: {name}")
    write_partition(rows, folder, name, run_id)


def read_table(spark: SparkSession, folder: str, name: str, run_id: str | None = None) -> DataFrame:
    """A stored table with its ``run_id``, of one run or of all."""
    top = f"{folder}/{name}"
    places = [f"{top}/run_id={run}/version={version}" for run, version in _versions(spark, folder, name).items()]
    rows = spark.read.option("basePath", top).parquet(*places).drop("version").withColumn("run_id", F.col("run_id").cast("string"))
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def _unreadable(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """Those of some Parquet files that cannot be opened: the footers of all are read at once, and those of the halves where that fails."""
    try:
        if files:
            spark.read.options(mergeSchema="true", ignoreCorruptFiles="false").parquet(*[re.sub(r"([\\\[\]{}*?])", r"\\\1", f) for f in files])
        return []
    except Exception:  # whatever keeps a file from being opened; files that are whole but do not go together end in the halves
        half = len(files) // 2
        return [*_unreadable(spark, files[:half]), *_unreadable(spark, files[half:])] if half else list(files)


def landed(spark: SparkSession, path: str, kind: str, schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Rows of landed files (json or csv lines, or parquet), and the errors (error, detail) of what could not be read; neither stops the other.

    A record that does not parse, or does not fit the schema, is an error of its own with its text. Of Parquet files those that cannot be opened are
    errors with their path; a file that breaks off later gives the rows before. A whole file of no rows, as Spark writes for an empty partition, is no error:
    the files that gave no row are found when the table is opened, and their names alone are tried again. Spark's readers pass over files of no bytes.
    """
    if kind == "parquet":
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
        read = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
        silent = spark.read.format("binaryFile").load(path).select("path").join(read, "path", "left_anti")  # the contents are not read
        bad = _unreadable(spark, [r["path"] for r in silent.collect()])
        return rows, spark.createDataFrame([("no rows could be read", re.sub("^file:/+", "/", f)) for f in bad], "error string, detail string")
    parse = {"json": F.from_json, "csv": F.from_csv}[kind]
    own = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"} | options
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", parse("value", f"{schema}, _corrupt string", own).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    return lines.filter(~bad).select("r.*").drop("_corrupt"), lines.filter(bad).select(F.lit("corrupt row").alias("error"), F.col("value").alias("detail"))


def gather(spark: SparkSession, readers: Mapping[str, Callable[[], DataFrame | tuple[DataFrame, DataFrame]]], columns: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of several sources with the columns (name: type), and the errors (source, error, detail) of what could not be read.

    A source that fails when it is opened gives no rows and one error. A source read by ``landed`` also gives an error for each corrupt row and file,
    which are found while the rows are read. The others are not touched by either.
    """
    schema = ", ".join(f"{n} {t}" for n, t in columns.items())
    rows = spark.createDataFrame([], f"origin string, {schema}")
    failed: list[tuple[str, str, str]] = []
    broken: DataFrame | None = None
    for name, read in readers.items():
        try:
            found = read()
            found, errors = found if isinstance(found, tuple) else (found, None)
            found = found.select(F.lit(name).alias("origin"), *[F.col(n).cast(t).alias(n) for n, t in columns.items()])
        except Exception as e:  # any failure of one source must leave the others alone
            failed.append((name, type(e).__name__, str(e).partition("\n")[0]))
            continue
        rows = rows.unionByName(found)
        if errors is not None:
            errors = errors.select(F.lit(name).alias("source"), "error", "detail")
            broken = errors if broken is None else broken.unionByName(errors)
    out = spark.createDataFrame(failed, "source string, error string, detail string")
    return rows, out if broken is None else out.unionByName(broken)
