"""Runs that resume: what is done, what failed, and a manifest that is drawn once."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .joins import pending
from .ranking import same

#: States of a run, fixed values.
STATES = ("running", "partial", "ready_to_pack", "done", "no_segments", "no_triggers", "no_valid_entries", "sanity_failed")


def state(*, segments: int = 1, triggers: int = 1, valid: int = 1, target: int = 0, done: int = 0, packed: bool = False, sane: bool = True) -> str:
    """What a run is at, from what it has: the first thing that is lacking, else how far it is."""
    if not segments:
        return "no_segments"
    if not triggers:
        return "no_triggers"
    if not valid:
        return "no_valid_entries"
    if not done:
        return "running"
    if done < target:
        return "partial"
    if not packed:
        return "ready_to_pack"
    return "done" if sane else "sanity_failed"


class LostUpdate(RuntimeError):
    """Another writer was at the same version; nothing was written. Read again and try again."""


def put(rows: DataFrame, path: str, keys: list[str], *, keep: int = 2, stale: float = 3600.0) -> int:
    """Write rows over those of the table at path with the same keys, nulls alike, as a version beside it, and return its number; of rows that share keys one stays.

    Only the writer that makes the version's claim file first goes on, the others get LostUpdate; so a version holds what the one before it
    held, and readers see whole ones. A claim that is older than stale seconds and led to no version is passed over. Of the versions before,
    the last keep stay for those who read them still.
    """
    spark = rows.sparkSession
    files, there = _files(spark, path)
    numbers = _versions(spark, path)
    number = (numbers[-1] if numbers else 0) + 1
    while not _claimed(spark, files, f"{path}/_claim-{number}"):
        if number in _versions(spark, path) or not _is_stale(spark, files, f"{path}/_claim-{number}", stale):
            raise LostUpdate(f"version {number} of {path} is another writer's")
        number += 1  # its writer is gone
    try:
        if _versions(spark, path) != numbers:
            raise LostUpdate(f"{path} has another version since it was read")
        before = latest(spark, path, rows.schema.simpleString().removeprefix("struct<").removesuffix(">"))
        new = rows.dropDuplicates(keys)
        kept = same(before, new.select(*keys), keys, "left_anti").select(*rows.columns)
        kept.unionByName(new).write.mode("errorifexists").parquet(f"{path}/v{number}")
        if _versions(spark, path)[-1] != number:
            raise LostUpdate(f"version {number} of {path} took so long that others passed it over")
    except BaseException:
        files.delete(_path(spark, f"{path}/v{number}"), True)  # only this writer writes there; nothing that is half written stays, nor its claim
        files.delete(_path(spark, f"{path}/_claim-{number}"), False)
        raise
    for old in _versions(spark, path)[: -1 - keep]:
        files.delete(_path(spark, f"{path}/v{old}"), True)
        files.delete(_path(spark, f"{path}/_claim-{old}"), False)
    return number


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """(file system, whether the path is there)."""
    files = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.exists(_path(spark, path))


def _claimed(spark: SparkSession, files, claim: str) -> bool:
    """Whether this writer has made the claim: of several, one makes it. Local folders need the system's own exclusive call, as Hadoop's looks first and makes then."""
    files.mkdirs(_path(spark, claim).getParent())
    if files.getUri().getScheme() != "file":
        return files.createNewFile(_path(spark, claim))
    try:
        os.close(os.open(_path(spark, claim).toUri().getPath(), os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        return False
    return True


def _is_stale(spark: SparkSession, files, claim: str, stale: float) -> bool:
    where = _path(spark, claim)
    return files.exists(where) and time.time() - files.getFileStatus(where).getModificationTime() / 1000 > stale


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that put() last wrote at path, or none of its rows."""
    numbers = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{numbers[-1]}") if numbers else spark.createDataFrame([], schema.replace(":", " "))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written whole."""
    files, there = _files(spark, path)
    if not there:
        return []
    names = [s.getPath().getName() for s in files.listStatus(_path(spark, path)) if files.exists(_path(spark, f"{path}/{s.getPath().getName()}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def read_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or none of its rows where it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str, schema: str, draw: Callable[[], DataFrame]) -> DataFrame:
    """The persisted sample; drawn and written at the first call, read ever after."""
    draw().write.mode("ignore").parquet(path)  # writes, and draws, only where there is none yet; an empty sample is a sample
    return spark.read.schema(schema).parquet(path)


def run_pending(jobs: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], root: str) -> str:
    """Do the jobs that are not done, append results and errors under root, and return the state.

    work returns the jobs' rows with ok boolean and err string. Results are committed before
    they count as done: done is what results holds, so neither can be ahead of the other.
    """
    spark = jobs.sparkSession
    key_type = dict(jobs.dtypes)[key]
    done = read_or(spark, f"{root}/results", f"`{key}` {key_type}")
    left = pending(jobs, done, [key])
    if not left.isEmpty():
        worked = work(left).cache()
        try:
            worked.filter("ok").drop("ok", "err").write.mode("append").parquet(f"{root}/results")
            failed = worked.filter("not ok").select(F.current_timestamp().alias("at"), key, "err")
            failed.write.mode("append").parquet(f"{root}/errors")
        finally:
            worked.unpersist()
    still = pending(jobs, read_or(spark, f"{root}/results", f"`{key}` {key_type}"), [key])
    return "partial" if not still.isEmpty() else "done"


RUNS = "run string, state string, done long, target long, at timestamp"


def run_states(spark: SparkSession, root: str) -> DataFrame:
    """The last state of each run, as advance() noted it."""
    return latest(spark, f"{root}/runs", RUNS)


def advance(
    run: str, root: str, key: str, *, segments: DataFrame, triggers: DataFrame, jobs: DataFrame, work: Callable[[DataFrame], DataFrame], target: int, pack: Callable[[DataFrame], None], sane: Callable[[DataFrame], bool]
) -> str:
    """Take a run as far as it goes, note every state it passes under root, and return the last one.

    Without segments, triggers or jobs it stops there. Jobs that are not done are worked on as in run_pending(); below the
    target it stays partial, and a later call goes on. Then its results are packed, once, and checked: they are done, or their
    check has failed. A run that is done is left alone, one that failed its check is checked again. Several runs may advance at once: they note their states in turn.
    """
    spark = jobs.sparkSession
    note = lambda said, done=0: _note(spark, root, run, said, done, target)
    last = run_states(spark, root).filter(F.col("run") == run).first()
    if last is not None and last["state"] == "done":
        return "done"
    for rows, name in ((segments, "segments"), (triggers, "triggers"), (jobs, "valid")):
        if rows.isEmpty():
            return note(state(**{name: 0}))
    folder = f"{root}/{run}"
    kind = dict(jobs.dtypes)[key]
    count = lambda: read_or(spark, f"{folder}/results", f"`{key}` {kind}").select(key).distinct().count()
    packed = _files(spark, f"{folder}/_packed")[1]
    if not packed:
        note("running", count())
        run_pending(jobs, key, work, folder)
    done = count()
    said = state(target=target, done=max(done, 1) if packed else done, packed=packed)
    if said == "running":  # nothing came of the work, so it is not over
        return note("partial", done)
    if said == "ready_to_pack":
        note(said, done)
        pack(spark.read.parquet(f"{folder}/results"))
        _files(spark, folder)[0].createNewFile(_path(spark, f"{folder}/_packed"))
        packed = True
    if packed:
        said = state(target=target, done=max(done, target), packed=True, sane=sane(spark.read.parquet(f"{folder}/results")))
    return note(said, done)


def _note(spark: SparkSession, root: str, run: str, said: str, done: int, target: int, tries: int = 8) -> str:
    """Write a run's state over its last one; where other runs write theirs, in turn."""
    row = spark.range(1).select(F.lit(run).alias("run"), F.lit(said).alias("state"), F.lit(done).cast("long").alias("done"), F.lit(target).cast("long").alias("target"), F.current_timestamp().alias("at"))
    for left in range(tries - 1, -1, -1):
        try:
            put(row, f"{root}/runs", ["run"])
            break
        except LostUpdate:
            if not left:
                raise
            time.sleep(0.2 * (tries - left))
    return said
