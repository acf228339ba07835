"""Versions of a ledger when writers meet, and a run through all its states."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from windrow.operators import ledger

SCHEMA = "run string, n long"


def put(spark, path, rows, **more):
    return ledger.put(spark.createDataFrame(rows, SCHEMA), path, ["run"], **more)


def held(spark, path):
    return sorted((tuple(r) for r in ledger.latest(spark, path, SCHEMA).collect()), key=str)


def test_old_versions_go_and_null_keys_are_replaced(spark, tmp_path):
    path = str(tmp_path / "l")
    assert [put(spark, path, [("a", k), (None, k)]) for k in range(5)] == [1, 2, 3, 4, 5]
    assert held(spark, path) == sorted([("a", 4), (None, 4)], key=str)
    assert sorted(n for n in os.listdir(path) if n[0] == "v") == ["v3", "v4", "v5"]
    put(spark, path, [("b", 1), ("b", 1)])
    assert held(spark, path) == sorted([("a", 4), ("b", 1), (None, 4)], key=str)


def test_a_claimed_version_is_lost_cleanly(spark, tmp_path):
    path = str(tmp_path / "l")
    put(spark, path, [("a", 1)])
    open(f"{path}/_claim-2", "w").close()  # another writer is at it
    with pytest.raises(ledger.LostUpdate):
        put(spark, path, [("a", 2)])
    assert held(spark, path) == [("a", 1)]
    time.sleep(1.1)
    assert put(spark, path, [("a", 3)], stale=1.0) == 3 and held(spark, path) == [("a", 3)]  # that writer never came back


def test_of_many_claims_one_is_made(spark, tmp_path):
    files, made = ledger._files(spark, str(tmp_path))[0], []
    for k in range(20):
        threads = [threading.Thread(target=lambda k=k: made.append((k, ledger._claimed(spark, files, f"{tmp_path}/c{k}")))) for _ in range(6)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert all(sum(m for j, m in made if j == k) == 1 for k in range(20)) and len(made) == 120


def test_a_failed_write_leaves_no_claim(spark, tmp_path):
    path = str(tmp_path / "l")
    put(spark, path, [("a", 1)])
    bad = spark.createDataFrame([("a", 1)], SCHEMA).withColumn("n", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        ledger.put(bad, path, ["run"])
    assert put(spark, path, [("a", 2)]) == 2 and held(spark, path) == [("a", 2)]


def test_two_writers_at_once(spark, tmp_path):
    path, told, other = str(tmp_path / "l"), [], []

    def write(name):
        try:
            put(spark, path, [(name, 1)])
            told.append(name)
        except ledger.LostUpdate:
            pass
        except Exception as error:
            other.append(error)

    threads = [threading.Thread(target=write, args=(f"w{k}",)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert told and not other and [r for r, _ in held(spark, path)] == sorted(told)  # whoever was told so is in it, and no one else


def test_all_states_are_reached(spark, tmp_path):
    root = str(tmp_path / "r")
    some, none, jobs = spark.range(3), spark.range(0), spark.range(4).withColumnRenamed("id", "job")
    broken, packed, fine = {2}, [], [False]
    seen = []

    def work(left):
        seen.append([r["state"] for r in ledger.run_states(spark, root).collect()])
        return left.withColumns({"ok": ~F.col("job").isin(*broken) if broken else F.lit(True), "err": F.lit("broken")})

    go = lambda run, **more: ledger.advance(run, root, "job", **({"segments": some, "triggers": some, "jobs": jobs, "work": work, "target": 4, "pack": lambda df: packed.append(df.count()), "sane": lambda df: fine[0]} | more))
    assert go("a", segments=none) == "no_segments" and go("a", triggers=none) == "no_triggers" and go("a", jobs=none.withColumnRenamed("id", "job")) == "no_valid_entries"
    assert go("b") == "partial" and seen[-1].count("running") == 1
    broken.clear()
    notes = []
    assert go("b", pack=lambda df: notes.append([r["state"] for r in ledger.run_states(spark, root).filter("run = 'b'").collect()])) == "sanity_failed"
    assert notes == [["ready_to_pack"]]
    fine[0] = True
    assert go("b") == "done" and not packed and len(seen) == 2  # packed once, worked on no more
    assert go("b", segments=none) == "done"
    states = {r["run"]: (r["state"], r["done"], r["target"]) for r in ledger.run_states(spark, root).collect()}
    assert states == {"a": ("no_valid_entries", 0, 4), "b": ("done", 4, 4)}
