"""Fan-out, paged reads, the keyed cache and resumable batches, with parts that fail."""

import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from loomline.sources import cache, fanout, pages
from loomline.streaming import resume

PAIR = StructType().add("key", StringType()).add("value", LongType())


def files_of(path):
    return {os.path.join(os.path.basename(d), n): open(os.path.join(d, n)).read() for d, _, names in os.walk(path) for n in names}


def test_one_file_each(spark, tmp_path):
    rows = [("a/x.txt", i, f"line {i}", None) for i in reversed(range(500))] + [("b", 0, "good", None), ("b", 1, None, "row 1 is bad"), ("b", 2, "more", None), ("_c..", 0, "é", None), ("", 0, None, None), (None, 0, "nobody", None)]
    path = str(tmp_path / "out")
    fanout.write_each(spark.createDataFrame(rows, fanout.ROWS).repartition(6), path)
    whole = "".join(f"line {i}\n" for i in range(500))
    assert files_of(path) == {"files/a%2Fx.txt": whole, "files/%5Fc..": "é\n", "files/%": "", "quarantine/b": "row 1 is bad"}
    fanout.write_each(spark.createDataFrame([("b", 0, "mended", None)], fanout.ROWS), path)
    assert files_of(path)["files/b"] == "mended\n" and files_of(path)["files/a%2Fx.txt"] == whole
    assert sorted(r.file for r in fanout.read_each(spark, path).collect()) == ["_c..", "a/x.txt", "b", "b"]
    fanout.write_each(spark.createDataFrame([], fanout.ROWS), str(tmp_path / "none"))
    assert files_of(tmp_path / "none") == {}


def test_conversion_fails_alone(spark, tmp_path):
    def convert(rows):
        for row in rows:
            yield str(10 // row.value)

    rows = spark.createDataFrame([(f, i, v) for f, vs in (("one", [1, 2, 5]), ("bad", [1, 0, 2]), ("two", [10])) for i, v in enumerate(vs)], "name string, at long, value long")
    fanout.write_each(fanout.converted(rows, "name", ["at"], convert), str(tmp_path))
    assert files_of(tmp_path) == {"files/one": "10\n5\n2\n", "files/two": "1\n", "quarantine/bad": "ZeroDivisionError: integer division or modulo by zero"}


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from loomline.sources import fanout
path, times = sys.argv[1], int(sys.argv[2])
spark = SparkSession.builder.master("local[2,2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def convert(rows):
    for n, row in enumerate(rows):
        if row.name == "f3" and n == 20 and len([x for x in os.listdir(path) if x.startswith("died")]) < times:
            open(f"{path}/died{os.getpid()}", "w").close()
            os._exit(9)  # the worker is lost in the middle of a file
        yield row.value

rows = spark.range(400).selectExpr("concat('f', id % 8) as name", "id", "concat('v', id) as value")
fanout.write_each(fanout.converted(rows, "name", ["id"], convert), path + "/out")
"""


@pytest.mark.parametrize("times", [1, 9])
def test_a_killed_task(tmp_path, times):
    """A task that dies runs again and leaves nothing twice; if it always dies, nothing is left at all."""
    run = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path), str(times)], env=os.environ | {"PYTHONPATH": os.getcwd()}, capture_output=True, timeout=300)
    want = {f"files/f{n}": "".join(f"v{i}\n" for i in range(400) if i % 8 == n) for n in range(8)} if times == 1 else {}
    assert (run.returncode == 0) == (times == 1)
    assert files_of(tmp_path / "out") == want


def asked(offset, limit, log, total="yes", bad="", lasting=""):
    """A source of 95 items; a page named in bad fails once, one in lasting always."""
    with open(log, "a") as out:
        out.write(f"{offset} {limit}\n")
    before = open(log).read().split("\n").count(f"{offset} {limit}")
    if str(offset) in lasting.split(".") or (str(offset) in bad.split(".") and before < 2):
        raise OSError(f"no page {offset}")
    items = [{"key": f"k{i}", "value": i} for i in range(offset, min(offset + limit, 95))]
    return {"items": items, "total": 95 if total == "yes" else None, "next": offset + limit if offset + limit < 95 else None}


@pytest.mark.parametrize("total", ["yes", "no"])
def test_pages(spark, tmp_path, total):
    log = str(tmp_path / "log")
    got = pages.read_pages(spark, "tests.test_sources:asked", PAIR, limit=10, log=log, total=total, bad="30.90" if total == "yes" else "")
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"k{i}", i) for i in range(95))
    asks = [x for x in open(log).read().split("\n") if x.endswith(" 10")]
    assert sorted(asks) == sorted([f"{i} 10" for i in range(0, 95, 10)] + (["30 10", "90 10"] if total == "yes" else []))  # others once


def test_pages_that_never_come(spark, tmp_path):
    with pytest.raises(RuntimeError, match=r"\[20\].*no page 20"):
        pages.read_pages(spark, "tests.test_sources:asked", PAIR, limit=10, tries=2, pause=0.01, log=str(tmp_path / "log"), lasting="20")


def test_table_pages(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).withColumn("x", F.col("id") * 2).repartition(3).write.option("parquet.block.size", 1000).parquet(path)
    schema = spark.read.parquet(path).schema
    assert sorted(r.id for r in pages.read_pages(spark, "loomline.sources.pages:parquet_page", schema, limit=77, table=path).collect()) == list(range(1000))


def test_keyed_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    store = cache.KeyedCache(spark, path, PAIR, ["key"])
    held = lambda: {r.key: r.value for r in store.read().collect()}
    rows = lambda xs: spark.createDataFrame(xs, PAIR)
    assert held() == {}
    assert store.upsert(rows([("a", 1), ("b", 2), ("b", 5), (None, 7)])) == 1
    assert held() == {"a": 1, "b": 5}
    assert store.upsert(rows([("b", 3), ("c", 4)])) == 2
    assert held() == {"a": 1, "b": 3, "c": 4}
    store.vacuum(1)
    assert held() == {"a": 1, "b": 3, "c": 4} and len(store.store.names()) == 2
    version = next(n for n in os.listdir(path) if n.startswith("version"))
    part = next(n for n in os.listdir(f"{path}/{version}") if n.startswith("part"))
    with open(f"{path}/{version}/{part}", "wb") as out:
        out.write(b"no table")
    spark.catalog.clearCache()
    assert held() == {}
    assert store.upsert(rows([("d", 9)])) == 3 and held() == {"d": 9}
    with open(f"{path}/pointer-{9:012d}", "w") as out:
        out.write("../elsewhere")
    assert held() == {}


def test_cache_readers_and_writers(spark, tmp_path):
    """Readers see whole versions, and no writer's rows are lost."""
    path = str(tmp_path / "cache")
    store = cache.KeyedCache(spark, path, PAIR, ["key"])
    store.upsert(spark.createDataFrame([("x", 0), ("y", 0)], PAIR))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append({r.key: r.value for r in store.read().collect()})

    def write(name):
        own = cache.KeyedCache(spark, path, PAIR, ["key"])
        for i in range(1, 4):
            own.upsert(spark.createDataFrame([("x", i), ("y", i), (f"{name}{i}", i)], PAIR))

    threads = [threading.Thread(target=write, args=(n,)) for n in "pq"]
    reader = threading.Thread(target=read)
    for x in [reader, *threads]:
        x.start()
    for x in threads:
        x.join()
    stop.set()
    reader.join()
    last = {r.key: r.value for r in store.read().collect()}
    assert set(last) == {"x", "y", "p1", "p2", "p3", "q1", "q2", "q3"}
    assert seen and all(s["x"] == s["y"] for s in seen)


@pytest.mark.parametrize("fails", ["before", "between"])
def test_resumable(spark, tmp_path, monkeypatch, fails):
    path, state = str(tmp_path), {"left": 1}
    schema = StructType().add("code", LongType()).add("at", LongType())

    def process(rows):
        if fails == "before" and state["left"] and rows.where("code = 25").count():
            state["left"] = 0
            raise ValueError("stopped")
        return rows.select("code", (F.col("code") * 10).alias("ten"))

    job = resume.Resumable(spark, f"{path}/job", schema, ["code"], process)
    if fails == "between":  # after the output, before the ledger
        done = job.done

        def broken(before=None):
            if before == 1 and state["left"] and os.path.exists(f"{path}/job/out/batch=1"):
                raise ValueError("stopped")
            if before == 1 and state["left"]:
                state["left"] = 0
                job.process(spark.createDataFrame([(20, 0)], schema)).write.mode("overwrite").parquet(f"{path}/job/out/batch=1")
                raise ValueError("stopped")
            return done(before)

        monkeypatch.setattr(job, "done", broken)
    for n in range(3):
        spark.range(n * 20, n * 20 + 30).select(F.col("id").alias("code"), F.lit(n).cast("long").alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    with pytest.raises(Exception, match="stopped"):
        job.run(f"{path}/in")
    job.run(f"{path}/in")
    assert sorted((r.code, r.ten) for r in job.output().collect()) == [(i, i * 10) for i in range(70)]
    assert sorted(r.code for r in job.done().collect()) == list(range(70))
    entry = f"{path}/job/ledger/batch=0"
    for name in os.listdir(entry):
        if name.startswith("part"):
            open(f"{entry}/{name}", "w").close()
            if os.path.exists(f"{entry}/.{name}.crc"):
                os.remove(f"{entry}/.{name}.crc")
    assert sorted(r.code for r in job.done().collect()) == list(range(30, 70))  # what is corrupt counts as nothing
    job.run(f"{path}/in")
    assert job.output().count() == 70


def test_saved_codes(spark, tmp_path):
    path, schema = str(tmp_path / "codes"), StructType().add("code", StringType())
    assert resume.load_codes(spark, path, schema).count() == 0
    for codes in (["a", "b", "b"], ["c"], []):
        resume.save_codes(spark.createDataFrame([(c,) for c in codes], schema), path)
        assert sorted(r.code for r in resume.load_codes(spark, path, schema).collect()) == sorted(set(codes))
