"""A real database file, read in parts; streams that are killed and go on; progress for those who come late."""

import json
import random
import sqlite3
import threading
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomtext.scratch import materialise, passing
from loomtext.sources.database import SqliteTable, TableReader, database_table
from loomtext.streaming import resume
from loomtext.streaming.events import Event, progress_events


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "a file.db")
    r = random.Random(3)
    rows = [(k, r.choice(["fen", "mas", None, 'quo"te']), r.choice([None, 1.5, k / 3]), b"\x00x" if k % 2 else None) for k in range(1, 500) if k % 7]
    with sqlite3.connect(path) as db:
        db.execute('create table "my words" (id integer primary key, "latin word" text, share real, raw blob)')
        db.executemany('insert into "my words" values (?, ?, ?, ?)', rows)
        db.execute("create table odd (n int, t text, d decimal)")
        db.execute("insert into odd values ('x', 5, 7), (null, null, null)")
        db.execute("create table none (a text)")
        db.execute("create table paired (k text primary key, n int) without rowid")
        db.executemany("insert into paired values (?, ?)", [(f"k{k}", k) for k in range(20)])
        db.execute('create view seen as select id, "latin word" from "my words" where id < 20')
    return path, rows


def test_database(spark, database):
    path, rows = database
    table = database_table(spark, path, "my words", parts=5)
    assert [(f.name, f.dataType.simpleString()) for f in table.schema] == [("id", "bigint"), ("latin word", "string"), ("share", "double"), ("raw", "binary")]
    assert table.rdd.getNumPartitions() == 5 and min(table.rdd.glom().map(len).collect()) > 50
    assert sorted((r[0], r[1], r[2], r[3] and bytes(r[3])) for r in table.collect()) == sorted(rows)
    for wanted, keep in [
        ([("id", ">", 100), ("id", "<=", 300)], lambda r: 100 < r[0] <= 300), ([("latin word", "=", 'quo"te')], lambda r: r[1] == 'quo"te'), ([("share", "is null", None)], lambda r: r[2] is None),
        ([("latin word", "in", ["fen", "x"]), ("share", ">=", 1.5)], lambda r: r[1] == "fen" and r[2] is not None and r[2] >= 1.5), ([], lambda r: True),
    ]:
        met = database_table(spark, path, "my words", wanted)
        assert sorted(r.id for r in met.collect()) == sorted(r[0] for r in rows if keep(r)), wanted
        assert sorted(r.id for r in met.where("id % 2 = 1").collect()) == sorted(r[0] for r in rows if keep(r) and r[0] % 2) and met.count() == sum(map(keep, rows))
    assert [tuple(r) for r in database_table(spark, path, "odd").orderBy(F.desc_nulls_last("n")).collect()] == [(0, "5", "7"), (None, None, None)]
    assert database_table(spark, path, "odd", [("n", "=", 0)]).count() == 1 and database_table(spark, path, "none").count() == 0
    assert database_table(spark, path, "paired").agg(F.sum("n")).first()[0] == 190 and database_table(spark, path, "seen").count() == sum(r[0] < 20 for r in rows)
    with pytest.raises(Exception, match="no table"):
        database_table(spark, path, "other").collect()


def test_conditions_reach_the_database(database):
    path, _ = database
    options = {"path": path, "dbtable": "my words", "conditions": json.dumps([("id", "<", 30), ("latin word", "in", ["fen"])])}
    reader = TableReader(options, SqliteTable(options).schema())
    read = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[1] for r in read} == {"fen"} and max(r[0] for r in read) < 30
    for bad in (("nothing", "=", 1), ("id", "; drop", 1)):
        with pytest.raises(ValueError, match="not a condition"):
            TableReader(options | {"conditions": json.dumps([bad])}, SqliteTable(options).schema())


def _file(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number}.json").write_text("\n".join(json.dumps({"id": k, "text": t}) for k, t in rows))


def test_append_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    """A batch that dies before, while or after it writes comes again and adds nothing twice."""
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    rows = lambda: spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).json(str(source))
    for n in range(4):
        _file(source, n, [(k, f"t{k}-{n}") for k in range(10 * n, 10 * n + 15)] + [(None, "no key")])
    put, died = resume._put, []

    def dying(batch, number, *more):
        if number == 1 and "before" not in died:
            died.append("before")
            raise RuntimeError("killed before the batch")
        put(batch, number, *more)
        if number == 2 and "after" not in died:
            died.append("after")
            raise RuntimeError("killed after the batch")

    monkeypatch.setattr(resume, "_put", dying)
    assert resume.appended(spark, path, "id long, text string").count() == 0
    for _ in range(5):
        try:
            resume.append_stream(rows(), path, "id", checkpoint).awaitTermination()
            break
        except StreamingQueryException:
            continue
    assert died == ["before", "after"]
    got = resume.appended(spark, path)
    assert sorted(r.id for r in got.where("id is not null").collect()) == list(range(45)) and got.where("id is null").count() == 1
    _file(source, 9, [(44, "again"), (45, "new"), (45, "anew")])
    resume.append_stream(rows(), path, "id", checkpoint).awaitTermination()
    resume.append_stream(rows(), path, "id", checkpoint).awaitTermination()
    assert sorted((r.id, r.text) for r in resume.appended(spark, path).where("id > 43").collect()) == [(44, "t44-3"), (45, "anew")]
    with pytest.raises(ValueError):
        resume.append_stream(rows(), path, "other", checkpoint)


def test_scratch_tables_of_threads_are_apart(spark):
    """A step that ends in one thread leaves the tables of another's alone, and of its own those that it keeps."""
    opened, ended, left = threading.Event(), threading.Event(), []

    def other():
        with passing() as kept:
            mine = materialise(spark.range(5), "mine")
            kept.append(mine)
            gone = materialise(spark.range(3), "gone")
            opened.set()
            ended.wait(60)
            left.append((mine.count(), gone.count()))
        left.append((mine, gone))

    thread = threading.Thread(target=other)
    thread.start()
    assert opened.wait(60)
    with passing():
        with passing() as inner:
            held = materialise(spark.range(7), "held")
            inner.append(held)
        assert held.count() == 7
    ended.set()
    thread.join()
    assert left[0] == (5, 3) and left[1][0].count() == 5
    for table in (held, left[1][1]):
        with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST|FileNotFound"):
            table.collect()


def _until(told):
    for _ in range(200):
        if told():
            return True
        time.sleep(0.1)
    return False


def test_progress_is_told_to_who_comes_late(spark, tmp_path):
    _file(tmp_path / "in", 0, [(k, "x") for k in range(7)])
    stream = spark.readStream.schema("id long, text string").json(str(tmp_path / "in"))
    early, late, gone = [], [], []
    with progress_events(spark) as events:
        leave = events.subscribe(gone.append)
        leave()
        leave()
        events.subscribe(lambda e: 1 / 0 if e else None)  # its failing is its own matter
        events.subscribe(early.append)
        query = resume.append_stream(stream, str(tmp_path / "out"), "id", str(tmp_path / "cp"))
        query.awaitTermination()
        assert _until(lambda: early[-1] and early[-1].what == "ended")
        events.subscribe(late.append)
        assert late == [early[-1]] and late[0].run == str(query.runId)
        _file(tmp_path / "in", 1, [(9, "y")])
        resume.append_stream(stream, str(tmp_path / "out"), "id", str(tmp_path / "cp")).awaitTermination()
        assert _until(lambda: len(late) > 1 and late[-1].what == "ended")
    assert early[0] is None and gone == [None] and [e.what for e in early[1:]][0] == "started"
    assert late[1:] == early[-len(late) + 1 :]
    told = [e for e in early[1:] if e.what == "progress" and e.rows]
    assert [(e.batch, e.rows) for e in told] == [(0, 7), (1, 1)] and all(isinstance(e, Event) and e.seconds > 0 for e in told)


def test_a_failed_query_says_why(spark, tmp_path):
    _file(tmp_path / "in", 0, [(1, "x")])
    stream = spark.readStream.schema("id long, text string").json(str(tmp_path / "in")).withColumn("text", F.raise_error(F.lit("no such word")).cast("string"))
    told = []
    with progress_events(spark) as events:
        events.subscribe(told.append)
        with pytest.raises(StreamingQueryException):
            resume.append_stream(stream, str(tmp_path / "out"), "id", str(tmp_path / "cp")).awaitTermination()
        assert _until(lambda: told[-1] and told[-1].what == "failed") and "no such word" in told[-1].error
