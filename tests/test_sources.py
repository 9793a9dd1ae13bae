import pytest

from codeloom.__main__ import route, run
from codeloom.sources.files import read
from codeloom.streaming.watch import EMPTY, diff, fingerprint, fold, snapshot, status


def put(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_scan_and_decode(spark, tmp_path):
    put(tmp_path, {"a.SQL": "﻿begin null; end;".encode(), "sub/b.pkb": b"-- caf\xe9", "c.txt": b"x", ".git/d.sql": b"x", "target/e.sql": b"x"})
    got = {r["file"]: r["text"] for r in read(spark, [str(tmp_path)]).collect()}
    assert got == {"a.SQL": "begin null; end;", "sub/b.pkb": "-- café"}
    assert read(spark, [str(tmp_path), str(tmp_path / "c.txt")]).count() == 3
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        read(spark, [str(tmp_path / "none")])


def test_watch_and_status(spark, tmp_path):
    put(tmp_path, {"a.sql": b"1", "b.sql": b"2"})
    old = spark.createDataFrame(snapshot(spark, [str(tmp_path)]).collect(), "path string, size long, modified timestamp")
    before = fingerprint(old)
    (tmp_path / "a.sql").unlink()
    put(tmp_path, {"b.sql": b"22", "c.sql": b"3"})
    new = snapshot(spark, [str(tmp_path)])
    assert {(r["path"].rsplit("/")[-1], r["change"]) for r in diff(old, new).collect()} == {("a.sql", "REMOVED"), ("b.sql", "CHANGED"), ("c.sql", "ADDED")}
    assert fingerprint(new) != before
    s = EMPTY
    for e in [{"kind": "start", "total": 2}, {"kind": "stage", "text": "read"}, {"kind": "file", "done": 2}, {"kind": "file", "done": 1}, {"kind": "stage", "text": "write"}, *({"kind": "log", "text": str(i)} for i in range(500)), {"kind": "finished", "text": "VERIFIED"}, {"kind": "stage", "text": "late"}]:
        s = fold(s, e)
    assert s["state"] == "DONE" and s["done"] == 2 and len(s["log"]) == 400 and s["stages"] == [["read", "DONE"], ["write", "DONE"]]


def test_status_stream(spark, tmp_path):
    rows = [("b1", 1, "start", None, None, 3), ("b1", 2, "stage", "read", None, None), ("b1", 3, "file", None, 2, 3), ("b2", 1, "start", None, None, 1), ("b2", 2, "finished", None, None, None)]
    schema = "build string, seq long, kind string, text string, done long, total long"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    q = status(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("st").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["build"], r["state"], r["done"]) for r in spark.table("st").collect()} == {("b1", "RUNNING", 2), ("b2", "FAILED", 0)}


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path, {"p.prc": b"create procedure p is begin q; end;\n/\n", "q.prc": b"create procedure q is begin null; exception when others then null; end;\n/\n"})
    assert route(["x"]) == ["go", "x"] and route(["check", "x"]) == ["check", "x"] and route([]) == ["go"]
    assert run(["check", str(tmp_path)], spark) == 0
    assert run(["risks", str(tmp_path)], spark) == 2
    assert run(["outline", str(tmp_path)], spark) == 0
    assert run(["graph", "--routine", "p", str(tmp_path)], spark) == 0
    assert '["Q"]' in capsys.readouterr().out
    put(tmp_path, {"bad.prc": b"create procedure z is begin if; end;\n/\n"})
    assert run(["check", str(tmp_path)], spark) == 1
