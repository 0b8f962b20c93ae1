"""Files that grow, shrink and are replaced, read as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from weftline.streaming import follow


@pytest.fixture
def reader(spark, tmp_path):
    """Lines that a stream has seen so far; each call is a restart from its checkpoint."""
    out, n = tmp_path / "seen", [0]

    def run(path):
        q = follow.follow(spark, str(path)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(str(out)).collect() if any(f.suffix == ".parquet" for f in out.glob("*")) else []
        n[0] += 1
        return sorted((os.path.basename(r.source), r.offset, r.value) for r in rows)

    return run


def test_appended_lines_come_once_and_restarts_go_on(reader, tmp_path):
    log = tmp_path / "log.txt"
    log.write_bytes("a\r\n\nü\nhalf".encode())
    first = [("log.txt", 0, "a"), ("log.txt", 3, ""), ("log.txt", 4, "ü")]
    assert reader(log) == first and reader(log) == first
    with log.open("ab") as f:
        f.write(b" line\nnext\n")
    grown = [*first, ("log.txt", 7, "half line"), ("log.txt", 17, "next")]
    assert reader(log) == grown and reader(log) == grown


def test_truncated_and_replaced_files_are_read_anew(reader, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("one\ntwo\nthree\n")
    seen = reader(log)
    log.write_text("new\n")  # shorter
    assert reader(log) == sorted([*seen, ("log.txt", 0, "new")])
    log.write_text("other lines, and more of them\nthan before\n")  # longer, but another beginning
    again = reader(log)
    assert [x for x in again if x not in seen] == [("log.txt", 0, "new"), ("log.txt", 0, "other lines, and more of them"), ("log.txt", 30, "than before")]
    log.unlink()
    assert reader(log) == again
    log.write_text("back\n")
    assert reader(log) == sorted([*again, ("log.txt", 0, "back")])


def test_files_of_a_pattern(reader, tmp_path):
    (tmp_path / "logs").mkdir()
    for k in range(2):
        (tmp_path / "logs" / f"{k}.log").write_text(f"first {k}\n")
    (tmp_path / "logs" / "x.txt").write_text("no\n")
    assert [v for _, _, v in reader(tmp_path / "logs" / "*.log")] == ["first 0", "first 1"]
    (tmp_path / "logs" / "2.log").write_text("first 2\n")
    with (tmp_path / "logs" / "0.log").open("a") as f:
        f.write("second 0\n")
    assert [v for _, _, v in reader(tmp_path / "logs" / "*.log")] == ["first 0", "second 0", "first 1", "first 2"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
def test_ranges_have_every_line_once(tmp_path, size):
    text = "".join(f"{'é' * (k % 9)}{k}\n" for k in range(60)) + "\n\nlast\n" + "y" * 100 + "\n"
    path = tmp_path / "x"
    path.write_bytes(text.encode())
    n, r = len(text.encode()), follow._Reader(str(path))
    got = [v for a in range(0, n, size) for b in r.read(follow.Range(str(path), a, min(n, a + size))) for v in b["value"].to_pylist()]
    assert got == text.split("\n")[:-1]


def test_long_lines_cross_reads(tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "STEP", 16)
    path = tmp_path / "x"
    path.write_text("a" * 100 + "\n" + "b" * 5 + "\n" + "c" * 40 + "\nopen")
    fs, files = follow._listed(str(path))
    to = follow.place(fs, str(path), files[str(path)])
    assert to["at"] == 148
    got = [v for a, b in ((0, 50), (50, 101), (101, 148)) for x in follow._Reader(str(path)).read(follow.Range(str(path), a, b)) for v in x["value"].to_pylist()]
    assert got == ["a" * 100, "b" * 5, "c" * 40]


def test_reload():
    assert follow.reloaded(9, 10, 15) == (14, 5) and follow.reloaded(3, 10, 15) == (3, 5)
    assert follow.reloaded(7, 10, 5) == (4, -5) and follow.reloaded(0, 1, 0) == (0, -1)


def test_lines_are_columns(spark, tmp_path):
    (tmp_path / "x").write_text('{"a": 1}\n')
    rows = follow.follow(spark, str(tmp_path / "x"))
    assert rows.isStreaming and rows.select(F.get_json_object("value", "$.a")).columns
