"""Files cut anywhere, against Spark's own reader."""

import json
import random

import pytest

from storygauge.schemas import BACKLOG, TICKETS
from storygauge.sources import backlog, files, split_files


@pytest.fixture
def stretches(spark):
    """Lets Spark cut files into stretches of so many bytes."""
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "16")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def drawn(seed, n):
    draw = random.Random(seed)
    bits = ["word", '"quoted"', ",", "\n", "\r\n", "}", "{", "[", "]", "\\", "é漢🙂", " ", "a" * 40, "\\\"", ":", '"']
    text = lambda: "".join(draw.choices(bits, k=draw.randint(0, 12))) or None
    return [(f"K-{i}", text(), "Bug", text(), text(), draw.choice([None, 1, 5])) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [64, 301, 1 << 20])
def test_csv_equals_spark_and_is_read_in_many_tasks(spark, tmp_path, stretches, size):
    data = drawn(size, 200)
    path = str(tmp_path / "csv")
    files.write_csv(spark.createDataFrame(data, TICKETS).coalesce(2), path)
    whole = rows(files.read_csv(spark, path, TICKETS, split=False))
    stretches(size)
    got = files.read_csv(spark, path, TICKETS, split=True)
    assert rows(got) == whole and len(whole) == 200
    pieces = split_files._pieces(spark, path, split_files.Lines(tuple(TICKETS.fieldNames())))
    assert size > 1000 or pieces.select("file", "start").distinct().count() > 40


def test_csv_by_other_writers(spark, tmp_path, stretches):
    head = ",".join(TICKETS.fieldNames())
    (tmp_path / "a.csv").write_bytes((f'﻿{head}\r\nA-1,P,Bug,"t\r\nt","say ""x""",3\r\n\r\nA-2,,Bug,"{"long " * 60}\r\n",d,5').encode())
    (tmp_path / "b.csv").write_text(f'{head}\n"B-1",P,Bug,"","{chr(10) * 50}",8\n')
    (tmp_path / "c.csv").write_text(f"{head}\n")
    stretches(50)
    got = rows(files.read_csv(spark, str(tmp_path), TICKETS, split=True))
    assert [r[0] for r in got] == ["A-1", "A-2", "B-1"] and got[0][3:] == ("t\r\nt", 'say "x"', 3)
    assert got[1][1] is None and got[1][3] == "long " * 60 + "\r\n" and got[2][4] == "\n" * 50


def test_faults_are_errors(spark, tmp_path, stretches):
    stretches(64)
    (tmp_path / "h.csv").write_text("issue_key,other\nA,b\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        files.read_csv(spark, str(tmp_path / "h.csv"), TICKETS, split=True).collect()
    (tmp_path / "q.csv").write_text(",".join(TICKETS.fieldNames()) + '\nA,P,Bug,"never closed' + " text" * 50)
    with pytest.raises(Exception, match="does not end"):
        files.read_csv(spark, str(tmp_path / "q.csv"), TICKETS, split=True).collect()
    for i, text in enumerate(('{"issue_key": "A"}', '[{"issue_key": "A"}, 7, {"issue_key": "B"}]', "[1, 2]", '[{"issue_key": "A"}, {"issue_key": "B"')):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="JSON array|does not end|MALFORMED|Malformed"):
            backlog.read_backlog(spark, str(tmp_path / f"{i}.json"), split=True).collect()


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [64, 501])
def test_json_arrays_equal_spark(spark, tmp_path, stretches, size, indent):
    data = [dict(zip(BACKLOG.fieldNames(), r[:5])) | {"extra": {"deep": [{"a": "}{"}, [1, {"b": r[4]}]]}} for r in drawn(size, 120)]
    path = str(tmp_path / "b.json")
    (tmp_path / "b.json").write_text(json.dumps(data, indent=indent, ensure_ascii=bool(indent)))
    whole = rows(backlog.read_backlog(spark, path, split=False))
    stretches(size)
    assert rows(backlog.read_backlog(spark, path, split=True)) == whole and len(whole) == 120
    assert split_files.outgrows_a_task(spark, path) and rows(backlog.read_backlog(spark, path)) == whole


def test_empty_arrays_and_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(" [ ]\n")
    assert backlog.read_backlog(spark, str(tmp_path / "e.json"), split=True).count() == 0
    (tmp_path / "z.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "z.csv"), TICKETS, split=True).count() == 0
    assert not split_files.outgrows_a_task(spark, str(tmp_path / "none"))
