from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from storygauge.operators import cleaning
from storygauge.schemas import BACKLOG, ISSUES, PROJECTS, TICKETS
from storygauge.sources import backlog, files, tables


def test_csv_round_trip(spark, tmp_path):
    rows = [
        ("A-1", "P, Q", "Bug", 'say "hi"', "line one\nline, two\r\nthree", 3), ("A-2", None, "Bug", "back\\slash", "it's", 0),
        ("A-3", "P", "Bug", " padded ", 'ends with "', None),
    ]
    path = str(tmp_path / "t")
    files.write_csv(spark.createDataFrame(rows, TICKETS), path, order_by="issue_key")
    got = [tuple(r) for r in files.read_csv(spark, path, TICKETS).orderBy("issue_key").collect()]
    assert got == rows


def test_csv_written_elsewhere(spark, tmp_path):
    text = 'issue_key,project,issue_type,title,description,actual_story_points\nA-1,P,Story,"a, b","x ""y""\nz",13\n'
    (tmp_path / "f.csv").write_text(text)
    (row,) = files.read_csv(spark, str(tmp_path / "f.csv"), TICKETS).collect()
    assert tuple(row) == ("A-1", "P", "Story", "a, b", 'x "y"\nz', 13)


def test_csv_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "f.csv").write_text("issue_key,project,issue_type,title,text,actual_story_points\nA-1,P,Story,a,b,13\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        files.read_csv(spark, str(tmp_path / "f.csv"), TICKETS).collect()


def test_backlog(spark, tmp_path):
    (tmp_path / "b.json").write_text(' \n[ {"issue_key": "TKT-001", "project": "P", "title": "a\\nb"},\n {"issue_key": "TKT-002", "extra": 1}]')
    got = [tuple(r) for r in backlog.read_backlog(spark, str(tmp_path / "b.json")).orderBy("issue_key").collect()]
    assert got == [("TKT-001", "P", None, "a\nb", None), ("TKT-002", None, None, None, None)]
    (tmp_path / "e.json").write_text("[]")
    assert backlog.read_backlog(spark, str(tmp_path / "e.json")).count() == 0
    assert backlog.read_backlog(spark, str(tmp_path / "missing.json")).columns == BACKLOG.fieldNames()
    (tmp_path / "o.json").write_text('{"issue_key": "TKT-001"}')
    with pytest.raises(ValueError, match="JSON array"):
        backlog.read_backlog(spark, str(tmp_path / "o.json"))


def test_backlog_round_trip(spark, tmp_path):
    rows = [("TKT-001", "P", "Bug", "t", "d\n\"q\"")]
    backlog.write_backlog(spark.createDataFrame(rows, BACKLOG), str(tmp_path / "out"))
    assert [tuple(r) for r in backlog.read_backlog_lines(spark, str(tmp_path / "out")).collect()] == rows


def test_jdbc_read_is_partitioned():
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def options(self, **options):
            self.seen.update(options)
            return self

        def load(self):
            return self.seen

    class Session:
        read = Reader()

    got = tables.read_jdbc(Session(), "jdbc:x", "Issue", partition_column="ID", lower=1, upper=100, partitions=8, user="u")
    assert got == {"format": "jdbc", "url": "jdbc:x", "dbtable": "Issue", "user": "u", "partitionColumn": "ID",
                   "lowerBound": "1", "upperBound": "100", "numPartitions": "8"}
    with pytest.raises(ValueError):
        tables.read_jdbc(Session(), "jdbc:x", "Issue", partition_column="ID", lower=1, upper=1, partitions=8)


@pytest.fixture
def issue_tables(spark):
    rows = [
        (1, None, 1, "Bug", '""T""', "m", None, "High", None), (2, " ", 2, None, '"T', "m", ' "d" ', None, -1.0),
        (3, "K-3", 9, "Bug", None, '"m"', " ", " ", 0.0), (4, "K-4", None, "Bug", "t", None, "d", "Low", 0.5),
        (5, "K-5", 1, "Bug", "t", None, "d", "Low", 2.567), (6, "K-6", 1, "Bug", "t", None, "d", "Low", 100.0),
        (7, "K-7", 1, "Bug", "t", None, "d", "Low", 101.0),
    ]
    return spark.createDataFrame(rows, ISSUES), spark.createDataFrame([(1, "P"), (2, "Unknown"), (3, " ")], PROJECTS)


def test_load_issues_keeps_every_row(issue_tables):
    got = {(r.Title, r.Project_Name) for r in tables.load_issues(*issue_tables).collect()}
    assert ('""T""', "P") in got and (None, None) in got and tables.load_issues(*issue_tables).count() == 7


def test_export_filters_labels(issue_tables):
    keys = lambda zero: {r.ID for r in tables.load_issues_for_export(*issue_tables, include_zero=zero).collect()}
    assert keys(False) == {4, 5, 6} and keys(True) == {3, 4, 5, 6}


def test_clean_tickets(issue_tables):
    named = cleaning.with_project(*issue_tables)
    got = {r.issue_key: tuple(r)[1:] for r in cleaning.to_tickets(named, "GEN-").collect()}
    assert set(got) == {"K-3", "K-4", "K-5", "K-6", "K-7"}  # no label and a negative label are left out
    assert got["K-3"] == ("Unknown", "Bug", "", "m", 0)
    assert [got[k][-1] for k in ("K-4", "K-5", "K-6", "K-7")] == [1, 3, 21, 21]


def test_label_filter_reaches_the_scan(spark, issue_tables, tmp_path):
    issue_tables[0].write.parquet(str(tmp_path / "i"))
    plan = tables.load_issues_for_export(spark.read.schema(ISSUES).parquet(str(tmp_path / "i")), issue_tables[1])
    with redirect_stdout(StringIO()) as out:
        plan.select("ID").explain("formatted")
    scan = next(part for part in out.getvalue().split("\n\n") if "Scan parquet" in part and "PushedFilters" in part)
    assert "GreaterThan(Story_Point,0.0)" in scan and "LessThanOrEqual(Story_Point,100.0)" in scan
    assert "ReadSchema: struct<ID:bigint,Project_ID:bigint,Story_Point:double>" in scan


def test_required_columns(spark):
    from storygauge.operators.checks import require_columns

    df = spark.createDataFrame([(1,)], "a int").withColumn("b", F.lit(1))
    assert require_columns(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="missing column\\(s\\): c, d"):
        require_columns(df, ["a", "c", "d"])
