"""Readers and writers on small files."""

import zipfile

import pytest

from alertsieve.sources import readers as rd


def test_csv_union_and_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Bug ID,Opened At\n1,2020-01-02\n2,broken\n')
    (tmp_path / "b.csv").write_text('bug id,Component\n3,Core\n')
    df = rd.read_csv_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert df.columns == ["bug_id", "opened_at", "component"] and df.count() == 3
    assert [r["bug_id"] for r in rd.with_dates(df, "opened_at").collect()] == ["1"]
    with pytest.raises(ValueError):
        rd.require_columns(df, ["nope"])


def test_series_files(spark, tmp_path):
    body = "push_timestamp,value,push_id,revision,single_alert_id\n2020-01-01 00:00:00,1.5,1,a,\n2020-01-02 00:00:00,,2,b,\n"
    (tmp_path / "sig_17.csv").write_text(body)
    df = rd.read_series(spark, str(tmp_path / "*.csv"))
    assert [(r["series_id"], r["value"]) for r in df.collect()] == [(17, 1.5)]
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("x/sig_5.csv", body)
        z.writestr("__MACOSX/sig_6.csv", body)
    assert [(r["series_id"], r["value"]) for r in rd.read_series_zip(spark, str(tmp_path / "*.zip")).collect()] == [(5, 1.5)]


def test_series_files_by_their_headers(spark, tmp_path):
    """Other orders of columns, quoted commas and quotes, words of a header in a row; a file without a header raises"""
    (tmp_path / "sig_1.csv").write_text('revision,"value",push_timestamp\r\n"a, ""b""",2.5,2020-01-01 00:00:00\r\n"push_timestamp value",3.5,2020-01-02 00:00:00\r\n\r\n')
    (tmp_path / "sig_2.csv").write_text("push_timestamp,other,value\n2020-01-03 00:00:00,9,4.5\n")
    (tmp_path / "sig_3.csv").write_text("")
    got = sorted((r["series_id"], r["value"], r["revision"]) for r in rd.read_series(spark, str(tmp_path / "*.csv")).collect())
    assert got == [(1, 2.5, 'a, "b"'), (1, 3.5, "push_timestamp value"), (2, 4.5, None)]
    (tmp_path / "sig_4.csv").write_text("time,amount\n2020-01-03 00:00:00,9\n")
    with pytest.raises(Exception, match="no header in"):
        rd.read_series(spark, str(tmp_path / "*.csv")).collect()


def test_splits_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    rd.write_splits(df, str(tmp_path / "s"))
    part = rd.read_split(spark, str(tmp_path / "s"), "test")
    assert [r["id"] for r in part.collect()] == [2]
    for run, fmt in (("r1", "json"), ("r2", "json")):
        rd.write_result(df, str(tmp_path / run), fmt)
    both = rd.collect_results(spark, [str(tmp_path / "r*" / "*.json")])
    assert {r["run"] for r in both.collect()} == {"r1", "r2"} and both.count() == 4
    rd.write_result(df, str(tmp_path / "c"), "csv")
    assert rd.read_csv(spark, str(tmp_path / "c"), "id long, split string").count() == 2


def test_safe_columns():
    from alertsieve.operators.categories import safe_columns

    names = ["single_alert_status", "series_id", "push_timestamp", "amount", "backfill_state", "title_text"]
    assert safe_columns(names, []) == ["amount", "title_text"]
    assert safe_columns(names, ["amount"], strict=True) == ["series_id"]


def test_read_scores(spark, tmp_path):
    rows = [(1, "test", "text", 0, 0, [0.9, 0.1]), (1, "test", "tree", 0, 1, [0.2, 0.8]), (2, "cal", "text", 1, 1, [0.3, 0.7]), (2, "cal", "tree", 1, 1, [0.4, 0.6])]
    spark.createDataFrame(rows, rd.SCORE_SCHEMA).write.parquet(str(tmp_path / "scores"))
    got = {r["id"]: r for r in rd.read_scores(spark, str(tmp_path / "scores"), "text", "tree").collect()}
    assert not got[1]["agree"] and got[2]["agree"] and got[1]["pb"] == [0.2, 0.8]
