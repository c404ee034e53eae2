"""Readers and sinks on small files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.operators import quality as Q
from threatlake.sources import profiles as P
from threatlake.sources import readers as RD
from threatlake.sources import sinks as SK


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_ragged_text_csv_with_day_tag(spark, tmp_path):
    put(tmp_path, "Monday-hours.csv", " A, B,C \n1,2,3\n4\n")
    put(tmp_path, "extra.csv", " A, B,C \n7,8,nan\n")
    df = RD.read_text_csv(spark, str(tmp_path), [" A", " B", "C "], tag="source_day", nan_is_null=True)
    assert df.columns == ["A", "B", "C", "source_day"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("1", "2", "3", "Monday"), ("4", None, None, "Monday"), ("7", "8", None, "Unknown")]


def test_latin1(spark, tmp_path):
    path = put(tmp_path, "Thursday.csv", "Label,x\nWeb Attack \x96 XSS,1\n", "latin-1")
    label = RD.read_text_csv(spark, path, encoding="ISO-8859-1").first()["Label"]
    assert label == "Web Attack \x96 XSS"


def test_column_names(spark):
    assert [RD.normalize_name(n) for n in (" Flow Bytes/s", "Fwd.Header-Length", "Down/Up Ratio ")] == [
        "flow_bytes_s", "fwd_header_length", "down_up_ratio"]


def test_union_of_days(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4, 5)], "y int, x int, z int")
    both = RD.union_days([a, b], ["x", "y"])
    assert sorted(tuple(r) for r in both.collect()) == [(1, 2), (4, 3)]
    assert RD.reconcile(both, [a, b]).first()["matches"]


def test_clean_flows(spark):
    raw = spark.createDataFrame(
        [("f1", "1.2.3.4", "5.6.7.8", "80", "12.7", "Infinity", "3.5", "DDoS", "7/7/2017 3:30", "Friday"),
         ("f2", "1.2.3.4", "5.6.7.8", "x", "7", "1e3", "NaN", None, None, "Friday")],
        "`Flow ID` string, `Source IP` string, `Destination IP` string, `Source Port` string, `Flow Duration` string, "
        "`Flow Bytes/s` string, `Flow IAT Max` string, Label string, Timestamp string, source_day string")
    rows = {r["Flow ID"]: r for r in RD.clean_flows(raw).collect()}
    f1, f2 = rows["f1"], rows["f2"]
    assert (f1["Source Port"], f1["Flow Duration"], f1["Flow Bytes/s"], f1["Flow IAT Max"]) == (80, 13, None, 4)
    assert f1["event_time"] == dt.datetime(2017, 7, 7, 15, 30) and f1["attack_family"] == "DDoS" and f1["is_attack"] == 1
    assert (f2["Source Port"], f2["Flow Bytes/s"], f2["Flow IAT Max"], f2["event_time"], f2["label_clean"], f2["is_attack"]) == (
        None, 1000.0, None, None, "Unlabeled", None)
    kinds = RD.flow_types()
    assert len(kinds) == 82 and kinds["Flow IAT Min"] == "bigint" and kinds["Idle Mean"] == "double" and kinds["Protocol"] == "int"


def logs(tmp_path):
    put(tmp_path, "logon.csv", "id,date,user,pc,activity\nL1,01/02/2010 06:49:00,U1,PC-1,Logon\nL2,bad,U1,PC-1,Logoff\n")
    put(tmp_path, "device.csv", "id,date,user,pc,activity\nD1,01/02/2010 07:21:06,U1,PC-1,Connect\nD2,01/02/2010 07:37:41,U1,PC-1,Odd\n")
    put(tmp_path, "email.csv", "id,date,user,pc,to,cc,bcc,from,size,attachments,content\n"
        "E1,01/02/2010 07:11:45,U2,PC-2,a@dtaa.com;b@x.org,c@dtaa.com,,me@dtaa.com,25830,2,long body\n")
    put(tmp_path, "file.csv", "id,date,user,pc,filename,content\nF1,01/02/2010 08:00:00,U2,PC-2,EYPC9Y08.doc,body\n")


def test_activity_logs(spark, tmp_path):
    logs(tmp_path)
    frames = [RD.read_logon(spark, str(tmp_path / "logon.csv")), RD.read_device(spark, str(tmp_path / "device.csv")),
              RD.read_email(spark, str(tmp_path / "email.csv")), RD.read_file_events(spark, str(tmp_path / "file.csv"))]
    assert all(tuple(f.columns) == C.ACTIVITY_COLUMNS for f in frames)
    rows = RD.unify_activity(frames, sort=True).collect()
    assert [r["event_id_src"] for r in rows] == ["L1", "E1", "D1", "D2", "F1"]
    mail = rows[1]
    assert (mail["email_recipients_count"], mail["email_to_external_domain"], mail["email_from_external_address"], mail["email_size"],
            mail["email_attachments_count"]) == (3, 1, 0, 25830, 2)
    assert [r["activity_type"] for r in rows] == ["Logon", "Email", "USB_Connect", None, "File_Activity"]
    plan = frames[2]._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_directory_snapshots(spark, tmp_path):
    head = "employee_name,user_id,email,role,business_unit,functional_unit,department,team,supervisor\n"
    put(tmp_path, "2010-01.csv", head + "Ann , U1,a@dtaa.com,Engineer,1,2,3,,Boss\n")
    put(tmp_path, "2010-02.csv", head + "Ann,U1,a@dtaa.com,Manager,1,2,3,,Boss\n")
    rows = {r["snapshot_date"]: r for r in RD.read_snapshots(spark, str(tmp_path)).collect()}
    assert rows[dt.date(2010, 1, 1)]["employee_name"] == "Ann" and rows[dt.date(2010, 1, 1)]["user_id"] == "U1"
    assert rows[dt.date(2010, 2, 1)]["role"] == "Manager" and rows[dt.date(2010, 2, 1)]["team"] is None
    put(tmp_path, "other.csv", head + "x,U2,,,,,,,\n")
    with pytest.raises(Exception, match="unexpected snapshot file"):
        RD.read_snapshots(spark, str(tmp_path)).collect()


def test_insider_key(spark, tmp_path):
    path = put(tmp_path, "insiders.csv", "dataset,scenario,details,user,start,end\n"
               "4.2,1,x,U1,7/1/2010 1:24:58,07/16/2010 6:52:00\n4.2,2,x,U2,bad,8/1/2010 1:00:00\n5.2,1,x,U3,7/1/2010 1:00:00,7/2/2010 1:00:00\n")
    rows = [tuple(r) for r in RD.read_insiders(spark, path).collect()]
    assert rows == [("U1", 1, dt.datetime(2010, 7, 1, 1, 24, 58), dt.datetime(2010, 7, 16, 6, 52))]
    folder = tmp_path / "answers"
    folder.mkdir()
    put(folder, "r-1-U1.csv", "x\n")
    put(folder, "r-1-U9.csv", "x\n")
    assert sorted(r[0] for r in RD.insider_ids(spark, str(folder), "r-1-").collect()) == ["U1", "U9"]


def test_psychometric(spark, tmp_path):
    path = put(tmp_path, "p.csv", "employee_name,user_id,O,C,E,A,N\nAnn,U1,40,39,36,19,x\n")
    assert tuple(RD.read_psychometric(spark, path).first()) == ("U1", 40, 39, 36, 19, None)


def test_sinks(spark, data, tmp_path):
    events = data.events.select("event_id", F.to_date("ts").alias("day"), "value")
    SK.write_snapshot(events, str(tmp_path / "snap"), "snappy")
    assert spark.read.parquet(str(tmp_path / "snap")).count() == events.count()
    SK.write_csv(events.limit(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    fact = data.fact
    SK.write_fact(fact, str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    whole = stored.count()
    assert whole == fact.count()
    day = stored.agg(F.min("date_sk")).first()[0]
    changed = stored.filter(F.col("date_sk") == day).withColumn("flow_duration", F.lit(-1).cast("bigint"))
    kept = [tuple(r) for r in changed.collect()]
    SK.replace_partitions(spark.createDataFrame(kept, changed.schema), str(tmp_path / "fact"))
    after = spark.read.parquet(str(tmp_path / "fact"))
    assert after.count() == whole and after.filter("flow_duration = -1").count() == len(kept)
    plan = after.filter(F.col("date_sk") == day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_sk" in plan


def test_next_version_may_read_the_old_one(spark, tmp_path):
    first = SK.next_version(spark, spark.range(3), str(tmp_path), "t", "v1")
    second = SK.next_version(spark, first.union(spark.range(2)), str(tmp_path), "t", "v2")
    assert (first.count(), second.count()) == (3, 5)
    with pytest.raises(Exception):
        SK.next_version(spark, first, str(tmp_path), "t", "v2")


def test_json_keys_skip_bad_rows(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}',), ("not json",), (None,), ('{"d": null}',), ("[1]",)], "raw string")
    assert sorted(r[0] for r in P.json_keys(df, "raw").collect()) == ["a", "b", "d"]


def test_type_profile(spark, data):
    rows = {(r["table_name"], r["column_type"]): r["columns"] for r in P.type_profile(spark, {"events": data.events}).collect()}
    assert rows[("events", "bigint")] == 2 and rows[("events", "string")] == 2


def test_schema_guards(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="missing required"):
        Q.require_columns(df)
    with pytest.raises(ValueError, match="only 1 columns"):
        Q.require_columns(df, ["x"], 2)
    assert Q.require_columns(df, ["x"], 1) is df
    with pytest.raises(ValueError):
        Q.require_rows(5, "full", 10)
    Q.require_rows(5, "sample", 10)


def test_quotes_backslashes_and_line_ends(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,filename,content\n1,"C:\\dir\\",x\n2,"a ""q"", b.doc",y\n')
    rows = [tuple(r) for r in RD.read_text_csv(spark, str(tmp_path / "a.csv"), ["id", "filename", "content"]).orderBy("id").collect()]
    assert rows == [("1", "C:\\dir\\", "x"), ("2", 'a "q", b.doc', "y")]
    put(tmp_path, "b.csv", 'id,content\n1,"two\nlines"\n')
    assert RD.read_text_csv(spark, str(tmp_path / "b.csv"), multiline=True).first()["content"] == "two\nlines"


def test_snapshots_with_other_column_order(spark, tmp_path):
    folder = tmp_path / "months"
    folder.mkdir()
    put(folder, "2010-01.csv", "employee_name,user_id,email,role\nAnn,A1,a@x,R\n")
    put(folder, "2010-02.csv", "user_id,employee_name,role\nA1,Ann,S\n")
    got = sorted((str(r["snapshot_date"]), r["user_id"], r["employee_name"], r["email_address"], r["role"]) for r in RD.read_snapshots(spark, str(folder)).collect())
    assert got == [("2010-01-01", "A1", "Ann", "a@x", "R"), ("2010-02-01", "A1", "Ann", None, "S")]
