import json
import zipfile

import pytest

from convolake.sources import tables as T
from convolake.streaming import sessions as S


def test_transcripts_keep_literal_words_and_report_faults(spark, tmp_path):
    (tmp_path / "a.csv").write_text('session_id,utterance_id,role,content,timestamp\na,10,STUDENT,null,0:00:02\na,2,Tutor,NA,0:00:01\na,1,background,"x, ""y""\nz",\n')
    (tmp_path / "b.csv").write_text("session_id,utterance_id,role,content,timestamp\nb,1,system,hi,\nb,1,tutor,ho,\n")
    t = T.read_transcripts(spark, str(tmp_path))
    rows = {(r.session_id, r.utterance_id, r.role): r.content for r in t.collect()}
    assert rows[("a", "10", "student")] == "null" and rows[("a", "2", "tutor")] == "NA" and rows[("a", "1", "background")] == 'x, "y"\nz'
    assert {r._stem: r.faults for r in T.transcript_faults(t).collect()} == {"b": ["utterance ids", "roles"]}


def test_tables_by_suffix(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1, "b": {"c": "q"}}, {"a": 2, "b": {"c": None}}]))
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(T.read_table(spark, str(tmp_path / "x.json")).columns) == ["a", "b.c"]
    assert T.read_table(spark, str(tmp_path / "x.jsonl")).count() == 2
    p = {r.column_name: r.n_missing for r in T.profile(T.read_table(spark, str(tmp_path / "x.json"))).collect()}
    assert p == {"a": 0, "b.c": 1}
    with pytest.raises(ValueError):
        T.read_table(spark, "x.docx")


def test_archives_and_hashes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m.txt").write_text("abc")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "d" / "m.txt", "m.txt")
    member, file = T.zip_members(spark, str(tmp_path / "z.zip")).first(), T.file_hashes(spark, str(tmp_path / "d")).first()
    assert member.sha256 == file.sha256 and member.size == file.size == 3


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 0.2), ("a", 0.1)], "response_id string, probability double")
    T.write_submission(d, str(tmp_path / "s"))
    assert next((tmp_path / "s").glob("*.csv")).read_text() == "response_id,probability\na,0.1\nb,0.2\n"
    T.write_store(d, str(tmp_path / "p"), "response_id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    T.write_json(str(tmp_path / "r.json"), {"b": 1, "a": 2})
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]


def test_stream_gives_the_batch_rows(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "value")
    batch.write.parquet(str(tmp_path / "in"))
    q = S.session_windows(S.event_stream(spark, str(tmp_path / "in"), batch.schema)).writeStream.format("memory").queryName("sessions_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = sorted(map(str, spark.sql("select * from sessions_out").collect()))
    finally:
        q.stop()
    assert got == sorted(map(str, S.session_windows(batch).collect()))
