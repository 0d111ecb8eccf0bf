"""The streaming operators, run as streams over files."""

import datetime as dt

from tallymark.streaming import audit

T0 = dt.datetime(2026, 1, 1, 8, 0, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def files(spark, folder, schema, *batches):
    """Each batch as one file, oldest first."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")


def drained(spark, df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_once_each_and_tumbling(spark, tmp_path):
    schema = "event_id long, event_type string, value double, ts timestamp"
    rows = [[(1, "a", 1.0, at(0)), (2, "a", 2.0, at(5)), (1, "a", 1.0, at(0))], [(2, "a", 2.0, at(5)), (3, "b", 4.0, at(20))], [(4, "a", 8.0, at(200))], [(5, "a", 1.0, at(400))]]
    files(spark, tmp_path / "in", schema, *rows)
    got = drained(spark, audit.once_each(stream(spark, tmp_path / "in", schema)), "once", tmp_path)
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4, 5]
    windows = drained(spark, audit.tumbling_counts(audit.once_each(stream(spark, tmp_path / "in", schema)), late=None), "tumbling", tmp_path)
    assert {(r.window_start, r.event_type, r.n, r.total) for r in windows} >= {(T0, "a", 2, 3.0), (T0, "b", 1, 4.0)}


def test_upsert_latest_over_restarts(spark, tmp_path):
    schema = "case_id string, finding_id string, status string, updated_at timestamp"
    files(spark, tmp_path / "in", schema, [("c", "f", "PENDING", at(0)), ("c", "g", "CONFIRMED", at(1))], [("c", "f", "DISMISSED", at(2))])
    for _ in range(2):  # the second run has nothing new
        audit.upsert_latest(stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
        assert {(r.finding_id, r.status) for r in audit.current(spark, str(tmp_path / "out")).collect()} == {("f", "DISMISSED"), ("g", "CONFIRMED")}
    files(spark, tmp_path / "more", schema, [("c", "g", "NEEDS_REUPLOAD", at(9)), ("d", "f", "PENDING", at(9))])
    audit.upsert_latest(stream(spark, tmp_path / "more", schema), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert {(r.case_id, r.finding_id, r.status) for r in audit.current(spark, str(tmp_path / "out")).collect()} == {("c", "f", "DISMISSED"), ("c", "g", "NEEDS_REUPLOAD"), ("d", "f", "PENDING")}


def test_complete_cases_report_once(spark, tmp_path):
    schema = "case_id string, doc_id string, ts timestamp"
    batches = [[("c", "d1", at(0)), ("c", "d2", at(1)), ("late", "d1", at(1))], [("c", "d3", at(2))], [("c", "d4", at(3))], [("z", "d1", at(300))], [("z", "d2", at(301))]]
    files(spark, tmp_path / "in", schema, *batches)
    got = drained(spark, audit.complete_cases(stream(spark, tmp_path / "in", schema).withWatermark("ts", "10 minutes")), "complete", tmp_path)
    assert sorted((r.case_id, r.n_docs, r.complete) for r in got if r.case_id != "z") == [("c", 3, True), ("late", 1, False)]


def test_decisions_join_their_findings(spark, tmp_path):
    found, made = "case_id string, finding_id string, found_at timestamp", "case_id string, finding_id string, status string, decided_at timestamp"
    files(spark, tmp_path / "f", found, [("a", "dob", at(0)), ("b", "dob", at(1))], [("c", "dob", at(30)), ("d", "dob", at(31))], [("e", "dob", at(500))], [("f", "dob", at(900))], [("g", "dob", at(1300))])
    files(spark, tmp_path / "d", made, [("a", "dob", "CONFIRMED", at(10)), ("b", "name", "CONFIRMED", at(11))], [("c", "dob", "DISMISSED", at(40)), ("d", "dob", "CONFIRMED", at(120)), ("c", "dob", "CONFIRMED", at(50))], [("e", "dob", "CONFIRMED", at(499))], [("x", "dob", "CONFIRMED", at(900))], [("x", "dob", "CONFIRMED", at(1300))])
    got = drained(spark, audit.with_decisions(stream(spark, tmp_path / "f", found), stream(spark, tmp_path / "d", made)), "decided", tmp_path)
    seen = sorted((r.case_id, r.status) for r in got)
    # another finding's decision, one that comes too late and one from before count for nothing
    assert seen[:5] == [("a", "CONFIRMED"), ("b", "PENDING"), ("c", "CONFIRMED"), ("c", "DISMISSED"), ("d", "PENDING")] and ("e", "PENDING") in seen
    table = audit.with_decisions(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "f")), spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "d")))
    assert sorted((r.case_id, r.status) for r in table.collect())[:5] == seen[:5] and table.count() == 8


def test_compaction_bounds_what_is_read(spark, tmp_path):
    schema = "case_id string, finding_id string, status string, updated_at timestamp"
    batches = [[("c", "f", f"S{k}", at(k)), (f"c{k}", "f", "PENDING", at(k))] for k in range(11)]
    files(spark, tmp_path / "in", schema, *batches)
    out = str(tmp_path / "out")
    audit.upsert_latest(stream(spark, tmp_path / "in", schema), out, str(tmp_path / "c1"), compact=3).awaitTermination()
    assert len(audit.live(spark, out)) == 3 and len(audit.folders(spark, out)) < 11  # the newest written together and two batches
    got = {(r.case_id, r.status) for r in audit.current(spark, out).collect()}
    assert got == {("c", "S10")} | {(f"c{k}", "PENDING") for k in range(11)}
    files(spark, tmp_path / "more", schema, [("c", "f", "LAST", at(99))])
    audit.upsert_latest(stream(spark, tmp_path / "more", schema), out, str(tmp_path / "c2"), compact=3).awaitTermination()
    assert {r.status for r in audit.current(spark, out).filter("case_id = 'c'").collect()} == {"LAST"} and len(audit.live(spark, out)) == 4
