"""Streams over several batches: ingest with bounded state, its compaction, and work that is acknowledged after it is done."""

import glob

import pytest

from mockloom.streaming import jobs as streams
from mockloom.streaming import queue

EVENT = "event_id bigint, ts string, job_id bigint, status string"


def feed(spark, folder, *rows):
    frame = spark.createDataFrame([(i, f"2024-01-01 {at}" if at else None, i % 3, s) for i, at, s in rows], EVENT)
    frame.selectExpr("event_id", "CAST(ts AS timestamp_ntz) ts", "job_id", "status").coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    schema = spark.createDataFrame([], "event_id bigint, ts timestamp_ntz, job_id bigint, status string").schema
    return streams.event_stream(spark, folder, schema, "*.parquet")


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_ingest_over_many_batches(spark, tmp_path):
    into, root = f"{tmp_path}/in", f"{tmp_path}/i"
    run = lambda: streams.ingest_once(source(spark, into), root, buckets=4)
    feed(spark, into, *[(i, "08:00:00", "running") for i in range(20)], (20, "12:00:00", "running"))
    assert ids(run()) == list(range(21))
    feed(spark, into, (20, "12:00:00", "running"), (21, "13:30:00", "pending"), (22, None, "pending"))
    assert ids(run()) == list(range(23)) and ids(streams.late_events(spark, root)) == [22]

    # a batch in time reads nothing of the events before it: they may even be unreadable
    files = {f: open(f, "rb").read() for f in glob.glob(f"{root}/events/*/*/*/*.parquet")}
    for f in files:
        open(f, "wb").write(b"no parquet")
    for crc in glob.glob(f"{root}/events/*/*/*/.*.crc"):
        open(crc, "wb").write(b"")
    feed(spark, into, (21, "13:30:00", "pending"), (23, "13:45:00", "pending"), (23, "13:44:00", "running"))
    run()
    for f, content in files.items():
        open(f, "wb").write(content)
    for crc in glob.glob(f"{root}/events/_batch=[01]/*/*/.*.crc"):
        __import__("os").remove(crc)
    everything = run()
    assert ids(everything) == list(range(24))
    assert [(r["status"], str(r["ts"])[11:]) for r in everything.filter("event_id = 23").collect()] == [("running", "13:44:00")]

    # late events, some new and some seen before, on both sides of a compaction
    feed(spark, into, (3, "08:00:00", "running"), (24, "09:00:00", "failed"), (22, None, "pending"))
    assert ids(run()) == list(range(25)) and ids(streams.late_events(spark, root)) == [22, 24]
    assert streams.compact(spark, root) == 2 and not glob.glob(f"{root}/events/_batch=[01]")
    assert ids(run()) == list(range(25))
    feed(spark, into, (24, "09:00:00", "failed"), (4, "08:00:00", "running"), (25, "14:00:00", "failed"), (23, "13:44:00", "running"))
    assert ids(run()) == list(range(26)) and ids(streams.late_events(spark, root)) == [22, 24]
    assert streams.compact(spark, root) == 3 and streams.compact(spark, root) == 3
    assert ids(run()) == list(range(26)) and len(glob.glob(f"{root}/whole/*")) == 1
    with pytest.raises(Exception, match="4 buckets"):
        feed(spark, into, (26, "14:00:00", "failed"))
        streams.ingest_once(source(spark, into), root, buckets=8)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    into, root = f"{tmp_path}/in", f"{tmp_path}/i"
    feed(spark, into, (1, "12:00:00", "running"), (2, "08:00:00", "running"))
    streams.ingest_once(source(spark, into), root)
    feed(spark, into, (2, "08:00:00", "running"), (3, "12:30:00", "running"), (4, "07:00:00", "failed"))
    assert ids(streams.ingest_once(source(spark, into), root)) == [1, 2, 3, 4]
    streams.compact(spark, root)
    for name in ("1", ".1.crc"):  # as if the stream had ended after the writes of its last batch, before it was noted
        (tmp_path / "i" / "state" / "commits" / name).unlink()
    assert ids(streams.ingest_once(source(spark, into), root)) == [1, 2, 3, 4] and ids(streams.late_events(spark, root)) == [4]


def test_empty_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ids(streams.ingest_once(source(spark, f"{tmp_path}/in"), f"{tmp_path}/i")) == []
    assert streams.late_events(spark, f"{tmp_path}/i") is None and streams.compact(spark, f"{tmp_path}/i") is None


# --- work that is acknowledged after it is done ---------------------------------------------------


def state(df):
    return sorted((r["message"], r["attempt"], r["status"], r["result"]) for r in df.collect())


def test_failed_work_stays_in_the_queue(spark, tmp_path):
    line, root = f"{tmp_path}/queue", f"{tmp_path}/work"
    done, broken = f"{tmp_path}/ran", tmp_path / "broken"
    broken.write_text("yes")

    def handler(job):
        with open(done, "a") as f:
            f.write(f"{job['job_id']}\n")
        if job["n"] is not None and job["n"] < 0:
            raise ValueError("negative")
        if job["job_id"] == "b" and broken.exists():
            raise OSError("not reachable")
        return {"twice": (job["n"] or 0) * 2} if "n" in job else None

    jobs = spark.createDataFrame([("a", 1), ("b", 2), ("c", -3), ("c", -3)], "job_id string, n int")
    assert queue.enqueue(jobs, line) == 3
    assert queue.enqueue(jobs, line) == 3  # replaced, not added
    (tmp_path / "queue" / "waiting" / "odd.json").write_text("[1")
    names = lambda kind: sorted(p.name for p in (tmp_path / "queue" / kind).glob("*.json"))
    first = queue.work_off(spark, line, root, handler, attempts=3)
    assert state(first) == [("a", 1, "done", '{"twice": 2}'), ("b", 1, "failed", None), ("c", 1, "failed", None), ("odd", 1, "failed", None)]
    assert names("waiting") == ["b.json", "c.json", "odd.json"] and names("settled") == ["a.json"]

    broken.unlink()
    queue.enqueue(spark.createDataFrame([("a", 9), ("d", 4)], "job_id string, n int"), line)  # a is settled
    second = queue.work_off(spark, line, root, handler, attempts=3)
    assert state(second)[:2] == [("a", 1, "done", '{"twice": 2}'), ("b", 2, "done", '{"twice": 4}')] and state(second)[3] == ("d", 1, "done", '{"twice": 8}')
    third = queue.work_off(spark, line, root, handler, attempts=3)
    assert [r[:3] for r in state(third)] == [("a", 1, "done"), ("b", 2, "done"), ("c", 3, "dead"), ("d", 1, "done"), ("odd", 3, "dead")]
    assert names("waiting") == []
    ran = open(done).read().split()
    assert {k: ran.count(k) for k in "abcd"} == {"a": 1, "b": 2, "c": 3, "d": 1}
    assert state(queue.work_off(spark, line, root, handler)) == state(third) and open(done).read().split() == ran


def test_a_round_that_was_not_noted_only_acknowledges(spark, tmp_path):
    line, root, ran = f"{tmp_path}/queue", f"{tmp_path}/work", f"{tmp_path}/ran"

    def handler(job):
        with open(ran, "a") as f:
            f.write("x")
        return job["n"]

    queue.enqueue(spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, n int"), line)
    queue.work_off(spark, line, root, handler)
    # as if the driver had been lost after the outcomes were written, before all messages were settled
    (tmp_path / "queue" / "settled" / "b.json").rename(tmp_path / "queue" / "waiting" / "b.json")
    for name in ("0", ".0.crc"):
        (tmp_path / "work" / "state" / "commits" / name).unlink()
    assert state(queue.work_off(spark, line, root, handler)) == [("a", 1, "done", "1"), ("b", 1, "done", "2")]
    assert open(ran).read() == "xx" and not list((tmp_path / "queue" / "waiting").glob("*.json"))


def test_names_of_messages(spark, tmp_path):
    for name in ("x/y", "", None, ".hidden"):
        with pytest.raises(Exception, match="not a name"):
            queue.enqueue(spark.createDataFrame([(name, 1)], "job_id string, n int"), f"{tmp_path}/queue")
    assert queue.work_off(spark, f"{tmp_path}/none", f"{tmp_path}/work", lambda job: 1).collect() == []
