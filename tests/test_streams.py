"""Streams against their batch twins, and reruns that add nothing."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from quillmill.operators.elements import degrade_after_failures
from quillmill.plans.ingest import PAGE, read_store
from quillmill.registry import queries, table
from quillmill.streaming import jobs

from .conftest import SF, rows_of


def test_breaker_equals_batch(spark):
    e = table(spark, SF, "events")
    batch = degrade_after_failures(e, 3, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "degraded")
    assert rows_of(queries()["st5_failure_breaker"](spark, SF)) == rows_of(batch)


def test_watermark_form_has_each_key_at_least_once(spark):
    got = queries()["st2_stream_dedup_within"](spark, SF)
    assert got.select("user_id", "event_type").distinct().count() == table(spark, SF, "events").select("user_id", "event_type").distinct().count()


def test_staged_list(spark, tmp_path):
    """What is stored leaves the folder; what failed or waits stays, and is taken by a later run that has a describer."""
    root, staged = str(tmp_path), f"{tmp_path}/in"
    schema = "book_id string, filename string, markdown string, content binary"
    rows = [("b", "a.pdf", PAGE + "Text a.", None), ("b", "x.exe", None, None), ("b", "i.png", None, bytearray(b"image")), (None, "n.pdf", PAGE + "Text n.", None)]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(staged)

    def there():
        return sorted(r.filename for r in spark.read.parquet(staged).collect())

    jobs.incremental_ingest(spark, staged, root, 10)
    assert there() == ["i.png", "x.exe"]
    assert {r.source_file for r in read_store(spark, f"{root}/store").collect()} == {"a.pdf", "n.pdf"}
    jobs.incremental_ingest(spark, staged, root, 10)
    assert there() == ["i.png", "x.exe"] and read_store(spark, f"{root}/store").count() == 2
    jobs.incremental_ingest(spark, staged, root, 10, describer=lambda s: s.map(lambda b: "a picture"))
    assert there() == ["x.exe"]
    assert {r.source_file for r in read_store(spark, f"{root}/store").collect()} == {"a.pdf", "n.pdf", "i.png"}
    assert len([p for p in (tmp_path / "archive").iterdir() if p.suffix == ".parquet"]) >= 4


def test_staged_list_after_a_crash(spark, tmp_path, monkeypatch):
    """A run that ended before its files were moved is brought to its end by the next one."""
    root, staged = str(tmp_path), f"{tmp_path}/in"
    rows = [("b", "a.pdf", PAGE + "Text a."), ("b", "x.exe", None)]
    spark.createDataFrame(rows, "book_id string, filename string, markdown string").coalesce(1).write.parquet(staged)
    tidy, calls = jobs.tidy_staged, []
    monkeypatch.setattr(jobs, "tidy_staged", lambda *a: calls.append(a) or (tidy(*a) if len(calls) == 1 else None))
    jobs.incremental_ingest(spark, staged, root, 10)
    monkeypatch.undo()
    assert spark.read.parquet(staged).count() == 2
    jobs.incremental_ingest(spark, staged, root, 10)
    assert [r.filename for r in spark.read.parquet(staged).collect()] == ["x.exe"]
    assert read_store(spark, f"{root}/store").count() == 1


def test_progress_is_written_for_each_batch(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 5 + k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = jobs.progress_counts(jobs.read_stream(spark, f"{tmp_path}/in"), "p", F.col("id") % 2 == 0)
    got = jobs.run_with_progress(seen, "p", f"{tmp_path}/cp", f"{tmp_path}/out", f"{tmp_path}/progress").orderBy("batch").collect()
    assert [(r.batch, r.rows, r.done) for r in got] == [(0, 5, 3), (1, 6, 3), (2, 7, 4)]
    spark.range(100, 104).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = jobs.progress_counts(jobs.read_stream(spark, f"{tmp_path}/in"), "p", F.col("id") % 2 == 0)
    got = jobs.run_with_progress(seen, "p", f"{tmp_path}/cp", f"{tmp_path}/out", f"{tmp_path}/progress").orderBy("batch").collect()
    assert [(r.batch, r.rows) for r in got] == [(0, 5), (1, 6), (2, 7), (3, 4)]


EVENTS = "user_id long, event_id long, ts timestamp, failed boolean"


def degraded(spark, batches, root, **options):
    """What the breaker says of events, one batch after the other: (user, event): degraded."""
    for k, batch in enumerate(batches):
        rows = [(u, e, datetime(2024, 1, 1) + timedelta(seconds=s), f) for u, e, s, f in batch]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    with jobs.keyed_state(spark):
        out = jobs.run_to_table(jobs.failure_breaker(jobs.read_stream(spark, f"{root}/in"), 2, **options), f"{root}/cp", f"{root}/out")
    return {(r.user_id, r.event_id): r.degraded for r in out.collect()}


def test_an_idle_key_is_forgotten(spark, tmp_path):
    """User 1 fails twice, is silent for longer than idle, and starts closed again; user 2 goes on failing and stays open."""
    batches = [[(1, 1, 0, True), (1, 2, 1, True), (1, 3, 2, False), (2, 1, 0, True), (2, 2, 1, True)], [(2, 3, 40, False)], [(2, 4, 80, True)], [(1, 4, 90, False), (2, 5, 91, False)]]
    kept = degraded(spark, batches, f"{tmp_path}/a")
    assert kept[1, 3] and kept[1, 4] and kept[2, 3] and kept[2, 5] and not kept[1, 2]
    idle = degraded(spark, batches, f"{tmp_path}/b", idle_ms=60_000)
    assert idle[1, 3] and not idle[1, 4]  # its state is gone
    assert idle[2, 3] and idle[2, 4] and idle[2, 5]


def test_timers_clear_state(monkeypatch):
    """The timer of an idle key clears what is kept of it; each batch moves it."""

    class Held:
        def __init__(self):
            self.value, self.timers = None, set()

        def getValueState(self, *_):  # noqa: N802
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, ms):  # noqa: N802
            self.timers.add(ms)

        def deleteTimer(self, ms):  # noqa: N802
            self.timers.remove(ms)

    held, breaker = Held(), jobs.Breaker(2, 60_000)
    breaker.init(held)
    for second in (0, 7):
        frame = pd.DataFrame({"ts": [pd.Timestamp(second, unit="s")], "event_id": [second], "failed": [True]})
        list(breaker.handleInputRows((1,), iter([frame]), None))
    assert held.timers == {67_000} and held.value == (2, True, 7_000)
    assert sum(len(f) for f in breaker.handleExpiredTimer((1,), None, None)) == 0 and held.value is None


def test_late_rows_are_left_out(spark, tmp_path):
    batches = [[(1, 1, 100, False)], [(1, 2, 101, False)], [(1, 3, 50, True), (1, 4, 102, False)]]
    got = degraded(spark, batches, str(tmp_path), idle_ms=60_000, delay="10 seconds")
    assert set(got) == {(1, 1), (1, 2), (1, 4)}


def test_a_silent_conversation_is_forgotten(spark, tmp_path):
    said = [(1, 1, 0, "the first words of a long talk"), (1, 2, 10, "more"), (1, 7, 100, "much later"), (1, 3, 101, "a lower turn")]
    for conv, turn, second, text in said:
        row = (conv, turn, "user", text, datetime(2024, 1, 1) + timedelta(seconds=second))
        spark.createDataFrame([row], "conv_id long, turn long, role string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    with jobs.keyed_state(spark):
        tail = jobs.conversation_tail_expiring(jobs.read_stream(spark, f"{tmp_path}/in"), 60_000)
        jobs.run_batches(tail, f"{tmp_path}/cp", lambda df, batch: seen.extend((r.title, r.last_turn) for r in df.collect()), "update")
    assert seen == [("the first words of a", 1), ("the first words of a", 2), ("much later", 7), ("a lower turn", 7)]
