import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldlab.operators import catalogue as catalogue_ops
from fieldlab.operators import sync
from fieldlab.sources import push
from fieldlab.streaming import catalogue as C
from fieldlab.streaming import keyed as K

ROW = "uuid string, seq long, updated_at string, deleted boolean, texture_class string, confidence_score double, address string"


def follow(spark, log, root):
    K.follow_catalogue(C.read_changes(spark, log, ROW), root).awaitTermination()


def test_catalogue_follows_the_log(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "root")
    add = lambda *rows: spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(log)
    add(("a", 1, "2026-01-01T00:00:00Z", False, "x", 0.5, "p"), ("b", 2, "2026-01-01T00:00:00Z", False, "y", 0.7, "q"))
    follow(spark, log, root)
    K.follow_stats(spark, root).awaitTermination()
    assert {r["uuid"] for r in C.live_view(K.catalogue(spark, root)).collect()} == {"a", "b"}
    add(("a", 3, "2025-01-01T00:00:00Z", False, "old", 0.1, "p"), ("b", 4, "2026-01-02T00:00:00Z", True, "y", 0.7, "q"), ("c", 5, "2026-01-01T00:00:00Z", False, "z", None, "q"))
    follow(spark, log, root)
    K.follow_stats(spark, root).awaitTermination()
    rows = {r["uuid"]: (r["id"], r["texture_class"]) for r in C.live_view(K.catalogue(spark, root)).collect()}
    assert rows == {"a": (1, "x"), "c": (5, "z")}
    assert tuple(K.stats(spark, root).first()) == (2, 2, 0.5)
    told = sorted((r["uuid"], r["version"], r["deleted"], r["was_deleted"]) for r in K.changed_records(spark, root).collect())
    assert told == [("a", 1, False, None), ("b", 1, False, None), ("b", 2, True, False), ("c", 1, False, None)]  # what lost is not told


def test_every_batch_equals_the_batch_operators(spark, tmp_path):
    """Inserts, updates, moves of address, tombstones and ties, one batch after another, each with a restart from the checkpoint."""
    rng, log, root = random.Random(5), str(tmp_path / "log"), str(tmp_path / "root")
    nothing = spark.createDataFrame([], "uuid string, id long, updated_at string, deleted boolean, texture_class string, confidence_score double, address string")
    seen, seq = [], 0
    for batch in range(3):
        rows = []
        for _ in range(120):
            seq += 1
            rows.append((f"u{rng.randint(0, 40)}", seq, f"2026-01-{rng.randint(1, 9 + 5 * batch):02}T00:00:00Z", rng.random() < 0.3, rng.choice("xyz"), rng.choice([None, 0.125, 0.3, 0.9]), rng.choice([None, "", "Localização não disponível", "p", "q", "r", f"s{rng.randint(0, 9)}"])))
        rows[0] = (*rows[0][:3], None, *rows[0][4:])  # an unknown tombstone flag is none
        seen += rows
        spark.createDataFrame(rows, ROW).coalesce(2).write.mode("append").parquet(log)
        follow(spark, log, root)
        K.follow_stats(spark, root).awaitTermination()
        whole = sync.lww_merge(nothing, spark.createDataFrame(seen, ROW).withColumn("deleted", F.coalesce("deleted", F.lit(False))))
        names = ["uuid", "updated_at", "deleted", "texture_class", "confidence_score", "address"]
        now = K.catalogue(spark, root)
        assert Counter(map(tuple, now.select(*names).collect())) == Counter(map(tuple, whole.select(*names).collect()))
        a, b = K.stats(spark, root).first(), catalogue_ops.home_stats(whole).first()
        assert (a["total"], a["addresses"]) == (b["total"], b["addresses"]) and a["mean_confidence"] == pytest.approx(b["mean_confidence"], abs=1e-12)
    changed = K.changed_records(spark, root).count()
    assert changed < len(seen) and now.count() <= 41


# --- pushes ---------------------------------------------------------------------


class Refusing(push.FolderBackend):
    """Refuses one key as long as a file says so, and counts how often each key came."""

    def _once(self, key, body):
        import os
        import uuid

        os.makedirs(f"{self.root}/asked", exist_ok=True)
        open(f"{self.root}/asked/{key}_{uuid.uuid4().hex}", "x").close()
        if os.path.exists(f"{self.root}/refuse-{key}"):
            raise ConnectionError("refused")
        return super()._once(key, body)


KIND = "id long, record_uuid string, operation string, status string"
BACKEND = "test_streaming:Refusing"


def asked(root):
    import os

    return Counter(int(x.split("_")[0]) for x in os.listdir(f"{root}/backend/asked"))


@pytest.fixture
def records(spark):
    rows = spark.createDataFrame([("a", "old", "pending"), ("b", None, "pending"), ("c", None, "synced")], "uuid string, remote_id string, sync_status string")
    return rows.withColumns({"deleted": F.lit(False), "texture_class": F.lit("x"), "updated_at": F.lit("t")})


@pytest.fixture(autouse=True)
def backend_of_the_tests(spark):
    spark.sparkContext.addPyFile(__file__)


def test_operations_are_pushed_once(spark, records, tmp_path):
    told = [[(1, "a", "upsert", "pending"), (2, "b", "delete", "pending")], [(1, "a", "upsert", "pending"), (3, "gone", "upsert", "pending"), (4, "c", "upsert", "synced")]]
    root, log = str(tmp_path / "out"), str(tmp_path / "log")
    for rows in told:  # a run each
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(log)
        C.follow_outbox(C.read_changes(spark, log, KIND), records, root, BACKEND, f"{root}/backend").awaitTermination()
    assert sorted(r["id"] for r in C.pushed_log(spark, root).collect()) == [1, 2, 3]
    assert asked(root) == {1: 1, 2: 1}  # the orphan pushes nothing
    after = {r["uuid"]: (r["remote_id"], r["sync_status"]) for r in C.drained_records(records, root).collect()}
    assert after == {"a": ("remote-a", "synced"), "b": (None, "synced"), "c": (None, "synced")}
    ops = spark.createDataFrame([*told[0], *told[1][1:], (9, "b", "upsert", "pending")], KIND)
    assert {r["id"]: r["status"] for r in C.drained_outbox(ops, root).collect()} == {1: "synced", 2: "synced", 3: "synced", 4: "synced", 9: "pending"}


@pytest.mark.parametrize("stream", [False, True])
def test_a_failing_operation_stops_the_run(spark, records, tmp_path, stream):
    """What was pushed stays pushed, the rest pending; a second run pushes only the rest."""
    root, log = str(tmp_path / "out"), str(tmp_path / "log")
    ops = spark.createDataFrame([(i, "a", "upsert", "pending") for i in range(6)] + [(6, "b", "delete", "pending")], KIND)
    ops.coalesce(1).write.parquet(log)
    (tmp_path / "out" / "backend").mkdir(parents=True)
    refuse = tmp_path / "out" / "backend" / "refuse-3"
    refuse.touch()

    def run():
        if stream:
            C.follow_outbox(C.read_changes(spark, log, KIND), records, root, BACKEND, f"{root}/backend").awaitTermination()
        else:
            C.push_outbox(ops, records, root, BACKEND, f"{root}/backend")

    with pytest.raises(Exception, match="operation 3: ConnectionError: refused"):
        run()
    assert {r["id"]: r["status"] for r in C.drained_outbox(ops, root).collect()} == {0: "synced", 1: "synced", 2: "synced", 3: "pending", 4: "pending", 5: "pending", 6: "synced"}
    refuse.unlink()
    run()
    assert {r["status"] for r in C.drained_outbox(ops, root).collect()} == {"synced"}
    assert asked(root) == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1}


def test_a_repeated_task_pushes_only_what_is_left(spark, tmp_path, monkeypatch):
    """A task's journals, not its memory, say what it has pushed."""
    from pyspark import TaskContext
    from pyspark.sql import Row

    class Task:
        attempt = 0

        def partitionId(self):
            return 4

        def taskAttemptId(self):
            self.attempt += 1
            return self.attempt

    task = Task()
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: task))
    monkeypatch.setattr(push, "JOURNAL_EVERY", 2)
    root = str(tmp_path / "out")
    options = {"root": root, "backend": BACKEND, "argument": f"{root}/backend", "run": "r"}
    rows = [Row(id=i, record_uuid="a", operation="upsert", orphan=False) for i in range(5)]

    def lost():
        yield from rows[:3]
        raise SystemError("executor lost")

    with pytest.raises(SystemError):
        push.PushWriter(options).write(lost())
    assert push.PushWriter(options).write(iter(rows)) == push.TaskDone(3)  # 0 and 1 were written down
    assert asked(root) == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1}
    assert push.FolderBackend(f"{root}/backend").upsert("2", {"record_uuid": "other"}) == "remote-a"  # known by its key


class RefusingBulk(push.BundleBackend):
    """Does a request up to a key, as long as a file says that it refuses it."""

    def push(self, operations):
        import os

        keys = [key for key, _, _ in operations]
        stop = next((i for i, key in enumerate(keys) if os.path.exists(f"{self.root}/refuse-{key}")), None)
        yield from super().push(operations[:stop]) if stop != 0 else ()
        if stop is not None:
            raise ConnectionError("refused")


def in_folder(spark, root):
    return sorted((int(r["key"]), r["operation"], r["remote_id"]) for r in spark.read.parquet(f"{root}/backend/*.parquet").collect())


def test_many_operations_are_a_request_and_a_file(spark, records, tmp_path):
    """Files grow with tasks and requests, not with operations."""
    root = str(tmp_path / "out")
    ops = spark.createDataFrame([(i, "a" if i % 2 else "b", "upsert" if i % 3 else "delete", "pending") for i in range(1000)] + [(1000, "gone", "upsert", "pending")], KIND)
    C.push_outbox(ops, records, root, "fieldlab.sources.push:BundleBackend", f"{root}/backend", "r")
    assert in_folder(spark, root) == [(i, "upsert", "remote-" + "ba"[i % 2]) if i % 3 else (i, "delete", None) for i in range(1000)]
    assert {r["status"] for r in C.drained_outbox(ops, root).collect()} == {"synced"}
    assert C.pushed_log(spark, root).count() == 1001
    files = lambda where: [p for p in (tmp_path / "out" / where).glob("*.parquet")]
    assert len(files("backend")) <= 4 + 1000 // push.JOURNAL_EVERY
    assert len(files("pushed/run=r")) <= 4  # a journal a task, of five entries and more


def test_a_request_fails_in_its_middle(spark, records, tmp_path):
    root = str(tmp_path / "out")
    ops = spark.createDataFrame([(i, "a", "upsert", "pending") for i in range(5)] + [(5, "gone", "upsert", "pending"), (6, "b", "delete", "pending")], KIND)
    refuse = tmp_path / "out" / "backend" / "refuse-3"
    refuse.parent.mkdir(parents=True)
    refuse.touch()
    run = lambda: C.push_outbox(ops, records, root, "test_streaming:RefusingBulk", f"{root}/backend", "r")
    with pytest.raises(Exception, match="operation 3: ConnectionError: refused"):
        run()
    status = {r["id"]: r["status"] for r in C.drained_outbox(ops, root).collect()}
    assert [status[i] for i in range(5)] == ["synced"] * 3 + ["pending"] * 2
    refuse.unlink()
    run()
    assert {r["status"] for r in C.drained_outbox(ops, root).collect()} == {"synced"}
    assert [key for key, _, _ in in_folder(spark, root)] == [0, 1, 2, 3, 4, 6]  # each once


def test_a_request_that_comes_again_finds_its_file(tmp_path):
    backend = push.BundleBackend(str(tmp_path))
    asked = [("1", "upsert", {"record_uuid": "a"}), ("2", "delete", {"record_uuid": "b"})]
    assert list(backend.push(asked)) == list(backend.push(asked)) == ["remote-a", None]
    assert len(list(tmp_path.iterdir())) == 1


def test_the_drain_takes_as_many_batches_at_any_size(spark, sf_dir, tmp_path, monkeypatch):
    """Each batch looks at all records, so files told twice must not grow with the partitions of the input."""
    from fieldlab.plans import streams

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(24).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    root = str(tmp_path / "root")
    monkeypatch.setattr(streams, "scratch", lambda spark, label: root)
    monkeypatch.setattr(C, "follow_outbox", lambda *a: (_ for _ in ()).throw(InterruptedError))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        with pytest.raises(InterruptedError):
            streams.QUERIES["stream_outbox_drain"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list((tmp_path / "root" / "log").glob("*.parquet"))) <= 6
