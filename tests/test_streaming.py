"""A stream of edits ends with the points that the batch gives; bursts of changes are the same too."""

import random

from pyspark.sql import functions as F

from fieldspark.plans import derived as d
from fieldspark.streaming import edits as ed

SMALL = "/root/testdata/sf0.001"


def run(df, name, mode, tmp_path):
    job = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
    job.processAllAvailable()
    job.stop()
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    edits = d.edits(spark, SMALL)
    n = edits.count()
    for i in range(3):
        edits.where(f"seq >= {i * n // 3} and seq < {(i + 1) * n // 3}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    rows = run(ed.replay_stream(stream), "points", "update", tmp_path).collect()
    last = {}
    for r in rows:
        last[r.field_id] = max(last.get(r.field_id, -1), r.seq)
    got = {(r.field_id, r.fid, r.x, r.y) for r in rows if r.seq == last[r.field_id]}
    batch = {tuple(r) for r in ed.replay(edits).collect()}
    fields_with_points = {r[0] for r in batch}
    assert {r for r in got if r[0] in fields_with_points} == batch

    changes = stream.withColumnRenamed("action", "value")
    bursts = run(ed.debounce(changes, "4 hours", "0 seconds", by="field_id"), "bursts", "append", tmp_path)
    closed = {tuple(r) for r in bursts.collect()}
    whole = {tuple(r) for r in ed.debounce(edits.withColumnRenamed("action", "value").withColumn("ts", F.col("ts").cast("timestamp")), "4 hours", by="field_id").collect()}
    assert closed and closed <= whole


class _Map:
    """Keyed state as the stream has it, which counts what is written."""

    def __init__(self):
        self.rows, self.writes = {}, 0

    def containsKey(self, key):  # noqa: N802
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        return self.rows[key]

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value
        self.writes += 1

    def removeKey(self, key):  # noqa: N802
        del self.rows[key]
        self.writes += 1


def test_keyed_state_equals_one_replay():
    """Random edits in micro-batches, with and without a bound on undo; what is written follows the edits."""
    rng = random.Random(3)
    for max_undo in (None, 1, 7):
        whole, points, steps = ed.Replay(max_undo=max_undo), _Map(), _Map()
        following, bottom, top = 0, 0, 0
        for _ in range(150):
            batch = [(rng.choice(["add", "move", "delete", "undo", "undo"]), rng.choice([None, *range(12)]), rng.random(), rng.random()) for _ in range(rng.randint(0, 12))]
            p, s = ed._Points(points), ed._Stack(steps, bottom, top, max_undo)
            field = ed.Replay(p, s, following)
            for edit in batch:
                whole.apply(*edit)
                field.apply(*edit)
            before = points.writes + steps.writes
            p.written()
            (bottom, top), following = s.written(), field.following
            assert points.writes + steps.writes - before <= 3 * len(batch)
            assert {k[0]: v for k, v in points.rows.items()} == whole.points
            assert top - bottom == len(whole.stack) and sorted(steps.rows) == [(k,) for k in range(bottom, top)]


def test_five_thousand_undos_on_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    n = 5000
    kind = F.when(F.col("id") < n, "add").when(F.col("id") < 2 * n - 10, "undo").otherwise("move")
    edits = spark.range(2 * n).select(F.lit(1).cast("long").alias("field_id"), F.col("id").alias("seq"), kind.alias("action"), (F.col("id") % 7).alias("fid"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    for i in range(4):
        edits.where(f"seq >= {i * n // 2} and seq < {(i + 1) * n // 2}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    rows = run(ed.replay_stream(stream), "deep", "update", tmp_path).collect()
    last = max(r.seq for r in rows)
    batch = {tuple(r) for r in ed.replay(edits).collect()}
    assert {(r.field_id, r.fid, r.x, r.y) for r in rows if r.seq == last} == batch and len(batch) == 10
    changes = run(ed.replay_stream(stream, only_changes=True), "changes", "update", tmp_path).collect()
    now = {}
    for r in sorted(changes, key=lambda r: r.seq):
        now[r.field_id, r.fid] = (r.x, r.y) if r.alive else None
    assert {(f, i, *p) for (f, i), p in now.items() if p} == batch
    assert len([r for r in changes if r.seq == last]) <= n // 2
