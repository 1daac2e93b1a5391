"""Streams give what batches give."""

import shutil

from conftest import SMALL
from gatelens.operators import buckets, islands, replay
from gatelens.plans.config import Config
from gatelens.sources.tables import frames, samples
from gatelens.streaming import flows
from pyspark.sql import functions as F

CONFIG = Config(bucket_s=3600.0, baseline_window_s=86_400.0, support_tau_s=1200.0, hold_s=3600.0, episode_stall_s=14_400.0, lead_gate_max=-1, stages=("quantile_floor", "tail_spread", "run_score", "energy_floor", "score_hold"))


def run(df, tmp_path, mode="append"):
    name = f"out{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_rollup_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SMALL}/events.parquet", tmp_path / "in" / "a.parquet")
    got = run(flows.rollup(flows.read_events(spark, str(tmp_path / "in"))), tmp_path)
    got = {(r.sensor, int(r.window.start.timestamp()) // 3600, r.gate, r.chan): (r.q50, r.q90, r.n) for r in got.collect()}
    want = {(r.sensor, r.bucket, r.gate, r.chan): (r.q50, r.q90, r.n) for r in buckets.rollup(samples(spark, SMALL), 3600.0).collect()}
    last = max(k[1] for k in want)
    closed = {k: v for k, v in want.items() if k[1] < last - 1}  # the watermark withholds the end
    assert closed.items() <= got.items()


def test_detector_stream_equals_batch(spark, tmp_path):
    f = frames(spark, SMALL).withColumn("ts_mono", F.col("ts"))
    cut = f.approxQuantile("ts", [0.5], 0.0)[0]
    for name, part in (("a", f.where(F.col("ts") < cut)), ("b", f.where(F.col("ts") >= cut))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / name))
    files = sorted((tmp_path / "in").glob("*/part-*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, p in enumerate(files):
        target = flat / f"{k}.parquet"
        shutil.copy(p, target)
        import os

        os.utime(target, (1_000_000 + k, 1_000_000 + k))  # files come in time order
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    got = run(flows.detector(stream, CONFIG), tmp_path)
    want = replay.replay(frames(spark, SMALL), CONFIG)
    key = lambda df: sorted((r.sensor, r.ts, r.occupied, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want)


def test_throttle(spark, tmp_path):
    rows = [("a", i * 0.1, 20 <= i < 30, 0.0) for i in range(50)]
    spark.createDataFrame(rows, "sensor string, ts double, occupied boolean, score double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sensor string, ts double, occupied boolean, score double").parquet(str(tmp_path / "in"))
    got = sorted((round(r.ts, 1), r.occupied) for r in run(flows.throttled(stream, 1.0), tmp_path).collect())
    assert got == [(0.0, False), (1.0, False), (2.0, True), (3.0, False), (4.0, False)]


def test_bursts_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SMALL}/events.parquet", tmp_path / "in" / "a.parquet")
    got = run(flows.bursts(flows.read_events(spark, str(tmp_path / "in"))), tmp_path)
    got = {(r.sensor, round(r.session_window.start.timestamp(), 3), round(r.session_window.end.timestamp() - 1800, 3), r.peak, r.n) for r in got.collect()}
    sessions = islands.bursts(samples(spark, SMALL), 1800.0, "energy", "sensor").collect()
    known = max(r.end for r in sessions) - 600  # where the watermark stands at the end
    assert got == {(r.sensor, round(r.start, 3), round(r.end, 3), r.peak, r.n) for r in sessions if r.end + 1800 <= known} and len(got) > 500


def test_pieces_of_frames_wait_for_the_rest(spark, tmp_path):
    from gatelens.sources import wire

    frames_ = [wire.encode_report(1, 0, 0, 0, 0, 100 + i, [i] * 9, [i + 1] * 9) for i in range(6)]
    data = b"noise" + b"".join(frames_)
    cuts = [0, 20, 70, 71, 150, len(data)]
    (tmp_path / "in").mkdir()
    import os

    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = str(tmp_path / f"p{k}")
        spark.createDataFrame([("s", float(k), k, bytearray(data[a:b]))], "sensor string, ts double, id long, data binary").coalesce(1).write.parquet(part)
        target = tmp_path / "in" / f"{k}.parquet"
        shutil.copy(next((tmp_path / f"p{k}").glob("part-*.parquet")), target)
        os.utime(target, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema("sensor string, ts double, id long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flows.appended(flows.decoded(stream), str(tmp_path / "out"), str(tmp_path / "state"), None)
    q.awaitTermination(120)
    got = sorted((r.id, r.distance_cm, list(r.move), list(r.still)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(i, 100 + i, [i] * 9, [i + 1] * 9) for i in range(6)]
