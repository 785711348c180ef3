"""Streams against plain counts."""

import datetime as dt

from colloquy.session import new_path
from colloquy.streaming import incremental


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def test_windows_go_out_once_behind_the_watermark(spark):
    folder, out, checkpoint = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "stream")

    def arrive(*rows):
        spark.createDataFrame(list(rows), "ts timestamp, event_type string, value double").write.mode("append").parquet(folder)
        found = incremental.windows_arriving(spark, folder, out, checkpoint)
        return {(r.window_start.hour, r.event_type): (r.n, r.total) for r in found.collect()}

    assert arrive((at(0), "a", 1.0), (at(0, 59), "a", 2.0), (at(1, 5), "a", 1.0)) == {}  # the watermark stands at 0:55
    # 0:10 is late but its window is open still; 2:30 closes hours 0 and 1
    assert arrive((at(0, 10), "a", 4.0), (at(2, 30), "b", None)) == {(0, "a"): (3, 7.0), (1, "a"): (1, 1.0)}
    # both hours are written, so rows for them go
    assert arrive((at(0, 30), "a", 9.0), (at(1, 59), "c", 9.0), (at(4), "b", 1.0)) == {(0, "a"): (3, 7.0), (1, "a"): (1, 1.0), (2, "b"): (1, None)}


def test_dialogue_depth_counts_beyond_the_kept_texts(spark):
    folder, out = new_path(spark, "in"), new_path(spark, "out")
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(9)] + [(2, 0, "user", None), (2, 1, "user", "x"), (2, 1, "user", "again")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(folder)
    arriving = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(folder)
    incremental.growing_dialogues(arriving, 3).writeStream.format("parquet").option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((r.conv_id, r.turn_id, r.depth, list(r.history)) for r in spark.read.schema(incremental.DIALOGUE).parquet(out).collect())
    want = [(1, k + 1, 2 * k, [f"t{t}" for t in range(max(0, 2 * k - 3), 2 * k)]) for k in range(5)] + [(2, 1, 0, []), (2, 2, 1, [""])]
    assert got == want
