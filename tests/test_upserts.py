"""A log that grows by files, read as a stream: late lines, repeated files of a key, a restart."""

from lanternrow.streaming import upserts


def test_changes_over_batches(spark, tmp_path):
    schema = "k string, at long, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    def run():
        log = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
        upserts.changes_to(upserts.upserts(log, "k", "at", ["v"]), f"{tmp_path}/rows", f"file://{tmp_path}/checkpoint").awaitTermination()
        got = upserts.fields(upserts.current(spark, f"{tmp_path}/rows", "key"), "v string").collect()
        return {r.key: (r.seq, r.last, r.v) for r in got}

    write([("a", 5, "five"), ("b", 6, "six"), ("a", 7, "seven"), ("c", None, "no place")])
    assert run() == {"a": (5, 7, "seven"), "b": (6, 6, "six")}
    # nothing new, nothing changes
    assert run() == {"a": (5, 7, "seven"), "b": (6, 6, "six")}
    # a late line keeps the latest version and moves the first place; a new version keeps the first place
    write([("a", 3, "three"), ("b", 9, None)])
    write([("d", 1, "one")])
    assert run() == {"a": (3, 7, "seven"), "b": (6, 9, None), "d": (1, 1, "one")}
