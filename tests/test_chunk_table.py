"""Upserts into a stored chunk table: its rows, and the files that are left alone."""

import glob

from sextant.operators import chunk_table as K

SCHEMA = "id string, text string, version bigint"


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(f"c{i}", f"text {i}", 0) for i in range(2000)] + [("c5", "older", -1)]
    K.create_chunks(spark.createDataFrame(rows, SCHEMA), path, buckets=64)
    before = set(glob.glob(f"{path}/*/part-*"))
    assert len({f.split("/")[-2] for f in before}) == 64
    incoming = [("c5", "new", 1), ("c5", "newest", 2), ("c7", "changed", 1), ("d1", "added", 0)]
    touched = K.merge_chunks(spark, path, spark.createDataFrame(incoming, SCHEMA), buckets=64)
    after = set(glob.glob(f"{path}/*/part-*"))
    assert 1 <= len(touched) <= 3
    assert {f.split("/")[-2] for f in before - after} == {f"_bucket={b}" for b in touched}
    assert len(before & after) == len(before) - len(before - after) and len(before & after) >= 61
    expected = {f"c{i}": f"text {i}" for i in range(2000)} | {"c5": "newest", "c7": "changed", "d1": "added"}
    assert {r["id"]: r["text"] for r in K.read_chunks(spark, path).collect()} == expected
    assert K.merge_chunks(spark, path, spark.createDataFrame([], SCHEMA), buckets=64) == []
    assert set(glob.glob(f"{path}/*/part-*")) == after
