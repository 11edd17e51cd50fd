"""Sets of result tables change all at once."""

import pytest
from pyspark.sql import functions as F

from cohortlab.sources import result_sets as R


def test_readers_see_whole_sets_only(spark, tmp_path):
    root = str(tmp_path)
    assert R.current_set(spark, root) is None
    with pytest.raises(FileNotFoundError):
        R.read_result(spark, root, "a")
    assert R.write_set(spark, root, {"a": spark.range(3), "b": spark.range(4)}) == 1
    first = R.current_set(spark, root)
    reading = R.read_result(spark, root, "a")

    # half of the next set is there, then its writer fails
    folder = R.new_set(root)
    spark.range(100).write.parquet(f"{folder}/a")
    assert R.current_set(spark, root) == first and R.read_result(spark, root, "a").count() == 3
    with pytest.raises(Exception, match="boom"):
        R.write_set(spark, root, {"a": spark.range(7), "b": spark.range(2).select(F.raise_error(F.lit("boom")).alias("x"))})
    assert R.current_set(spark, root) == first and R.read_result(spark, root, "b").count() == 4

    # a set made of the current one
    assert R.write_set(spark, root, {"a": R.read_result(spark, root, "a").unionByName(spark.range(5)), "b": spark.range(0)}) == 2
    assert R.read_result(spark, root, "a").count() == 8 and R.read_result(spark, root, "b").count() == 0
    assert reading.count() == 3                               # begun before, ends on its own set

    R.write_set(spark, root, {"a": spark.range(1)})
    assert [n for n, _ in R._published(spark, root)] == [2, 3] and not (tmp_path / "sets" / first.rsplit("/", 1)[1]).exists()
    assert (tmp_path / "sets" / folder.rsplit("/", 1)[1]).exists()


def test_two_writers_at_once(spark, tmp_path):
    root = str(tmp_path)
    folders = [R.new_set(root) for _ in range(2)]
    for i, f in enumerate(folders):
        spark.range(i + 1).write.parquet(f"{f}/a")
    (tmp_path / "published").mkdir()
    for f in folders:                                         # both took the same number
        (tmp_path / "published" / f"{1:012d}.{f.rsplit('/', 1)[1]}").touch()
    assert R.current_set(spark, root) == max(folders) and R.publish(spark, R.new_set(root)) == 2
