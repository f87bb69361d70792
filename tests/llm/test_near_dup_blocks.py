import numpy as np

from quillspark.llm import near_dup
from quillspark.llm._common import Scratch


def test_families_of_any_size_are_compared_in_blocks(spark, monkeypatch):
    """Sets 1 and 3 are equal but share no bucket; set 2 makes them one family."""
    monkeypatch.setattr(near_dup, "_FAMILY", 0, raising=False)
    monkeypatch.setattr(near_dup, "_BLOCK_SETS", 1)
    same, other = (np.arange(a, a + 50, dtype="<u8").tobytes() for a in (0, 100))
    buckets = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 3, 1)], "key long, id long, degree long")
    sets = spark.createDataFrame([(1, bytearray(same)), (2, bytearray(other)), (3, bytearray(same))], "id long, hashes binary")
    labels = spark.createDataFrame([], "id long, root long")
    links = near_dup._apart(buckets, labels, sets, 80, Scratch(spark)).collect()
    assert {tuple(sorted((r.u, r.v))) for r in links} == {(1, 3)}
