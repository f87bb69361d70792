"""Families that are parted by their rare shingles, against brute force."""

import random

import numpy as np
import pytest

from quillspark.llm import near_dup
from quillspark.llm._common import Scratch


def _family(spark, sets):
    """All sets share one bucket, so they are one family, each a group of its own."""
    buckets = spark.createDataFrame([(1, i, 1) for i in sets], "key long, id long, degree long")
    rows = spark.createDataFrame([(i, bytearray(np.asarray(sorted(s), "<u8").tobytes())) for i, s in sets.items()], "id long, hashes binary")
    return buckets, rows


def _brute(sets, percent, root):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def _linked(spark, sets, percent, labels=()):
    buckets, rows = _family(spark, sets)
    found = near_dup._apart(buckets, spark.createDataFrame(list(labels), "id long, root long"), rows, percent, Scratch(spark)).collect()
    return {tuple(sorted((r.u, r.v))) for r in found}


@pytest.mark.parametrize("percent", [50, 80, 100])
@pytest.mark.parametrize("grouped", [False, True])
def test_parted_families_lose_no_link(spark, monkeypatch, percent, grouped):
    monkeypatch.setattr(near_dup, "_COPIES", 0)
    monkeypatch.setattr(near_dup, "_BLOCK_SETS", 5)
    rng = random.Random(percent)
    core = list(range(40))
    sets = {}
    for i in range(60):
        own = rng.choice([0, 1, 3, 5, 9, 20])
        sets[i] = set(rng.sample(core, rng.choice([30, 36, 39, 40]))) | {1000 * (i % rng.choice([3, 60])) + 500 + j for j in range(own)}
    sets[60], sets[61] = {7}, {7}
    root = (lambda i: i % 4) if grouped else (lambda i: i)
    assert _linked(spark, sets, percent, [(i, root(i)) for i in sets] if grouped else []) == _brute(sets, percent, root)


def test_sets_with_a_common_part_are_not_compared(spark, monkeypatch):
    """100 of 160 shingles are in all sets, and nothing is linked: no set goes to a block."""
    monkeypatch.setattr(near_dup, "_BLOCK_SETS", 8)
    compared = []
    families = near_dup._families

    def watched(b, sets, scratch):
        members, sizes = families(b, sets, scratch)
        compared.append(members.count())
        return members, sizes

    monkeypatch.setattr(near_dup, "_families", watched)
    sets = {i: set(range(100)) | set(range(1000 * (i + 1), 1000 * (i + 1) + 60)) for i in range(200)}
    sets[200], sets[201] = set(range(90)) | set(range(10**6, 10**6 + 70)), set(range(90)) | set(range(10**6, 10**6 + 68))
    assert _linked(spark, sets, 80) == {(200, 201)}
    assert compared == [202, 2]
