r"""Near-duplicate detection by MinHash with tensored banding.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a document's set holds its distinct
shingles of ``width`` words. Two small collections of ``m`` partial keys, each of ``k``
minhashes, are computed per set; the key of table (i, j) combines the i-th partial key of
one collection with the j-th of the other, so that m * m tables of 2k minhashes each cost
only 2mk minhashes. With m = 20 and k = 4 a pair of similarity 0.8 meets in some table with
probability above 0.9999, one of 0.9 practically always.

Equal sets are merged first. Partial keys that only one set has cannot meet and are left
out before tables are formed. Inside a table bucket sets are compared with a centre, the
set that meets most others, and then only across groups that are not yet connected: with
further centres, in the end in blocks of sets, so that no possible link stays untested
between different groups and no pair is tested inside one. Where blocks would copy sets
often, only sets that share one of their rarest shingles, as linked sets must, meet in them. Every link is confirmed on the
full sets. A centre's comparisons are dealt to parts of bounded size, each of which gets the
centre's set once; blocks hold a bounded number of sets, however large a group of copies is.
Components come from hooking and pointer jumping on tables in the shared folder.

Defined results: a document without words has an empty set and is linked with nothing; with
fewer than ``width`` words its whole word sequence is its one shingle; very long texts are
read whole; rows of one id are separate documents of that name, which keep all their links
but share one component, and all are its smallest id or none is; a row without an id has no
component and is kept; ids are integers, and others that cannot be cast to one raise Spark's
error; an empty table gives no rows. Only id and text are read; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import BoundedMemory, Scratch, mapped

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_STARS = 2
_PART_ROWS = 64  # comparisons that share one copy of a centre's set
_BLOCK_SETS = 128
_BLOCK_BYTES = 2 << 20
_COPIES = 2  # blocks to which a set goes before its family is parted by shingles


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of 64-bit shingle hashes; remembers a bounded number of word hashes."""

    def __init__(self, width: int):
        import xxhash

        self.width = width
        self.seen = BoundedMemory(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.split() parts at exactly the white space of the contract.
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        h = np.fromiter(map(self.seen.__getitem__, words), _U, len(words))
        if not len(h):
            return h
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, min(self.width, len(h)), _U)
        for k in range(min(self.width, len(h))):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def _family(m: int, k: int) -> np.ndarray:
    return _mix(np.arange(1, 2 * m * k + 1, dtype=_U) * _U(0x632BE59BD9B4E019)) | _U(1)


def partial_keys(hashes: np.ndarray, family: np.ndarray, m: int, k: int) -> np.ndarray:
    """2m keys: of the first collection, then of the second."""
    lowest = np.full(len(family), np.iinfo(_U).max, _U)
    for lo in range(0, len(hashes), 1024):
        np.minimum(lowest, (hashes[lo : lo + 1024, None] * family).min(0), out=lowest)
    parts = lowest.reshape(2 * m, k)
    out = np.arange(1, 2 * m + 1, dtype=_U)
    for j in range(k):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + parts[:, j])
    return out


def signatures(docs: DataFrame, row_key: str, text: str, width: int, m: int, k: int) -> DataFrame:
    """For each row: id, n_shingles, a 128-bit fingerprint of its set, and its partial keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, family = Shingler(width), _family(m, k)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, high, low, keys = [], [], [], []
                for t in batch.column(1).to_pylist():
                    s = shingler(t)
                    sizes.append(len(s))
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & (1 << 64) - 1) - (1 << 63))
                    keys.append(partial_keys(s, family, m, k).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "f1": pa.array(high, pa.int64()), "f2": pa.array(low, pa.int64()), "keys": pa.array(keys, pa.binary())})

    return mapped(docs.select(F.col(row_key).cast("long").alias("id"), text), run, "id long, n_shingles long, f1 long, f2 long, keys binary")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            per = len(keys) // batch.num_rows
            yield pa.RecordBatch.from_pydict({"id": np.repeat(batch.column("id").to_numpy(), per), "key": keys, "second": np.tile(np.arange(per) >= per // 2, batch.num_rows)})


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose ``key`` more than one row has; counted before the join, so no key is gathered."""
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(often, "key")


def tables(reps: DataFrame) -> DataFrame:
    """``key``, ``id``, ``n`` for the tensored buckets with ``n`` > 1 members."""
    partial = _shared(mapped(reps.select("id", "keys"), _exploded, "id long, key long, second boolean"))
    # A set has at most m keys of either kind: these lists are short.
    by_id = partial.groupBy("id").agg(F.collect_list(F.when(~F.col("second"), F.col("key"))).alias("a"), F.collect_list(F.when(F.col("second"), F.col("key"))).alias("b"))
    crossed = by_id.select("id", F.explode("a").alias("x"), "b").select("id", "x", F.explode("b").alias("y"))
    return _shared(crossed.select("id", F.xxhash64("x", "y").alias("key")))


def sets_of(docs: DataFrame, ids: DataFrame, row_key: str, text: str, width: int, scratch: Scratch) -> DataFrame:
    """``id`` and ``hashes``, the full set, of the rows named in ``ids`` (id, f1, f2, c); ``id`` is the class number ``c``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out, keep = [], []
                for i, (t, f1, f2) in enumerate(zip(*(batch.column(n).to_pylist() for n in (text, "f1", "f2")))):
                    s = shingler(t).tobytes()
                    # Of several rows with one id, that whose set is meant.
                    if xxhash.xxh3_128_intdigest(s) == (f1 + (1 << 63) << 64 | f2 + (1 << 63)):
                        out.append(s)
                        keep.append(i)
                yield pa.RecordBatch.from_pydict({"id": batch.column("c").take(pa.array(keep, pa.int64())), "hashes": pa.array(out, pa.binary())})

    named = docs.select(F.col(row_key).cast("long").alias("id"), text).join(ids, "id")
    sets = scratch.keep(mapped(named, run, "id long, hashes binary"))
    # Only wholly repeated rows give a set twice; without any, no set moves again.
    if sets.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return sets
    once = scratch.keep(sets.dropDuplicates(["id"]))
    scratch.drop(sets)
    return once


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # merges the two sorted runs
    return int((both[1:] == both[:-1]).sum())


def _confirmer(percent: int):
    """For rows sorted by (u, part) with the centre's row (no v) first: whether v is linked with u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, _U)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                us, vs, linked = [], [], []
                for u, v, h in zip(*(batch.column(n).to_pylist() for n in ("u", "v", "hashes"))):
                    y = np.frombuffer(h, _U)
                    if v is None:
                        centre = y
                        continue
                    us.append(u)
                    vs.append(v)
                    if 100 * min(len(centre), len(y)) < percent * max(len(centre), len(y)):
                        linked.append(False)
                    else:
                        n = _common(centre, y)
                        linked.append(100 * n >= percent * (len(centre) + len(y) - n))
                yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64()), "linked": pa.array(linked, pa.bool_())})

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Add ``linked`` to distinct pairs (u, v), by intersection and union of the full sets.

    The pairs of a frequent u are dealt to parts; its set goes to each part once, before the
    sets of the part's v, so that a task holds one set besides the row at hand.
    """
    degree = pairs.groupBy("u").agg(F.ceil(F.count("*") / _PART_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(degree, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    rows = dealt.join(sets.select(F.col("id").alias("v"), "hashes"), "v").select("u", "part", "v", "hashes")
    parts = degree.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    centres = parts.join(sets.select(F.col("id").alias("u"), "hashes"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "hashes")
    both = rows.unionByName(centres).repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return mapped(both, _confirmer(percent), "u long, v long, linked boolean")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id``, ``root`` for every node of the edges (u, v); the root is the smallest node reachable.

    Each node hooks to its smallest smaller neighbour; pointer jumping flattens the trees;
    edges move up to the roots, until none is left. Two nodes' rounds shrink every
    component to at most half its roots. Tables are joined by merging, never by a broadcast, and
    counted as they are written, so that a round leaves little in the driver's memory.
    """
    u, v = F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")
    left, n = scratch.counted(edges.select(u, v).where("lo < hi").distinct())
    labels = left.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumn("root", F.col("id"))
    while n["rows"]:
        hooks = left.groupBy("hi").agg(F.min("lo").alias("to"))
        n = {"moved": 1}
        while n["moved"]:
            onward = hooks.select(F.col("hi").alias("to"), F.col("to").alias("next")).hint("merge")
            jumped, n = scratch.counted(hooks.join(onward, "to", "left").select("hi", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), moved=F.col("moved"))
            scratch.drop(hooks)
            hooks = jumped
        move = lambda df, c: df.join(hooks.select(F.col("hi").alias(c), "to").hint("merge"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        new_labels = scratch.keep(move(labels, "root").select("id", "root"))
        new_left, n = scratch.counted(move(move(left, "lo"), "hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo < hi").distinct())
        for old in (labels, left, hooks):
            scratch.drop(old)
        labels, left = new_labels, new_left
    return labels


def _star(buckets: DataFrame, labels: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Pairs (u, v) of a set v with a centre u of its buckets, one for each other group at most.

    The first time, when all groups are single sets, only the best centre of each set.
    """
    b = buckets.join(labels, "id", "left").select("key", "id", "degree", F.coalesce("root", "id").alias("root"))
    centre = b.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "root")).alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "c")
    met = b.join(centre, "key").where(F.col("c.root") != F.col("root"))
    one_each = ["id"] if tested is None else ["id", "c.root"]
    best = met.groupBy(*[F.col(x).alias(f"g{i}") for i, x in enumerate(one_each)]).agg(F.max(F.struct("c.degree", "c.minus")).alias("c"))
    pairs = best.select((-F.col("c.minus")).alias("u"), F.col("g0").alias("v"))
    return pairs if tested is None else _untested(pairs, tested)


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with their group (root), of the buckets in which groups are still apart."""
    b = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    least = b.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "r0")
    return b.join(least, "key")


def _links(few: list[tuple], many: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """All links between sets (id, root, hashes) of two blocks with different roots."""
    if not few or not many:
        return
    sets = [np.frombuffer(h, _U) for _, _, h in many]
    sizes, ids, roots = np.asarray([len(x) for x in sets]), np.asarray([x[0] for x in many]), np.asarray([x[1] for x in many])
    # One inverted list of the block's hashes: a set's own hashes differ, so it meets each entry once at most.
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    for i, root, h in few:
        own = np.frombuffer(h, _U)
        able = (roots != root) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
        if not able.any():
            continue
        lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for j in ids[able & (100 * common >= percent * (sizes + len(own) - common))]:
            yield i, int(j)


def _block_links(percent: int):
    """For rows sorted by block: the links between its two sides; a block at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(sides) -> pa.RecordBatch:
            pairs = list(_links(*sides, percent))
            return pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})

        now, sides = None, ([], [])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for *key, side, i, root, h in zip(*(batch.column(n).to_pylist() for n in ("family", "x", "y", "side", "id", "root", "hashes"))):
                    if key != now:
                        yield found(sides)
                        now, sides = key, ([], [])
                    sides[side].append((i, root, h))
        yield found(sides)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets (family, id, root, hashes) to one row a shingle; equal shingles of a family have equal keys."""
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            for family, i, root, h in zip(*(batch.column(n).to_pylist() for n in ("family", "id", "root", "hashes"))):
                keys = _mix(np.frombuffer(h, _U) ^ _mix(np.full(1, family, np.int64).view(_U))).view(np.int64)
                for lo in range(0, len(keys), 1 << 16):
                    part = keys[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"key": part, "id": np.full(len(part), i), "root": np.full(len(part), root), "size": np.full(len(part), len(keys), np.int32)})


def _rare(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key``, ``id``, ``root`` of the shingles by which sets of one family can be linked over groups.

    Under one order of all shingles, linked sets share one of their first
    size - ceil(percent * size / 100) + 1. First come shingles that one group alone has, which
    link no groups and make no row, then the others, rare ones before frequent ones.
    """
    rows = mapped(members.select("family", "id", "root").join(sets, "id").select("family", "id", "root", "hashes"), _tokens, "key long, id long, root long, size int")
    met = rows.groupBy("key").agg(F.count("*").alias("often"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "often")
    of_set = Window.partitionBy("id")
    placed = (rows.join(met, "key").withColumn("alone", F.col("size") - F.count("*").over(of_set))
              .withColumn("place", F.col("alone") + F.row_number().over(of_set.orderBy("often", "key"))))
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    return placed.where(F.col("place") <= first).select("key", "id", "root")


def _families(b: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (id, root, family) of the groups that mixed buckets connect, and each family's sizes and blocks."""
    family = components(b.select(F.col("r0").alias("u"), F.col("root").alias("v")), scratch)
    members = b.select("id", "root").distinct().join(family.select(F.col("id").alias("root"), F.col("root").alias("family")), "root")
    members = scratch.keep(members.join(sets.select("id", F.length("hashes").alias("bytes")), "id"))
    groups = members.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / _BLOCK_SETS), F.ceil(F.col(size) / _BLOCK_BYTES), F.lit(1)).cast("int")
    families = (groups.groupBy("family").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("major"))
                .select("family", "n", F.col("major.root").alias("major"), (F.col("n") - F.col("major.n")).alias("m"), "bytes", (F.col("bytes") - F.col("major.bytes")).alias("m_bytes"))
                .select("family", "major", parts("n", "bytes").alias("p"), parts("m", "m_bytes").alias("q")))
    return members.drop("bytes"), scratch.keep(families)


def _apart(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between groups that still share buckets.

    Groups that buckets connect form a family. A family's sets are compared in blocks: all
    but those of its largest group with every one of another group, so the work is what the
    largest group leaves over times the family. Larger families have more blocks, of the
    same size; each set goes to all blocks of the other side, so families in which that would
    be more than ``_COPIES`` blocks are first parted by the shingles that can link them.
    """
    b, n = scratch.counted(_mixed(buckets, labels))
    if not n["rows"]:
        return b.select(F.col("id").alias("u"), F.col("id").alias("v"))
    members, families = _families(b, sets, scratch)
    wide = families.where(F.col("q") > _COPIES).select("family")
    if not wide.isEmpty():
        rare = scratch.keep(_rare(members.join(wide, "family"), sets, percent))
        closer = scratch.keep(_mixed(rare.select("key", "id"), rare.select("id", "root").distinct()))
        scratch.drop(rare)
        parted_members, parted = _families(closer, sets, scratch)
        # A family is named by a root of its own, so names stay apart.
        members = members.join(wide, "family", "left_anti").unionByName(parted_members)
        families = families.join(wide, "family", "left_anti").unionByName(parted)
    full = members.join(families, "family").join(sets, "id")

    def spread(df: DataFrame, side: int, own: str, other: str, c: str, d: str) -> DataFrame:
        dealt = df.withColumn(c, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(d, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return dealt.select("family", "x", "y", F.lit(side).alias("side"), "id", "root", "hashes")

    both = spread(full.where("root <> major"), 0, "q", "p", "x", "y").unionByName(spread(full, 1, "p", "q", "y", "x"))
    return mapped(both.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "side"), _block_links(percent), "u long, v long")


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    done = tested.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    return pairs.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v")).join(done, ["lo", "hi"], "left_anti").dropDuplicates(["lo", "hi"]).select("u", "v")


def near_duplicates(docs: DataFrame, row_key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, m: int = 20, k: int = 4) -> DataFrame:
    """One row per document: the key, n_shingles, component_id and kept.

    Documents with 100 * common >= ``percent`` * united shingles are linked; a component's
    id is its smallest document id, and that document is the one to keep.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.keep(signatures(docs, row_key, text, width, m, k))
    named = signed.where("n_shingles > 0 and id is not null")
    # Of equal sets the smallest id stands for all. Ids may repeat over classes (several texts
    # of one id), so a class has a number, which is its name until components are labelled.
    classes = scratch.keep(named.groupBy("f1", "f2").agg(F.min(F.struct("id", "keys")).alias("s")).select("f1", "f2", "s.id", "s.keys", F.monotonically_increasing_id().alias("c")))
    found = scratch.keep(tables(classes.select(F.col("c").alias("id"), "keys")))
    degree = found.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    buckets = scratch.keep(found.select("key", "id").join(degree, "id"))
    scratch.drop(found)
    members = buckets.select(F.col("id").alias("c")).distinct()
    sets = sets_of(docs, classes.select("id", "f1", "f2", "c").join(members, "c"), row_key, text, width, scratch)
    none = spark.createDataFrame([], "id long, root long")
    labels, tested = none, None
    for _ in range(_STARS):
        # Written first: they are read three times, and one plan of both is large in the driver's memory.
        pairs, n = scratch.counted(_star(buckets, labels, tested))
        if not n["rows"]:
            break
        checked, n = scratch.counted(confirmed(pairs, sets, percent), linked=F.col("linked"))
        scratch.drop(pairs)
        tested = checked if tested is None else tested.unionByName(checked)
        if n["linked"]:
            scratch.drop(labels)
            labels = components(tested.where("linked"), scratch)
    if tested is not None:
        links, n = scratch.counted(_apart(buckets, labels, sets, percent, scratch))
        if n["rows"]:
            labels = components(tested.where("linked").select("u", "v").unionByName(links), scratch)
    # Classes of one id are kept or dropped together, so their components are one.
    linked = classes.select("c", "id").join(labels.select(F.col("id").alias("c"), "root").hint("merge"), "c")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    of_ids = linked.join(least.hint("merge"), "root").groupBy("id").agg(F.min("least").alias("root"), F.max("least").alias("most"))
    labels, n = scratch.counted(of_ids, several=F.col("root") < F.col("most"))
    if n["several"]:
        labels = components(linked.join(least, "root").select(F.col("id").alias("u"), F.col("least").alias("v")), scratch)
    merged = scratch.keep(classes.select("f1", "f2", "id").join(labels, "id", "left").select("f1", "f2", F.coalesce("root", "id").alias("component_id")))
    # The result reads two light tables; all else goes now.
    scratch.drop_all_but(signed, merged)
    out = signed.select("id", "n_shingles", "f1", "f2").join(merged, ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(row_key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=2)
