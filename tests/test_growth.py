"""Steps whose shuffles and memory must grow no faster than their input."""

from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS_PORTER
from quillspark.operators import codec, index
from quillspark.sources import binary, lines

TEXTS = [(1, "Running runs, a RUN!"), (2, " 12 "), (3, None), (4, "cats cat"), (4, "cat")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stems_move_no_rows(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    words = index.counted_words(docs, LETTERS_PORTER)
    assert "Join" not in _plan(words) and _plan(words).count("Exchange") == 1
    assert sorted(map(tuple, words.where("doc_id < 4").collect()), key=str) == [
        ("a", 1, 1, 4, False), ("run", 1, 3, 4, False), (None, 2, 1, 0, False), (None, 3, 1, 1, True)]
    assert "Join" not in _plan(index.count_postings(docs.where("doc_id < 4"), LETTERS_PORTER))
    built = index.build_index(docs, LETTERS_PORTER).write(f"{tmp_path}/i")
    assert sorted(map(tuple, built.postings.select("term", "doc_id", "tf").collect())) == [("a", 1, 1), ("cat", 4, 3), ("run", 1, 3)]
    assert sorted(map(tuple, built.doc_stats.collect())) == [(1, 4, False), (2, 0, False), (3, 1, True), (4, 2, False)]


def test_without_repeated_ids_nothing_is_added_up(spark, tmp_path, monkeypatch):
    added = []
    whole = index._added_up
    monkeypatch.setattr(index, "_added_up", lambda df: added.append(1) or whole(df))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    one = index.build_index(docs.where("doc_id < 4"), LETTERS_PORTER).write(f"{tmp_path}/one")
    assert not added and one.postings.count() == 2
    index.build_index(docs, LETTERS_PORTER).write(f"{tmp_path}/two")
    assert added and one.term_stats.agg(F.sum("cf")).first()[0] == 4


def test_ranges_of_lines_have_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE_ROWS", 100)
    rows = spark.range(5000).selectExpr("concat('t', id % 500) as term", "id as doc_id")
    lines.write_lines(rows, f"{tmp_path}/l")
    sizes = [sum(x.count(",") + 1 for x in f.read_text().splitlines()) for f in (tmp_path / "l").glob("part-*")]
    assert sum(sizes) == 5000 and len(sizes) > 30 and max(sizes) < 400
    assert lines.read_lines(spark, f"{tmp_path}/l").distinct().count() == 5000


def test_short_lists_are_written_without_arrays(monkeypatch):
    lists = [[5], [-3, 7], [-(2**63), 2**63 - 1], [1, 2, 400, 10**12], list(range(0, 9000, 600))]
    monkeypatch.setattr(binary, "_FEW", 0, raising=False)
    arrays = [binary._entry(b"abc", b"abd", ids) for ids in lists]
    monkeypatch.undo()
    monkeypatch.setattr(binary, "varints", None)
    assert [binary._entry(b"abc", b"abd", ids) for ids in lists] == arrays
    assert [list(binary._entries(binary._entry(b"", b"ab", ids), True)) for ids in lists] == [[(b"ab", ids)] for ids in lists]


def test_chunks_are_placed_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE_ROWS", 300)
    # One term over many ranges, between others; one pair twice.
    postings = spark.range(6000).selectExpr("if(id % 3 = 0, concat(if(id % 2 = 0, 'a', 'z'), id), 'hot') as term", "id as doc_id")
    chunks = codec.encoded_chunks(postings.unionByName(postings.where("doc_id = 1")))
    assert _plan(codec.decode_chunks(chunks)).count("SortMergeJoin") == 0
    rows = chunks.orderBy("offset").collect()
    hot = [r for r in rows if r.term == "hot"]
    assert len(hot) > 10 and [r.first for r in hot] == [True] + [False] * (len(hot) - 1)
    whole = b"".join(bytes(r.data) for r in codec.encoded_index(postings).orderBy("term").collect())
    assert b"".join(bytes(r.data) for r in rows) == whole
    assert [r.offset for r in rows] == [sum(len(x.data) for x in rows[:i]) for i in range(len(rows))]
    got = codec.decode_chunks(chunks)
    want = postings.selectExpr("term", "cast(doc_id as string) as doc_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
