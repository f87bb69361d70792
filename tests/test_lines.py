from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions.analysis import LETTERS
from quillspark.operators import index
from quillspark.sources import files, lines


@settings(max_examples=200, deadline=None)
@given(st.text("ab:, \n", max_size=60), st.integers(1, 7))
def test_pieces_do_not_matter(text, size):
    raw = text.encode()

    def joined(pieces):
        out = []
        for term, ids in lines.parsed(iter(pieces)):
            out += [(term, i) for i in ids]
        return out

    assert joined([raw[i : i + size] for i in range(0, len(raw), size)]) == joined([raw] if raw else [])


def test_lines_as_written_by_others(spark, tmp_path):
    (tmp_path / "index.txt").write_text("appl: doc1.txt, doc10.txt\nno colon\n banana: doc2.txt \nempty: \nlast: a, b, c")
    want = [("appl", "doc1.txt"), ("appl", "doc10.txt"), ("banana", "doc2.txt"), ("last", "a"), ("last", "b"), ("last", "c")]
    assert sorted(map(tuple, lines.read_lines(spark, f"{tmp_path}/index.txt").collect())) == want
    assert sorted(map(tuple, lines.read_lines(spark, str(tmp_path)).collect())) == want


def test_a_list_of_many_pieces_is_one_line(spark, tmp_path, monkeypatch):
    rows = [("every", i) for i in range(50_000)] + [("other", 7), ("ä", -1), ("every", 9)]
    path = f"{tmp_path}/i"
    # 50 runs of at most 1000 ids.
    monkeypatch.setattr(lines, "_IDS", 1000)
    lines.write_lines(spark.createDataFrame(rows, "term string, doc_id long").distinct().repartition(20), path)
    found = sorted((r.term, int(r.doc_id)) for r in lines.read_lines(spark, path).collect())
    assert found == sorted(set(rows))
    text = "".join(f.read_text() for f in sorted((tmp_path / "i").glob("part-*.txt")))
    terms = [x.split(": ")[0] for x in text.splitlines()]
    assert terms == ["every", "other", "ä"]
    ids = text.splitlines()[0].split(": ")[1].split(", ")
    assert ids == sorted(map(str, range(50_000)))
    lines.write_lines(spark.createDataFrame([], "term string, doc_id long"), path)
    assert lines.read_lines(spark, path).count() == 0


def test_spark_reads_the_lines(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    postings = index.count_postings(docs, LETTERS)
    lines.write_lines(postings, f"{tmp_path}/i")
    lists = {r.term: r.postings for r in files.read_text_index(spark, f"{tmp_path}/i").collect()}
    assert lists == {r.term: r.postings for r in index.inverted_lists(postings).collect()}
