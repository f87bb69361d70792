import io

import pytest
from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS, LETTERS_PORTER, WHITESPACE_PORTER, Analyzer
from quillspark.operators import codec, index, ranking, validation
from quillspark.operators.index import build_index
from quillspark.plans import boolean
from quillspark.plans.engine import SearchEngine, prompt
from quillspark.sources import files

# Golden scores of the ranking fixture to nine digits.
GOLDEN = {
    ("apple", "tfidf"): {"doc1": 0.400594178, "doc9": 0.267062785, "doc10": 0.133531393, "doc2": 0.133531393, "doc3": 0.133531393, "doc4": 0.133531393, "doc5": 0.133531393},
    ("apple", "bm25"): {"doc9": 0.290182735, "doc1": 0.284538448, "doc10": 0.200877709, "doc5": 0.200877709, "doc2": 0.179946891, "doc3": 0.179946891, "doc4": 0.137092946},
    ("apple", "vector"): dict.fromkeys(("doc1", "doc10", "doc2", "doc3", "doc4", "doc5", "doc9"), 1.0),
    ("rare_term", "tfidf"): {"doc5": 1.386294361, "doc8": 1.386294361},
    ("rare_term", "bm25"): {"doc5": 1.411303526, "doc8": 1.264250192},
    ("rare_term", "vector"): {"doc5": 1.0, "doc8": 1.0},
    ("apple banana", "tfidf"): {"doc2": 0.99657761, "doc1": 0.68827625, "doc10": 0.421213465, "doc3": 0.421213465, "doc4": 0.421213465, "doc5": 0.421213465, "doc9": 0.267062785},
    ("apple banana", "bm25"): {"doc2": 0.687814344, "doc1": 0.605722351, "doc10": 0.559420644, "doc5": 0.559420644, "doc3": 0.501130794, "doc4": 0.381787628, "doc9": 0.290182735},
    ("apple banana", "vector"): {"doc10": 1.0, "doc3": 1.0, "doc4": 1.0, "doc5": 1.0, "doc2": 0.960760448, "doc1": 0.871064411, "doc9": 0.421019784},
}


@pytest.fixture(scope="module")
def fixture_index(spark, tmp_path_factory):
    docs = files.ranking_docs(spark)
    return build_index(docs, WHITESPACE_PORTER, "files").write(str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def letters_index(spark, tmp_path_factory):
    return build_index(files.ranking_docs(spark), LETTERS_PORTER).write(str(tmp_path_factory.mktemp("letters")))


def test_facts_of_the_fixture(fixture_index):
    c = fixture_index.corpus
    assert (c.n_docs, c.n_files, c.total_tokens, c.avgdl) == (8, 8, 31, 3.875)
    df = {r.term: r.df for r in fixture_index.term_stats.collect()}
    assert df == {"appl": 7, "banana": 6, "rare_term": 2, "common": 2, "grape": 2, "orang": 1, "cherri": 1, "date": 1, "elderberri": 1, "fig": 1}
    assert fixture_index.postings.count() == 24
    assert [r.term for r in fixture_index.vocabulary().collect()] == sorted(df)


@pytest.mark.parametrize("query,method", list(GOLDEN))
def test_golden_scores(fixture_index, query, method):
    got = {r.doc_id: r.score for r in SearchEngine(fixture_index, method).search_any(query).collect()}
    assert got == pytest.approx({f"{d}.txt": s for d, s in GOLDEN[query, method].items()}, abs=2e-9)
    best = SearchEngine(fixture_index, method)
    first = ranking.top(best.search_any(query), 1).first()
    assert first.doc_id == f"{next(iter(GOLDEN[query, method]))}.txt" or method == "vector"


@pytest.mark.parametrize("query,want", [
    ("apple AND banana", "1 2 3 4 5 10"), ("apple banana", "1 2 3 4 5 10"), ("apple AND NOT banana", "9"), ("NOT apple", "8"),
    ("common OR grape", "3 4 8 10"), ("(apple OR common) AND NOT banana", "8 9"), ("rare_term common", "8"),
    ("apple NOT banana", "1 2 3 4 5 9 10"), ("2012", ""),
])
def test_golden_matches(letters_index, query, want):
    got = {r.doc_id for r in SearchEngine(letters_index).matches(query).collect()}
    assert got == {f"doc{x}.txt" for x in want.split()}
    q = boolean.parse(query, LETTERS_PORTER)
    if q.matches:
        assert {r.doc_id for r in boolean.set_form(q.matches, letters_index.postings, letters_index.universe()).collect()} == got


def test_strict_matches(letters_index):
    engine = SearchEngine(letters_index, mode="strict")
    assert [r.doc_id for r in engine.matches("apple NOT banana").collect()] == ["doc9.txt"]
    assert [r.doc_id for r in engine.matches("orange").collect()] == ["doc3.txt"]


def test_negated_term_in_the_query_norm(letters_index):
    r = SearchEngine(letters_index, "vector").search("apple AND NOT banana").first()
    assert (r.doc_id, r.score) == ("doc9.txt", pytest.approx(0.4210197838, abs=1e-9))


def test_methods_and_previews(letters_index):
    engine = SearchEngine(letters_index)
    assert engine.with_ranking("nonsense").method == "tfidf"
    assert {r.score for r in ranking.search(letters_index, engine.parse("apple"), "odd").collect()} == {1.0}
    rows = engine.compare("common", 5).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and all(r.ranked != "-" for r in rows)
    said = []
    asked = iter(["!ranking bm25", "apple", "!compare apple", "orange", "2012", "!ranking", "quit"])
    prompt(engine, lambda _: next(asked), said.append, 3)
    assert "ranking: bm25" in said and any("more" in s for s in said) and any("not a query" in s for s in said) and "no documents" in said


def test_codec_and_sizes(fixture_index):
    lists = index.inverted_lists(fixture_index.postings)
    appl = lists.where("term = 'appl'").first().postings
    assert appl == ["doc1.txt", "doc10.txt", "doc2.txt", "doc3.txt", "doc4.txt", "doc5.txt", "doc9.txt"]
    back = lists.select("postings", codec.decode_postings(codec.encode_postings(F.col("postings"))).alias("b")).collect()
    assert all(r.postings == r.b for r in back)
    r = codec.size_report(fixture_index.postings).first()
    assert r.compressed_size - r.original_size == 16 * 10 + 4 * 24 and r.ratio < 1
    coded = codec.encoded_index(fixture_index.postings).orderBy("term").collect()
    at = start = 0
    for i, x in enumerate(coded):
        assert (x.term_id, x.start, x.offset) == (i, start, at)
        start, at = start + len(x.term), at + len(x.data)
    whole = b"".join(bytes(x.data) for x in coded)
    chunks = codec.encoded_chunks(fixture_index.postings.repartition(7))
    rows = chunks.collect()
    assert sum(len(c.data) for c in rows) == len(whole) and all(whole[c.offset : c.offset + len(c.data)] == bytes(c.data) for c in rows)
    assert codec.decode_chunks(chunks).count() == 24
    assert codec.dictionary_string(fixture_index.postings).first().text == "".join(x.term for x in coded)


@pytest.mark.parametrize("size,blocks", [(10, 3), (30, 1), (0, 31)])
def test_blocks(fixture_index, size, blocks):
    rows = index.block_stats(fixture_index.doc_stats, size).collect()
    assert len(rows) == blocks and sum(r.n_tokens for r in rows) == 31


def test_analyzers(spark):
    text = "Don't foreign-policy café 2012\u0085x\x1cy Z_9"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(LETTERS.surface(F.col("t")).alias("w")).first().w == ["dont", "foreignpolicy", "caf", "x", "y", "z"]
    assert df.select(Analyzer("whitespace").surface(F.col("t")).alias("w")).first().w == [w.lower() for w in text.split()]
    with pytest.raises(ValueError):
        Analyzer("other")


def test_failed_and_empty_documents(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "12"), ("d", "")], "doc_id string, text string")
    i = build_index(docs, LETTERS)
    c = i.corpus
    assert (c.n_docs, c.n_files, c.total_tokens, c.avgdl) == (1, 4, 2, 0.5)
    assert {r.doc_id: r.dl for r in i.doc_stats.collect()} == {"a": 2, "b": 1, "c": 0, "d": 0}
    assert [r.doc_id for r in SearchEngine(i).matches("NOT z").collect()] == ["a"]
    none = build_index(docs.limit(0), LETTERS)
    assert none.corpus.avgdl == 0 and SearchEngine(none, "bm25").search("x").count() == 0


def test_files_and_text_index(spark, tmp_path, fixture_index):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.txt").write_text("apple pie")
    (d / "b.txt").write_bytes(b"ba\xffnana")
    assert files.list_files(spark, str(d)).count() == 2
    got = {r.doc_id.split("/")[-1]: r.text for r in files.read_corpus(spark, str(d)).collect()}
    assert got == {"a.txt": "apple pie", "b.txt": "banana"}
    assert {r.text for r in files.read_quarantined(spark, str(d)).collect()} == {"apple pie", None}
    with pytest.raises(Exception):
        files.read_corpus(spark, str(d), strict=True).collect()
    files.write_text_index(fixture_index.postings, str(tmp_path / "text"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "text")).collect()]
    assert len(lines) == 10 and "grape: doc3.txt, doc4.txt" in lines
    (tmp_path / "odd").write_text("no colon\nterm: b: c, d\n")
    assert [tuple(r) for r in files.read_text_index(spark, str(tmp_path / "odd")).collect()] == [("term", ["b: c", "d"])]
    assert files.text_index_postings(files.read_text_index(spark, str(tmp_path / "text"))).count() == 24
    (tmp_path / "c.ini").write_text("[Settings]\ninput_directory = x\nblock_size = 5\noutput_file = y\n")
    assert files.read_settings(str(tmp_path / "c.ini")) == files.Settings("x", 5, "y")


def test_validation(spark, fixture_index):
    engine = SearchEngine(fixture_index)
    checks = [r for m in validation.SCORED for q in ("apple", "rare_term", "apple banana") for r in validation.validate_principles(engine.with_ranking(m), q).collect()]
    assert checks and all(r["pass"] for r in checks)
    stats = validation.score_stats(validation.all_scores(engine, ["apple banana"], ["vector"])).first()
    assert stats.in_unit_range and stats.distinct_scores
    runs = [SearchEngine(fixture_index, "bm25").top("apple", 5) for _ in range(2)]
    assert validation.stability_score(runs) == 1.0
    f = {r.doc_id: r for r in validation.doc_features(files.ranking_docs(spark), {"apple": "apple", "rare_term": "rare_term"}, "rare_term").collect()}
    assert (f["doc1.txt"].apple_count, f["doc5.txt"].has_rare_term, f["doc4.txt"].unique_terms) == (3, True, 7)
    assert validation.method_latency(engine, ["apple"], ["bm25", "none"]).count() == 2
    assert validation.peak_memory_mb() > 1
    layouts = {"rows": lambda q: fixture_index.term_postings(q), "lists": lambda q: index.inverted_lists(fixture_index.postings).where(F.col("term") == q)}
    assert validation.compare_layouts(layouts, ["banana"], spark).count() == 2


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [sorted((r.doc_id, round(r.score, 9)) for r in SearchEngine(build_index(docs.repartition(n), LETTERS), "bm25").search("this with").collect()) for n in (1, 5)]
    assert rows[0] == rows[1] and all(s >= 0 for _, s in rows[0])


def test_pushdown_of_terms(letters_index):
    plan = SearchEngine(letters_index).search("apple AND banana")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [appl,banana])]" in plan


def test_segments_replace_earlier_versions(spark, tmp_path):
    from quillspark.streaming.segments import compact, index_stream, read_segments

    source, path = tmp_path / "in", str(tmp_path / "seg")
    schema = "doc_id string, text string"
    for batch in ([("a", "apple pie"), ("b", "banana")], [("a", "apple tart")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        index_stream(spark.readStream.schema(schema).parquet(str(source)), path, str(tmp_path / "cp"), LETTERS).awaitTermination()
    i = read_segments(spark, path, LETTERS)
    assert {(r.term, r.doc_id) for r in i.postings.collect()} == {("apple", "a"), ("tart", "a"), ("banana", "b")}
    assert compact(spark, path, str(tmp_path / "out"), LETTERS).corpus.n_docs == 2


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """Build if missing, search, compare methods, prompt: all from one settings file."""
    from quillspark.__main__ import main

    monkeypatch.setattr(spark, "stop", lambda: None)
    docs = tmp_path / "mail"
    docs.mkdir()
    (docs / "a.txt").write_text("apple pie with cream")
    (docs / "b.txt").write_text("apple tart")
    (tmp_path / "c.ini").write_text(f"[Settings]\ninput_directory = {docs}\nblock_size = 5\noutput_file = {tmp_path}/index.txt\n")
    config = str(tmp_path / "c.ini")
    main(["index", config])
    assert (tmp_path / "index.txt.tables").is_dir()
    main(["search", config, "apple", "AND", "cream", "--ranking", "bm25"])
    assert "a.txt" in capsys.readouterr().out
    main(["bench", config, "apple"])
    assert "mean_seconds" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("apple\n!quit\n"))
    main(["search", config])
    out = capsys.readouterr().out
    assert "a.txt" in out and "b.txt" in out


def test_memory_and_written_files(spark, tmp_path):
    rows = validation.executor_memory(spark).collect()
    assert rows and all(r.heap_mb >= 0 for r in rows)
    texts = spark.createDataFrame([("x", bytearray(b"ba\xffnana")), ("y", bytearray("\u00e9 a".encode()))], "name string, content binary")
    files.write_files(texts, str(tmp_path / "f"))
    got = {r.doc_id.split("name=")[1][0]: r.text for r in files.read_corpus(spark, str(tmp_path / "f" / "*")).collect()}
    assert got == {"x": "banana\n", "y": "\u00e9 a\n"}
    assert {r.text for r in files.read_quarantined(spark, str(tmp_path / "f" / "*")).collect()} == {None, "\u00e9 a\n"}


def test_running_sums(spark):
    from quillspark.operators.running import running_sums

    df = spark.range(5000).selectExpr("id * 7 % 5000 as k", "id % 11 as n").repartition(6)
    got = sorted((r.k, r.n, r.before) for r in running_sums(df, ["k"], {"before": "n"}).collect())
    total = 0
    for k, n, before in got:
        assert before == total
        total += n
    assert running_sums(df.limit(0), ["k"], {"before": "n"}).count() == 0
