import os

import pytest

from quillspark.sources import folder


def test_every_name_is_seen_and_every_problem_told(spark, tmp_path):
    contents = {
        "a.txt": "plain\n".encode(), ".hidden": "é".encode(), "_also": b"", "latin.txt": "für".encode("latin-1"), "cut.txt": "é".encode()[:1],
        "long.txt": b"x" * 101, "edge.txt": b"x" * 100, "zip.gz": b"\x1f\x8b not unpacked"}
    path = f"{tmp_path}/in"
    folder.write_folder(spark.createDataFrame(list(contents.items()), "name string, content binary").repartition(3), path)
    os.symlink(f"{path}/nowhere", f"{path}/dangling")
    os.makedirs(f"{path}/below")
    (tmp_path / "in" / "below" / "deep.txt").write_text("deep")
    listed = {os.path.basename(r.path): r.length for r in folder.list_folder(spark, path).collect()}
    assert {k: v for k, v in listed.items() if k != "dangling"} == {k: len(v) for k, v in contents.items()}
    got = {os.path.basename(r.path): r for r in folder.read_folder(spark, path, most_bytes=100).collect()}
    assert all((r.text is None) != (r.problem is None) for r in got.values())
    assert got["a.txt"].text == "plain\n" and got[".hidden"].text == "é" and got["_also"].text == "" and len(got["edge.txt"].text) == 100
    assert got["latin.txt"].problem == "not UTF-8: invalid start byte at position 1"
    assert got["cut.txt"].problem == "not UTF-8: unexpected end of data at position 0"
    assert got["long.txt"].problem == "longer than 100 bytes" and "not UTF-8" in got["zip.gz"].problem
    assert "deep.txt" in {os.path.basename(r.path) for r in folder.list_folder(spark, path, recursive=True).collect()}


def test_a_file_that_goes_away_is_told(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    reader = folder._Reader(str(tmp_path), False, 100)
    parts = reader.partitions()
    os.remove(tmp_path / "a")
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert rows[0]["problem"].startswith("not readable: ") and rows[1]["text"] == "b"


def test_empty_and_bad_names(spark, tmp_path):
    assert folder.read_folder(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no name of a file"):
        folder.write_folder(spark.createDataFrame([("../x", b"")], "name string, content binary"), f"{tmp_path}/out")


def test_files_in_dealt_folders(spark, tmp_path):
    from quillspark.sources import files

    path = f"{tmp_path}/in"
    texts = [(str(i), f"text {i}é".encode("latin-1" if i % 2 else "utf-8")) for i in range(300)] + [("a/b.gz", b"x"), ("7", b"again"), (None, None)]
    frame = spark.createDataFrame(texts, "name string, content binary")
    for _ in range(2):  # the second replaces the first
        files.write_files(frame, path)
    below = os.listdir(path)
    assert all(x.startswith("part-") for x in below) and len(below) <= 200  # not a folder for each file
    # The driver knows folders only.
    assert sorted(p.value for p in folder._Reader(path, True, 100).partitions()) == sorted(f"{path}/{x}" for x in below)
    name = lambda p: os.path.basename(p)[5:-4]
    listed = {name(r.path): r.length for r in files.list_files(spark, path, dealt=True).collect()}
    assert len(listed) == 302 and listed["a%2Fb.gz"] == 2 and listed["8"] == len("text 8é\n".encode())
    for strict in (False, True):
        plain = files.read_corpus(spark, f"{path}/*", strict).where("doc_id like '%0.txt'")
        dealt = files.read_corpus(spark, path, strict, dealt=True).where("doc_id like '%0.txt'")
        texts_of = lambda rows: {name(r.doc_id): r.text for r in rows.collect()}
        assert texts_of(plain) == texts_of(dealt) and len(texts_of(dealt)) == 30
    bad = {name(r.doc_id) for r in files.read_quarantined(spark, path, dealt=True).where("text is null").collect()}
    assert bad == {str(i) for i in range(1, 300, 2)}
    assert sorted(files.read_corpus(spark, path, dealt=True).where("doc_id like '%=7.txt'").first().text.splitlines()) == ["again", "text 7"]
    with pytest.raises(Exception):
        files.read_corpus(spark, path, strict=True, dealt=True).collect()
