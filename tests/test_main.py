import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def _run(folder, *args, said=""):
    done = subprocess.run([sys.executable, "-m", "quillspark", *args], cwd=folder, input=said, capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_the_program_builds_searches_and_answers(tmp_path):
    mail = tmp_path / "mail"
    mail.mkdir()
    for name, text in {"1.txt": "meeting schedule", "2.txt": "meeting", "3.txt": "lunch"}.items():
        (mail / name).write_text(text)
    (tmp_path / "config.ini").write_text("[Settings]\ninput_directory = mail\nblock_size = 10\noutput_file = index.txt\n")
    _run(tmp_path, "index", "config.ini")
    lines = "".join(f.read_text() for f in sorted((tmp_path / "index.txt").glob("part-*")))
    assert [x.split(": ")[0] for x in lines.splitlines()] == ["lunch", "meet", "schedul"] and lines.splitlines()[1].count(".txt") == 2
    assert "1.txt" in _run(tmp_path, "search", "config.ini", "meeting", "AND", "schedule")
    answers = _run(tmp_path, "search", "config.ini", said="!ranking bm25\nmeeting\nNOT\nquit\n")
    assert "ranking: bm25" in answers and "1. " in answers and "not a query" in answers
    table = _run(tmp_path, "bench", "config.ini", "meeting")
    assert all(m in table for m in ("none", "tfidf", "bm25", "vector"))
