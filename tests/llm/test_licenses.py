import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.llm import licenses


SMALL = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def windows(spark):
    return licenses.background(spark.read.parquet(SMALL))


@pytest.fixture(scope="module")
def model(windows):
    return licenses.train(windows)


def test_background_is_drawn_from_every_part_and_holds_no_notice(spark, windows):
    docs = spark.read.parquet(SMALL)
    assert windows == licenses.background(docs.repartition(5)) and 500 < len(windows) <= 1000
    assert max(map(len, windows)) <= licenses.WINDOW
    assert not any(b"license" in w and b"mit" in w for w in windows)
    assert licenses.background(docs.limit(0)) == []


def test_without_background_and_held_out_wording(spark):
    """Notices in wordings that no example has, and sentences near to notices that state none."""
    scanner = licenses.Scanner(licenses.train())
    told = {"MIT": "The whole package has been licensed under the MIT License since May", "Apache-2.0": "all of our code is licensed under the Apache License, Version 2.0, and so are the docs",
            "GPL": "these tools are licensed under the GNU General Public License, version 3 or later", "CC-BY-NC": "photos licensed under CC BY-NC 4.0 by their makers"}
    for family, text in told.items():
        assert [f.family for f in scanner.scan([text]) if f.confirmed] == [family]
    for text in ("He lost his license in the city of Apache.", "the public version of the general work", "MIT is a university", "a license to copy the software, version 2"):
        assert not [f for f in scanner.scan([text]) if f.confirmed]


def test_every_licence_of_a_window_is_found(model):
    text = "Licensed under the MIT License or licensed under the Apache License, Version 2.0."
    assert {f.family for f in licenses.Scanner(model).scan([text]) if f.confirmed} == {"MIT", "Apache-2.0"}


def _slow_paragraphs(text):
    """Spans by a regular expression instead of a walk over lines."""
    out, at = [], 0
    for line in re.finditer(r"[^\n]*\n|[^\n]+$", text):
        body = line.group().rstrip("\n")
        if not body.strip():
            if at is not None and out and out[-1][2] == "open":
                out[-1] = (out[-1][0], max(out[-1][0], line.start() - 1), "shut")
            continue
        ends = body.rstrip()[-1] in ".!?:;"
        if out and out[-1][2] == "open":
            out[-1] = (out[-1][0], line.start() + len(body), "shut" if ends else "open")
        else:
            out.append((line.start(), line.start() + len(body), "shut" if ends else "open"))
    return [(a, len(text) if kind == "open" else b) for a, b, kind in out]


def _slow_scan(model, text):
    """Every window of every paragraph by the dense model."""
    found, base = {}, len(model.words) + 1
    weights = np.vstack([model.word_weights, model.pair_weights])
    for nth, (a, b) in enumerate(_slow_paragraphs(text)):
        words = licenses.words_of(text[a:b])
        for first in range(0, max(1, len(words) - licenses.WINDOW // 2), licenses.WINDOW // 2):
            window, seen = words[first : first + licenses.WINDOW], set()
            while True:
                p = licenses._softmax((licenses._dense([window], model.words, model.pair_codes)[0] @ weights + model.bias) / model.temperature)
                family = int(p[:-1].argmax())
                if 1 - p[-1] <= model.bound or family in seen:
                    break
                seen.add(family)
                ids = [model.words.get(w, 0) for w in window]
                pairs = [x * base + y if x and y else 0 for x, y in zip(ids, ids[1:])]
                similarity, template, codes = max(((float(np.mean([c in pairs for c in codes])), t, tuple(codes)) for f, t, codes in model.templates if f == family), key=lambda x: x[:2])
                key = (nth, a, b, model.families[family])
                found[key] = max(found.get(key, (0, 0, "")), (round(similarity, 4), round(float(p[family]), 3), template), key=lambda x: x[:2])
                if similarity < model.least_similar:
                    break
                stretches = []
                for k, c in enumerate(pairs):
                    if c in codes:
                        if not stretches or k - stretches[-1][-1] > 3:
                            stretches.append([])
                        stretches[-1].append(k)
                gone = {k + d for k in max(stretches, key=len) for d in (0, 1)}
                window = [b"\xff" if k in gone else w for k, w in enumerate(window)]
    return found


def test_whole_table_equals_a_slow_scan(model):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()["text"]
    docs += ["", "\n\n", "a.\n b\n\nReleased under the MIT License", " \nx\n \n", licenses.TEMPLATES["BSD"][3] + " " + licenses.TEMPLATES["Zlib"][1]]
    some = 0
    for text in docs:
        assert licenses.paragraphs(text) == _slow_paragraphs(text)
        if not text or (len(text) > 20_000 and "icens" not in text):
            continue
        got = {(f.paragraph, f.start, f.end, f.family): (round(f.similarity, 4), f.probability) for f in licenses.Scanner(model).scan([text])}
        want = _slow_scan(model, text)
        assert set(got) == set(want)
        some += len(want)
        for k, (similarity, probability) in got.items():
            assert similarity == want[k][0] and probability == pytest.approx(want[k][1], abs=2e-3)
    assert some > 5


def test_families_and_unknown_on_new_examples(model):
    rng = random.Random(99)
    scanner = licenses.Scanner(model)
    rows, labels = licenses._examples(rng, model.families, 30)
    found = [[f for f in scanner.scan([b" ".join(r).decode()]) if f.confirmed] for r in rows]
    notices = [(f, model.families[y]) for f, y in zip(found, labels) if y < len(model.families) - 1]
    assert np.mean([any(x.family == y for x in f) for f, y in notices]) >= 0.9
    others = [f for f, y in zip(found, labels) if y == len(model.families) - 1]
    assert np.mean([bool(f) for f in others]) <= 0.01


@pytest.mark.parametrize("family", list(licenses.TEMPLATES))
def test_plain_and_wrapped_templates(model, family):
    scanner = licenses.Scanner(model)
    for text in licenses.TEMPLATES[family]:
        wrapped = re.sub(r"((?:\S+\s+){4}\S+)\s+", r"\1\n", text)
        for t in (text, text.upper(), wrapped, "The onha thion er is.\n" + text + "\n\nand tion ouen"):
            got = [f for f in scanner.scan([t]) if f.confirmed]
            assert [f.family for f in got] == [family], t
        assert t[got[0].start : got[0].end] == text


def test_sparse_sums_equal_dense_model(model):
    scanner = licenses.Scanner(model)
    rng = random.Random(4)
    rows, _ = licenses._examples(rng, model.families, 3)
    w = np.vstack([model.word_weights, model.pair_weights])
    want = licenses._softmax((licenses._dense(rows, model.words, model.pair_codes) @ w + model.bias) / model.temperature)
    for row, p in zip(rows, want):
        got = scanner.scan([b" ".join(row).decode()])
        if 1 - p[-1] > model.bound + 1e-6:
            first = max(got, key=lambda f: f.probability)
            assert model.families[int(p[:-1].argmax())] in {f.family for f in got}
            assert first.probability >= p[:-1].max() - 1e-4
        elif 1 - p[-1] < model.bound - 1e-6:
            assert got == []


def test_notice_inside_a_long_paragraph(model):
    rng = random.Random(1)
    around = licenses.Around(rng, [])
    filler = lambda n: b" ".join(around(n)).decode()
    text = filler(400) + " licensed under the Apache License, Version 2.0 " + filler(400)
    assert "Apache-2.0" in {f.family for f in licenses.Scanner(model).scan([text]) if f.confirmed}


def test_planted_lines_of_the_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    lines = {"MIT": r"released under the mit license", "Apache-2.0": r"licensed under the apache license", "GPL": r"licensed under the gnu general public", "CC-BY-NC": r"licensed under cc by-nc"}
    docs = pq.read_table(path).to_pydict()
    want = {(i, k) for i, t in zip(docs["doc_id"], docs["text"]) for k, p in lines.items() if re.search(p, t.lower())}
    got = {(r.doc_id, r.family) for r in licenses.query(spark.read.parquet(path)).where("confirmed").collect()}
    assert got == want


def test_odd_rows(odd_docs, model):
    out = licenses.scan(odd_docs.withColumn("family", F.lit(1)), model)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *[n for n, _ in licenses._FIELDS]]
    assert out.count() == 0
    text = F.lit("Released under the MIT License.")
    twice = licenses.scan(odd_docs.where("doc_id = 6").withColumn("text", text), model).collect()
    assert [(r.doc_id, r.family, r.start, r.end) for r in twice] == [(6, "MIT", 0, 31)] * 2
    assert licenses.query(odd_docs.limit(0)).count() == 0
