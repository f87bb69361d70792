import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import secrets


P = pytest.importorskip("public_tokenizers")
WORDS = secrets.dictionary_words(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(spark, WORDS)


def test_dictionary_is_of_common_whole_words():
    assert len(WORDS) == len(set(WORDS)) == 2000
    assert {"this", "that", "love", "time"} <= set(WORDS) and all(w.isalpha() and len(w) >= 4 for w in WORDS)
    assert secrets.dictionary_words(P.path("word_bpe_49k.json"), 10) == WORDS[:10]


def _slow_features(value, before, source):
    """The features by walks over characters."""
    kind = lambda c: "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "_"
    kinds, n = [kind(c) for c in value], len(value)
    runs = sum(i == 0 or k != kinds[i - 1] for i, k in enumerate(kinds))
    words = [w for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", value) if w.lower() in set(WORDS)]
    flag = lambda pattern, text: int(bool(re.search(pattern, text)))
    bare = value.rstrip("".join(c for c in value if kind(c) == "_"))
    hexed = bool(bare) and (set(bare) <= set("0123456789abcdef") or set(bare) <= set("0123456789ABCDEF"))
    return [n, kinds.count("0"), kinds.count("A"), kinds.count("a"), kinds.count("_"), 100 * (runs - 1) // max(n, 1), len(set(value)), int(hexed),
            100 * sum(map(len, words)) // max(n, 1), 100 * (n - len(re.sub(secrets._PARTS, "", value.lower()))) // max(n, 1), sum(c in "/." for c in value),
            flag("(?i)(?:test|example|fixture|spec|docs?)(?:[/_.-]|$)", source or ""), flag(secrets._NEAR_KEYS, before), flag(secrets._NEAR_OTHERS, before[-24:]),
            flag("""[:=][ \t]{0,3}["']?$""", before), flag(secrets._PREFIX, value), flag("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-", value)]


def test_candidates_and_features_equal_a_slow_form(spark):
    """Every candidate of a table and of all composed kinds, its span, its value and its features."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "source")
    docs = docs.unionByName(secrets.labelled_findings(spark, 600).select("text", "source"))
    docs = docs.unionByName(spark.createDataFrame([("pwd='a.b/c:Xx'; token=<abcdef> secret : abcde API-KEY=éééééé1 +/=-_" + "a1" * 30, "docs/x"), ("", None)], docs.schema))
    c = secrets._with_candidates(F.col("text"), F.col("source"), WORDS, lambda p, m, c: c, F.array().cast("array<struct<start:int,lead:string,value:string,features:array<int>>>"))
    seen = 0
    for r in docs.select("text", "source", c.alias("c")).collect():
        want, end = [], 0
        for m in re.finditer(secrets.CANDIDATE, r.text or ""):
            value = re.sub("^" + secrets._KEY, "", m[0], count=1)
            start = m.end() - len(value)
            before = r.text[max(end, m.start() - secrets._CONTEXT) : start]
            want.append((start, value, _slow_features(value, before, r.source)))
            end = m.end()
        assert [(x.start, x.value, x.features) for x in r.c] == want, r.text[:200]
        seen += len(want)
    assert seen > 600


@pytest.mark.parametrize("held", [["hex40", "commit", "your"], ["mixed", "uuid", "word"], ["upper", "sha256", "path"], ["aws", "call", "example"], ["short", "card", "changeme"]])
def test_kinds_that_no_example_had(spark, held):
    """Precision and recall on kinds of secrets and of false findings that the forest never saw."""
    trained = secrets.fit(spark, WORDS, secrets.labelled_findings(spark, 3200, [k for k in secrets.KINDS if k not in held]))
    new = secrets.labelled_findings(spark, 600, held)
    scored = secrets.scan(new, trained).select("is_secret", F.explode("findings").alias("f")).collect()
    told, right = [r for r in scored if r.f.is_secret], [r for r in scored if r.is_secret]
    both = sum(r.is_secret for r in told)
    print(held, "precision", both / max(1, len(told)), "recall", both / len(right))
    assert both >= 0.8 * len(told) and both >= 0.8 * len(right)


def test_finds_planted_and_leaves_numbers(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in secrets.scan(docs, model).select("text", "findings").collect():
        want = {(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
        got = {(f.start, f.start + f.length) for f in r.findings if f.is_secret}
        assert got == want
        assert all(r.text[f.start : f.start + f.length] == f.value for f in r.findings)


def test_expression_equals_forest_and_separates(spark, model):
    rows = secrets.labelled_findings(spark, 400)
    scored = secrets.scan(rows, model).select("is_secret", F.explode("findings").alias("f")).collect()
    assert np.mean([r.f.is_secret == r.is_secret for r in scored]) >= 0.97
    x = np.random.default_rng(0).integers(0, 60, (50, len(secrets.NAMES)))
    df = spark.createDataFrame([([int(v) for v in r],) for r in x], "v array<int>")
    got = [r.p for r in df.select(secrets.probability(model.trees, F.col("v")).alias("p")).collect()]
    assert got == pytest.approx(np.mean([t.score(x) for t in model.trees], axis=0))


def test_many_candidates_have_exact_spans(spark, model):
    text = "é " + " ".join(f"token = '{i:032x}' 12345678901234{i:04d} ü" for i in range(700))
    r = secrets.scan(spark.createDataFrame([(text,)], "text string"), model).first()
    assert len(r.findings) == 1400
    assert all(text[f.start : f.start + f.length] == f.value for f in r.findings)


def test_redact_changes_secrets_only(spark, model):
    h = hashlib.sha1(b"x").hexdigest()
    texts = [f'token = "{h}" and commit {h}.', "no secret", None, "", f'token = "{h}"' * 2]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.text for r in secrets.redact(df, model).orderBy("doc_id").collect()]
    assert got == [f'token = "[SECRET]" and commit {h}.', "no secret", None, "", 'token = "[SECRET]"' * 2]


def test_odd_rows(odd_docs, model):
    out = secrets.scan(odd_docs.withColumn("findings", F.lit(1)), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "findings"]
    assert len(out.collect()) == 9
    assert secrets.query(odd_docs.limit(0), WORDS).count() == 0
    assert secrets.scan(odd_docs.drop("source"), model).count() == 9


def test_no_findings_to_learn_from(spark):
    none = spark.createDataFrame([], "text string, source string, is_secret boolean")
    assert secrets.fit(spark, [], none).trees[0].vote == 0


def test_plan_is_native(odd_docs, spark, model):
    df = secrets.redact(spark.range(3).select(F.lit("a").alias("text")), model)
    plan = secrets.scan(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_a_digit_may_stand_anywhere(spark, model):
    long = "k" * 300_000
    texts = ["a" * 85 + "7", "sk_live_" + "x" * 80 + "42", long + "1", long, "b" * 40 + " 5", "c" * 15 + "1", "d" * 14 + "1"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.doc_id: [f.value for f in r.findings] for r in secrets.scan(docs, model).collect()}
    assert found == {0: [texts[0]], 1: [texts[1]], 2: [texts[2]], 3: [], 4: [], 5: [texts[5]], 6: []}
