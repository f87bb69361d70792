import hashlib
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from quillspark.llm import align

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    """Ids and token bytes of a whole text by the unmodified libraries."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(sorted(set(range(256)) - set(plain)))}

    def of(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        return ids_a, bytes_a, ids_b, bytes_b

    return of


def brute(of, text):
    """Groups and links byte by byte: (n_a, n_b, groups, links)."""
    if not text:
        return 0, 0, [], []
    ids_a, bytes_a, ids_b, bytes_b = of(text)
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return 0, 0, [], []
    owner = lambda tokens: [k for k, t in enumerate(tokens) for _ in t]
    own_a, own_b = owner(bytes_a), owner(bytes_b)
    links = sorted(set(zip(own_a, own_b)))
    groups, ga, gb = [], [], []
    for k in range(len(raw)):
        ga, gb = ga + [own_a[k]] * (own_a[k] not in ga[-1:]), gb + [own_b[k]] * (own_b[k] not in gb[-1:])
        if k + 1 == len(raw) or own_a[k + 1] != own_a[k] and own_b[k + 1] != own_b[k]:
            groups.append(",".join(str(ids_a[i]) for i in ga) + "|" + ",".join(str(ids_b[i]) for i in gb))
            ga, gb = [], []
    return len(ids_a), len(ids_b), groups, [(ids_a[i], ids_b[j]) for i, j in links]


def want(of, rows):
    found = [(i, *brute(of, t)) for i, t in rows]
    counts = Counter(link for x in found for link in x[4])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return Counter((i, a, b, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest(g)) for i, a, b, g, links in found)


def texts():
    rng = random.Random(2)
    pieces = ["the", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \r", "\x1c", "\u180e", "\xa0", "\u2003", ".", "'s", "'ll", ");", "12", "é", "ß", "日本", "\U0001f600", "naïve", "\u0300", "<|endoftext|>", "</s>", "<0x0A>", "x", "\x00", "Straße", "ﬁ", "٣", "\u200b"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    return out + ["", " ", "\n", " \n ", "a\u2581b", "x" * 5000, "word " * 3000, "\t" * 50, "a\t\n b", "a \nb", "a  \n\n  b;\r\n", "(a)", "\nWord", "\n Été.", "\n\nx", "don't", "it's.", "x'"]


def test_texts_equal_the_libraries(libraries):
    aligner = align.Aligner(A, B)
    assert aligner.in_chunks
    every = texts()
    for t, (got, raw, n) in zip(every * 2, [x for k in (0, 1) for at in (slice(0, 700), slice(700, None)) for x in aligner.align_all(every[at])]):
        n_a, n_b, groups, links = brute(libraries, t)
        assert (got.decode(), n) == (";".join(groups), n_a), repr(t)
        assert Counter(x for x in memoryview(raw).cast("Q")) == Counter(a << 32 | b for a, b in links), repr(t)


def test_query_equals_brute_force(spark, make_docs, libraries):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = [(i, t) for i, t in zip(docs["doc_id"], docs["text"]) if len(t or "") < 6000] + [(10_000 + i, t) for i, t in enumerate(texts()[::9])]
    rows += [(None, "no id"), (None, None), (77_777, None), (5, "twice"), (5, "twice"), (2**60 + 1, "large id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, align.query(frame, A, B).collect())) == want(libraries, rows)
    assert align.query(frame.limit(0), A, B).count() == 0


@pytest.mark.parametrize("head", [0, 3, 50, 10**6])
def test_head_and_rest_make_the_whole(spark, head):
    rows = [(i, f"a{'b' * (i % 7)} the {i % 5} of {'the ' * (i % 9)}") for i in range(200)]
    texts = align.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    counts = align.link_counts(texts).cache()
    assert counts.where(f"n >= {align._least_of_head(counts, head)}").count() <= head
    got = align.with_counts(texts, counts, "id", head).collect()
    n = {r.pair: r for r in counts.collect()}
    for r in texts.collect():
        links = [(n[p], t) for p, t in zip(r.pairs, r.times)]
        x = next(g for g in got if g.id == r.id)
        assert x.count_sum == sum(c.n * t for c, t in links)
        assert x.n_best_a == sum(t for c, t in links if c.n == c.best_a) and x.n_best_b == sum(t for c, t in links if c.n == c.best_b)


def test_odd_rows_and_clashing_columns(spark, odd_docs):
    from pyspark.sql import functions as F

    rows = align.query(odd_docs.withColumns({"n_a": F.lit("x"), "pairs": F.lit(None), "row": F.lit(1), "id": F.lit(7)}), A, B).collect()
    assert len(rows) == 9 and sum(r.doc_id is None for r in rows) == 1
    by = {r.doc_id: r for r in rows}
    assert by[1].groups_sha256 == by[2].groups_sha256 == "" and by[1].n_links == 0
    assert by[4].n_a >= 60_000 and by[3].n_groups > 0
