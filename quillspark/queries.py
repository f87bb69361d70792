"""The engine's registered queries over the table ``documents``, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS, LETTERS_PORTER, Analyzer, base_name
from quillspark.functions.porter_sql import stems_sql
from quillspark.operators import codec, index, levels, pruned, ranking, validation
from quillspark.operators.stored import index_of, shared_folder
from quillspark.plans import boolean
from quillspark.plans.engine import SearchEngine, prompt
from quillspark.sources import binary, files, folder, lines
from quillspark.streaming.segments import index_stream, read_segments

Query = Callable[[SparkSession, str], DataFrame]
found: dict[str, Query] = {}
sql: dict[str, str] = {}

# Postings by plain SQL: the common start of the oracles.
BASE = r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS x FROM documents),
t AS (SELECT doc_id, regexp_replace(lower(x), '[^a-z]', '', 'g') AS term FROM w WHERE regexp_matches(lower(x), '[a-z]')),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
c AS (SELECT count(*) FILTER (dl > 0) AS n_docs, count(*) AS n_files, CAST(sum(dl) AS BIGINT) AS total_tokens, sum(dl) / count(*) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term)
"""
# The same over stems.
STEMMED = BASE.replace("\nt AS (", "\nu AS (", 1).replace("\np AS (", "\n" + stems_sql("SELECT term FROM u") + ",\nt AS (SELECT u.doc_id, s.stem AS term FROM u JOIN stems s ON s.term = u.term),\np AS (", 1)


def register(oracle: str | None = None):
    def wrap(f: Query) -> Query:
        found[f.__name__] = f
        if oracle is not None:
            sql[f.__name__] = oracle
        return f

    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index_of(spark, sf_dir, LETTERS)


def six(c: Column | str) -> Column:
    return F.round(c, 6)


# --- analysis and index -------------------------------------------------------------


@register(r"""
WITH w AS (SELECT doc_id, string_split_regex(text, '\s+') AS xs FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(xs, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: x <> '') AS ts FROM w)
SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM t
""")
def tokenize(spark, sf_dir):
    w = documents(spark, sf_dir).select("doc_id", LETTERS.surface(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.encode(F.array_join("w", " "), "UTF-8")).alias("tokens_md5"))


@register(BASE + "SELECT doc_id, dl FROM dl")
def doc_lengths(spark, sf_dir):
    return index.document_lengths(documents(spark, sf_dir), LETTERS).select("doc_id", "dl")


@register(BASE + "SELECT n_docs, n_files, total_tokens, round(avgdl, 6) AS avgdl FROM c")
def corpus_stats(spark, sf_dir):
    lengths = index.document_lengths(documents(spark, sf_dir), LETTERS)
    return index.corpus_stats(lengths).withColumn("avgdl", six("avgdl"))


@register(BASE + "SELECT term, df, cf FROM df")
def term_df(spark, sf_dir):
    return index.term_stats(index.count_postings(documents(spark, sf_dir), LETTERS))


@register(BASE + "SELECT term, doc_id, tf FROM p")
def postings_tf(spark, sf_dir):
    return index.count_postings(documents(spark, sf_dir), LETTERS).drop("dl")


@register(BASE + "SELECT term, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY CAST(doc_id AS VARCHAR)) AS postings FROM p GROUP BY term")
def inverted_index(spark, sf_dir):
    return index.inverted_lists(plain_index(spark, sf_dir).postings).select("term", F.array_join("postings", ", ").alias("postings"))


@register(BASE + "SELECT term, df FROM df ORDER BY df DESC, term LIMIT 50")
def vocab_top_df(spark, sf_dir):
    return plain_index(spark, sf_dir).term_stats.orderBy(F.desc("df"), "term").limit(50).select("term", "df")


@register(BASE + "SELECT term FROM df")
def vocabulary(spark, sf_dir):
    return plain_index(spark, sf_dir).vocabulary()


@register(BASE + "SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id FROM df")
def term_ids(spark, sf_dir):
    return codec.term_table(plain_index(spark, sf_dir).postings).select("term", "term_id")


@register(BASE + "SELECT d.doc_id, q.term, coalesce(p.tf, 0) AS tf, dl.dl FROM documents d CROSS JOIN (VALUES ('this'), ('nosuchword')) q(term) LEFT JOIN p ON p.doc_id = d.doc_id AND p.term = q.term JOIN dl ON dl.doc_id = d.doc_id")
def point_lookups(spark, sf_dir):
    i = plain_index(spark, sf_dir)
    pairs = documents(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("this"), F.lit("nosuchword"))).alias("term"))
    return i.document_length(i.term_frequency(pairs)).select("doc_id", "term", "tf", "dl")


# --- compact form -------------------------------------------------------------------

_OFFSETS = """, l AS (
  SELECT term, CAST(length(term) AS INTEGER) AS len, 4 + sum(4 + strlen(CAST(doc_id AS VARCHAR))) AS bytes FROM p GROUP BY term)
SELECT term, CAST(row_number() OVER o - 1 AS BIGINT) AS term_id, CAST(coalesce(sum(len) OVER b, 0) AS BIGINT) AS start, len,
  CAST(coalesce(sum(bytes) OVER b, 0) AS BIGINT) AS "offset"
FROM l WINDOW o AS (ORDER BY term), b AS (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@register(BASE + _OFFSETS)
def term_offsets(spark, sf_dir):
    return codec.term_table(plain_index(spark, sf_dir).postings).drop("df")


@register(BASE + """, o AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i, sum(length(term)) OVER (ORDER BY term) - length(term) AS a FROM df)
SELECT CAST(min(a) AS BIGINT) AS start, string_agg(term, '' ORDER BY term) AS text FROM o GROUP BY i // 10000""")
def dictionary_string(spark, sf_dir):
    return codec.dictionary_string(plain_index(spark, sf_dir).postings)


@register(BASE + """SELECT term, lower(format('{:08x}', count(*)) || string_agg(format('{:08x}', strlen(CAST(doc_id AS VARCHAR))) || lower(hex(encode(CAST(doc_id AS VARCHAR)))), '' ORDER BY CAST(doc_id AS VARCHAR))) AS data FROM p GROUP BY term""")
def postings_codec(spark, sf_dir):
    return codec.encoded_index(plain_index(spark, sf_dir).postings).select("term", F.lower(F.hex("data")).alias("data"))


def _round_trip(lists: DataFrame) -> DataFrame:
    back = lists.select("term", codec.decode_postings(codec.encode_postings(F.col("postings"))).alias("postings"))
    return back.select("term", F.array_join("postings", ", ").alias("postings"))


@register(BASE + "SELECT term, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY CAST(doc_id AS VARCHAR)) AS postings FROM p GROUP BY term")
def codec_round_trip(spark, sf_dir):
    return _round_trip(index.inverted_lists(plain_index(spark, sf_dir).postings))


@register(BASE + "SELECT term, CAST(doc_id AS VARCHAR) AS doc_id FROM p")
def chunk_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/chunks"
    codec.encoded_chunks(plain_index(spark, sf_dir).postings).write.parquet(path)
    return codec.decode_chunks(spark.read.parquet(path))


@register(BASE + """, s AS (
  SELECT term, sum(length(CAST(doc_id AS VARCHAR))) AS chars, count(*) AS n FROM p GROUP BY term),
z AS (SELECT CAST(sum(length(term) + chars) AS BIGINT) AS a, CAST(sum(length(term) + 12 + 4 + 4 * n + chars) AS BIGINT) AS b FROM s)
SELECT a AS original_size, b AS compressed_size, round(a / b, 6) AS ratio FROM z""")
def size_report(spark, sf_dir):
    return codec.size_report(plain_index(spark, sf_dir).postings).withColumn("ratio", six("ratio"))


@register(BASE + """, o AS (SELECT t.doc_id, row_number() OVER (ORDER BY t.doc_id) - 1 AS i FROM t)
SELECT CAST(i // 5001 AS BIGINT) AS block, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_documents FROM o GROUP BY 1""")
def block_stats(spark, sf_dir):
    return index.block_stats(plain_index(spark, sf_dir).doc_stats, 5000)


@register(r"""
WITH w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: x <> '') AS ts FROM documents),
u AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM w),
o AS (SELECT doc_id, term, (row_number() OVER (ORDER BY doc_id, i) - 1) // 5001 AS block FROM u),
p AS (SELECT block, term, doc_id, count(*) AS tf FROM o GROUP BY ALL),
s AS (SELECT block, sum(tf) AS n_tokens, count(DISTINCT doc_id) AS n_documents, count(DISTINCT term) AS n_terms, count(*) AS n_postings, sum(strlen(CAST(doc_id AS VARCHAR)) + 2) AS ids FROM p GROUP BY block),
l AS (SELECT block, sum(strlen(term) + 1) AS terms FROM (SELECT DISTINCT block, term FROM p) GROUP BY block)
SELECT CAST(s.block AS BIGINT) AS block, CAST(n_tokens AS BIGINT) AS n_tokens, n_documents, n_terms, n_postings, CAST(ids + terms AS BIGINT) AS n_bytes
FROM s JOIN l ON l.block = s.block""")
def cut_blocks(spark, sf_dir):
    return index.block_sizes(index.cut_blocks(documents(spark, sf_dir), LETTERS, 5000, f"{shared_folder(spark)}/blocks"))


@register(BASE + "SELECT term, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY CAST(doc_id AS VARCHAR)) AS postings FROM p GROUP BY term")
def text_index_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/text"
    files.write_text_index(plain_index(spark, sf_dir).postings, path)
    return files.read_text_index(spark, path).select("term", F.array_join("postings", ", ").alias("postings"))


@register(BASE + "SELECT term, CAST(doc_id AS VARCHAR) AS doc_id FROM p")
def text_rows_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/lines"
    lines.write_lines(plain_index(spark, sf_dir).postings, path)
    return lines.read_lines(spark, path)


@register(BASE + "SELECT term, doc_id FROM p")
def binary_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/binary"
    binary.write_binary(plain_index(spark, sf_dir).postings, path)
    return binary.read_binary(spark, path)


@register(BASE + "SELECT term, doc_id FROM p WHERE term IN (SELECT term FROM df ORDER BY md5(term) LIMIT 2000)")
def binary_lookups(spark, sf_dir):
    """The lists of 2000 terms, each found in the binary index on disk."""
    path, i = f"{shared_folder(spark)}/binary", plain_index(spark, sf_dir)
    binary.write_binary(i.postings, path)
    terms = [r["term"] for r in i.term_stats.orderBy(F.md5(F.col("term").cast("binary")), "term").limit(2000).select("term").collect()]
    return binary.read_binary(spark, path).where(F.col("term").isin(terms))


@register(BASE + "SELECT term, doc_id, tf FROM p")
def segment_write(spark, sf_dir):
    path = f"{shared_folder(spark)}/segment"
    files.write_segment(index.count_postings(documents(spark, sf_dir), LETTERS), path)
    return spark.read.parquet(path).select("term", "doc_id", "tf")


# --- files --------------------------------------------------------------------------


def _as_files(spark, sf_dir, charset: str = "UTF-8") -> str:
    """Every document as a file of its own; its id is in the file's name."""
    path = f"{shared_folder(spark)}/files"
    files.write_files(documents(spark, sf_dir).select(F.col("doc_id").alias("name"), F.encode("text", charset).alias("content")), path)
    return path


def _id_of(path: Column) -> Column:
    return F.regexp_extract(path, r"name=([0-9-]+)\.txt$", 1).cast("long")


@register("SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS length FROM documents")
def listed_files(spark, sf_dir):
    return files.list_files(spark, _as_files(spark, sf_dir), dealt=True).select(_id_of(F.col("path")).alias("doc_id"), "length")


@register(BASE + "SELECT doc_id, dl FROM dl")
def strict_files(spark, sf_dir):
    docs = files.read_corpus(spark, _as_files(spark, sf_dir), strict=True, dealt=True)
    return index.document_lengths(docs, LETTERS).select(_id_of(F.col("doc_id")).alias("doc_id"), "dl")


# As Latin-1, letters beyond ASCII are no UTF-8: dropped when decoding is lenient, else the document has failed.
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"


@register(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(""" + _ASCII + r"""), '\s+'), lambda x: x <> '') AS xs FROM documents)
SELECT doc_id, CAST(len(xs) AS BIGINT) AS n_tokens, md5(array_to_string(xs, ' ')) AS tokens_md5 FROM w""")
def lenient_files(spark, sf_dir):
    docs = files.read_corpus(spark, _as_files(spark, sf_dir, "ISO-8859-1"), dealt=True)
    w = docs.select(_id_of(F.col("doc_id")).alias("doc_id"), Analyzer("whitespace").surface(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.encode(F.array_join("w", " "), "UTF-8")).alias("tokens_md5"))


@register(BASE + r"""SELECT dl.doc_id, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 1 ELSE dl END AS dl, regexp_matches(text, '[^\x00-\x7F]') AS failed
FROM dl JOIN documents d ON d.doc_id = dl.doc_id""")
def failed_documents(spark, sf_dir):
    docs = files.read_quarantined(spark, _as_files(spark, sf_dir, "ISO-8859-1"), dealt=True)
    built = index.build_index(docs, LETTERS).write(f"{shared_folder(spark)}/index")
    return built.doc_stats.select(_id_of(F.col("doc_id")).alias("doc_id"), "dl", "failed")


_HIDDEN = "concat(CASE lang WHEN 'de' THEN '.' WHEN 'fr' THEN '_' ELSE '' END, doc_id, '.txt')"


@register(f"SELECT {_HIDDEN} AS name, CAST(strlen(text) AS BIGINT) AS length FROM documents")
def hidden_files(spark, sf_dir):
    """All files of a folder, also those whose names begin with . or _."""
    path = f"{shared_folder(spark)}/folder"
    folder.write_folder(documents(spark, sf_dir).select(F.expr(_HIDDEN).alias("name"), F.col("text").alias("content")), path)
    return folder.list_folder(spark, path).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length")


# A text in Latin-1 has a byte a character; the first one beyond ASCII is where it is no UTF-8.
@register(r"""
WITH d AS (SELECT doc_id, text, length(text) AS n, length(regexp_extract(text, '^[\x00-\x7F]*')) AS good FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS length, CASE WHEN n > 20000 THEN 'longer than 20000 bytes' WHEN good < n THEN 'not UTF-8 at ' || good ELSE 'none' END AS problem,
  CASE WHEN n <= 20000 AND good = n THEN md5(text) ELSE 'no text' END AS text_md5 FROM d""")
def file_problems(spark, sf_dir):
    """What is wrong with each file of a folder, and the text of those with which nothing is."""
    path = f"{shared_folder(spark)}/folder"
    folder.write_folder(documents(spark, sf_dir).select(F.col("doc_id").alias("name"), F.encode("text", "ISO-8859-1").alias("content")), path)
    found = folder.read_folder(spark, path, most_bytes=20_000)
    problem = F.regexp_replace(F.coalesce("problem", F.lit("none")), ":.* position ", " at ")
    return found.select(
        F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "length", problem.alias("problem"),
        F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("no text")).alias("text_md5"))


@register("SELECT doc_id, concat(doc_id, '-', source, '.txt') AS name FROM documents")
def display_names(spark, sf_dir):
    path = F.concat(F.lit("mail/in/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("-"), F.col("source"), F.lit(".txt"))
    return documents(spark, sf_dir).select("doc_id", base_name(path).alias("name"))


@register("SELECT min(source) AS input_directory, CAST(count(*) AS INTEGER) AS block_size, max(lang) || '.txt' AS output_file FROM documents")
def settings(spark, sf_dir):
    """A settings file made from the table, and what reading it gives."""
    path = f"{shared_folder(spark)}/settings"
    text = F.concat(F.lit("[Settings]\ninput_directory = "), F.min("source"), F.lit("\nblock_size = "), F.count("*").cast("string"), F.lit("\noutput_file = "), F.max("lang"), F.lit(".txt"))
    documents(spark, sf_dir).agg(text.alias("value")).write.text(path)
    s = files.read_settings(path, spark)
    return spark.range(1).select(F.lit(s.input_directory).alias("input_directory"), F.lit(s.block_size).alias("block_size"), F.lit(s.output_file).alias("output_file"))


@register(BASE + "SELECT term, df, cf FROM df")
def segments_index(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # A pattern: the table may be one file, which a stream takes only so.
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")
    root = shared_folder(spark)
    index_stream(stream, f"{root}/segments", f"{root}/progress", LETTERS).awaitTermination()
    return read_segments(spark, f"{root}/segments", LETTERS).term_stats


# The table after one of its languages was replaced and another deleted.
_CHANGED = "(SELECT doc_id, CASE WHEN lang = 'de' THEN concat('changed ', text, ' changed') ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'es')"


@register(BASE.replace("FROM documents", f"FROM {_CHANGED}") + "SELECT term, df, cf, (SELECT total_tokens FROM c) AS total_tokens FROM df")
def levels_index(spark, sf_dir):
    """Segments by language, one replaced, one deleted, merged into levels of two."""
    docs, root = documents(spark, sf_dir), shared_folder(spark)
    buckets = max(8, -(-docs.count() // 20_000))  # a task has a bucket, which so does not grow with the table
    store = levels.SegmentStore(spark, f"{root}/store", f"levels_{root.rsplit('-', 1)[-1]}", LETTERS, buckets=buckets)
    plain = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    for lang in sorted(r["lang"] for r in plain.select("lang").distinct().collect()):
        store.add(plain.where(F.col("lang") == lang).select("doc_id", "text"))
    german = plain.where("lang = 'de'").select("doc_id", F.concat(F.lit("changed "), "text", F.lit(" changed")).alias("text"))
    store.add(german)
    store.delete(plain.where("lang = 'es'"))
    store.merge(2)
    found = store.index()
    return found.term_stats.withColumn("total_tokens", F.lit(found.corpus["total_tokens"]).cast("long"))


# --- Boolean search -----------------------------------------------------------------


def _flag(term: str) -> str:
    return f"bool_or(term = '{term}')"


def _boolean_sql(condition: str) -> str:
    return BASE + f"SELECT doc_id FROM (SELECT doc_id, {condition} AS hit FROM p GROUP BY doc_id) WHERE hit"


BOOLEAN = {
    "bool_and": ("this AND with", f"{_flag('this')} AND {_flag('with')}"),
    "bool_or": ("was OR are", f"{_flag('was')} OR {_flag('are')}"),
    "bool_not": ("NOT that", f"NOT {_flag('that')}"),
    "bool_and_not": ("that AND NOT the", f"{_flag('that')} AND NOT {_flag('the')}"),
    "bool_nested": ("(was OR are) AND NOT with", f"({_flag('was')} OR {_flag('are')}) AND NOT {_flag('with')}"),
    "bool_dangling_not": ("this NOT with", _flag("this")),
    "bool_implicit_and": ("this with", f"{_flag('this')} AND {_flag('with')}"),
    "bool_double_not": ("NOT NOT this", _flag("this")),
    "bool_unbalanced": ("this OR with) AND the", f"({_flag('this')} OR {_flag('with')}) AND {_flag('the')}"),
}


def _boolean_query(text: str, mode: str = "compat") -> Query:
    return lambda spark, sf_dir: SearchEngine(plain_index(spark, sf_dir), mode=mode).matches(text)


for _name, (_text, _condition) in BOOLEAN.items():
    found[_name] = _boolean_query(_text)
    sql[_name] = _boolean_sql(_condition)

found["bool_strict_not"] = _boolean_query("this NOT with", "strict")
sql["bool_strict_not"] = _boolean_sql(f"{_flag('this')} AND NOT {_flag('with')}")
# Inside a word: an operand, an operator, an operand.
found["bool_embedded_operator"] = _boolean_query("isorwas")
sql["bool_embedded_operator"] = _boolean_sql(f"{_flag('is')} OR {_flag('was')}")


def _set_query(text: str) -> Query:
    def run(spark, sf_dir):
        i = plain_index(spark, sf_dir)
        return boolean.set_form(boolean.parse(text, LETTERS).matches, i.postings, i.universe())

    return run


for _name, _text, _set in (
    ("set_intersect", "this AND with", "SELECT doc_id FROM p WHERE term = 'this' INTERSECT SELECT doc_id FROM p WHERE term = 'with'"),
    ("set_union", "was OR are", "SELECT doc_id FROM p WHERE term = 'was' UNION SELECT doc_id FROM p WHERE term = 'are'"),
    ("set_except", "NOT that", "SELECT doc_id FROM p EXCEPT SELECT doc_id FROM p WHERE term = 'that'"),
):
    found[_name] = _set_query(_text)
    sql[_name] = BASE + _set


# --- ranked search ------------------------------------------------------------------


def _score_sql(method: str, bag: dict[str, int], condition: str, base: str = BASE) -> str:
    """CTE ``r`` (doc_id, score) in BASE's terms; the bag has query counts."""
    values = ", ".join(f"('{t}', {n})" for t, n in bag.items())
    idf = "ln((c.n_docs - df.df + 0.5) / (df.df + 0.5) + 1)" if method == "bm25" else "ln(c.n_docs / df.df)"
    score = {
        "tfidf": "coalesce(sum(p.tf * q.w * q.n), 0)",
        "bm25": "coalesce(sum(q.w * q.n * 2.2 * p.tf / (1.2 * (0.25 + 0.75 * dl.dl / c.avgdl) + p.tf)), 0)",
        "vector": "CASE WHEN sum((p.tf * q.w) ** 2) > 0 AND any_value(z.q2) > 0 THEN sum(p.tf * q.w * q.n * q.w) / sqrt(sum((p.tf * q.w) ** 2)) / sqrt(any_value(z.q2)) ELSE 0 END",
        "none": "0.0", "other": "1.0",
    }[method]
    return base + f""", q AS (SELECT v.term, v.n, {idf} AS w FROM (VALUES {values}) v(term, n) JOIN df ON df.term = v.term, c),
z AS (SELECT sum((n * w) ** 2) AS q2 FROM q),
m AS (SELECT doc_id FROM (SELECT doc_id, {condition} AS hit FROM p GROUP BY doc_id) WHERE hit),
r AS (SELECT m.doc_id, {score} AS score FROM m JOIN dl ON dl.doc_id = m.doc_id CROSS JOIN c CROSS JOIN z
  LEFT JOIN p ON p.doc_id = m.doc_id AND p.term IN (SELECT term FROM q) LEFT JOIN q ON q.term = p.term GROUP BY m.doc_id)
"""


def _ranked_query(text: str, method: str) -> Query:
    def run(spark, sf_dir):
        i = plain_index(spark, sf_dir)
        return ranking.search(i, boolean.parse(text, LETTERS), method).select("doc_id", six("score").alias("score"))

    return run


_AND = f"{_flag('this')} AND {_flag('with')}"
_OR_NOT = f"{_flag('this')} OR NOT {_flag('with')}"
RANKED = [
    ("rank_none", "this AND with", "none", {"this": 1, "with": 1}, _AND),
    ("rank_tfidf", "this AND with", "tfidf", {"this": 1, "with": 1}, _AND),
    ("rank_bm25", "this with", "bm25", {"this": 1, "with": 1}, _AND),
    ("rank_vector", "this AND with", "vector", {"this": 1, "with": 1}, _AND),
    ("rank_repeated_term", "this AND with AND this", "tfidf", {"this": 2, "with": 1}, _AND),
    ("rank_one_term_vector", "this", "vector", {"this": 1}, _flag("this")),
    ("rank_negated_vector", "this AND NOT with", "vector", {"this": 1, "with": 1}, f"{_flag('this')} AND NOT {_flag('with')}"),
    ("rank_or_not", "this OR NOT with", "bm25", {"this": 1, "with": 1}, _OR_NOT),
    ("rank_unknown_method", "this AND with", "other", {"this": 1, "with": 1}, _AND),
]
for _name, _text, _method, _bag, _condition in RANKED:
    found[_name] = _ranked_query(_text, _method)
    sql[_name] = _score_sql(_method, _bag, _condition) + "SELECT doc_id, round(score, 6) AS score FROM r"

_ANY3 = " OR ".join(_flag(t) for t in ("this", "with", "are"))
_BAG3 = {"this": 1, "with": 1, "are": 1}


@register(_score_sql("bm25", _BAG3, _ANY3) + "SELECT doc_id, round(score, 6) AS score FROM r")
def or_search(spark, sf_dir):
    return SearchEngine(plain_index(spark, sf_dir), "bm25").search_any("this with are").select("doc_id", six("score").alias("score"))


@register(_score_sql("bm25", {"this": 1, "with": 1}, _AND) + "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM r ORDER BY 1 LIMIT 10")
def topk_bm25(spark, sf_dir):
    return SearchEngine(plain_index(spark, sf_dir), "bm25").top("this with").withColumn("score", six("score"))


def _pruned(spark, sf_dir, text: str, method: str) -> DataFrame:
    blocks = pruned.build_blocks(plain_index(spark, sf_dir)).write(f"{shared_folder(spark)}/blocks")
    return pruned.pruned_top(blocks, boolean.parse(text, LETTERS), 10, method).rows.withColumn("score", six("score"))


@register(_score_sql("bm25", {"this": 1, "with": 1}, _AND) + "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM r ORDER BY 1 LIMIT 10")
def topk_pruned(spark, sf_dir):
    return _pruned(spark, sf_dir, "this with", "bm25")


@register(_score_sql("tfidf", _BAG3, _ANY3) + "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM r ORDER BY 1 LIMIT 10")
def topk_pruned_any(spark, sf_dir):
    return _pruned(spark, sf_dir, "this OR with OR are", "tfidf")


@register(_score_sql("bm25", _BAG3, _ANY3) + """SELECT lang, rank, doc_id, round(score, 6) AS score FROM (
SELECT d.lang, r.doc_id, r.score, row_number() OVER (PARTITION BY d.lang ORDER BY round(score, 9) DESC, r.doc_id) AS rank FROM r JOIN documents d ON d.doc_id = r.doc_id) WHERE rank <= 5""")
def topk_per_lang(spark, sf_dir):
    scored = SearchEngine(plain_index(spark, sf_dir), "bm25").search_any("this with are")
    with_lang = scored.join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return ranking.top_per_group(with_lang, "lang", 5).select("lang", "rank", "doc_id", six("score").alias("score"))


@register(_score_sql("tfidf", {"this": 1, "with": 1}, _AND) + """, a AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id FROM r),
b AS (SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id FROM r)
SELECT coalesce(a.rank, b.rank) AS rank, coalesce(CAST(a.doc_id AS VARCHAR), '-') AS ranked, coalesce(CAST(b.doc_id AS VARCHAR), '-') AS unranked
FROM a FULL JOIN b ON a.rank = b.rank WHERE coalesce(a.rank, b.rank) <= 5""")
def compare_ranked(spark, sf_dir):
    return SearchEngine(plain_index(spark, sf_dir), "tfidf").compare("this with")


@register(_boolean_sql(_AND) + " ORDER BY doc_id LIMIT 5")
def boolean_preview(spark, sf_dir):
    return SearchEngine(plain_index(spark, sf_dir), "none").top("this with", 5).select("doc_id")


@register(_score_sql("bm25", _BAG3, _ANY3) + "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, substr(CAST(doc_id AS VARCHAR), 1, 6) AS name, round(score / max(score) OVER (), 6) AS share FROM r ORDER BY 1 LIMIT 10")
def chart_scores(spark, sf_dir):
    return SearchEngine(plain_index(spark, sf_dir), "bm25").chart("this with are").withColumn("share", six("share"))


# --- evaluation ---------------------------------------------------------------------


@register(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS the_count, len(list_filter(w, lambda x: x = 'of')) AS of_count, len(w) AS total_terms,
  len(list_distinct(w)) AS unique_terms, list_contains(w, 'of') AS has_of FROM w""")
def doc_features(spark, sf_dir):
    return validation.doc_features(documents(spark, sf_dir), {"the": "the", "of": "of"}, "of")


def _stats_sql() -> str:
    parts = [_score_sql(m, _BAG3, _ANY3) + f"SELECT '{m}' AS method, doc_id, score FROM r" for m in validation.SCORED]
    union = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"""SELECT method, count(*) AS n, round(max(score), 6) AS highest, round(min(score), 6) AS lowest, round(avg(score), 6) AS mean,
  round(stddev_pop(score), 6) AS std, bool_and(score >= 0 AND score <= 1.001) AS in_unit_range, round(max(score) - min(score), 6) AS "range",
  max(score) - min(score) > 0.01 AS distinct_scores FROM ({union}) GROUP BY method"""


@register(_stats_sql())
def score_stats(spark, sf_dir):
    scores = validation.all_scores(SearchEngine(plain_index(spark, sf_dir)), ["this with are"])
    out = validation.score_stats(scores, ["method"])
    return out.select("method", "n", *[six(c).alias(c) for c in ("highest", "lowest", "mean", "std")], "in_unit_range", six("range").alias("range"), "distinct_scores")


@register(_score_sql("bm25", {"this": 1, "with": 1}, _AND) + "SELECT rank, CAST(1 AS BIGINT) AS n_variations, true AS stable FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rank FROM r) WHERE rank <= 5")
def ranking_stability(spark, sf_dir):
    engine = SearchEngine(plain_index(spark, sf_dir), "bm25")
    return validation.stability([engine.top("this with", 5) for _ in range(10)]).select("rank", F.size("variations").cast("long").alias("n_variations"), "stable")


# The ranking fixture's documents among those of the table: N, avgdl and df are the table's.
_FIXTURE = ", ".join(f"('{name}', '{text}')" for name, text in files.RANKING_DOCS)
_WITH_FIXTURE = BASE.replace("FROM documents", f"FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_FIXTURE}) f(doc_id, text))")
_FIXTURE_BAGS = {"apple": {"apple": 1}, "rare_term": {"rareterm": 1}, "apple banana": {"apple": 1, "banana": 1}}


def _fixture_sql() -> str:
    parts = [
        _score_sql(m, bag, " OR ".join(map(_flag, bag)), _WITH_FIXTURE) + f"SELECT '{m}' AS method, '{q}' AS query, doc_id, score FROM r"
        for m in validation.SCORED for q, bag in _FIXTURE_BAGS.items()]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def _fixture_scores(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(files.ranking_docs(spark))
    built = index.build_index(docs, LETTERS).write(f"{shared_folder(spark)}/fixture")
    return validation.all_scores(SearchEngine(built), list(_FIXTURE_BAGS))


@register(f"SELECT method, query, doc_id, round(score, 6) AS score FROM ({_fixture_sql()})")
def fixture_scores(spark, sf_dir):
    return _fixture_scores(spark, sf_dir).withColumn("score", six("score"))


def _principles_sql() -> str:
    names = lambda x: ", ".join(f"'{n}'" for n in sorted(x))
    least = lambda x: f"min(rank) FILTER (doc_id IN ({names(x)}))"
    rules = [
        ("frequent word ranks high", "apple AND method <> 'vector'", "coalesce(frequent <= 3, false)"), ("all documents with the rare word", "rare", f"n_rare = {len(validation.RARE)}"),
        ("both words rank high", "two", "coalesce(two_words <= 3, false)"), ("higher frequency first", "apple AND method = 'tfidf' AND higher IS NOT NULL AND lower IS NOT NULL", "higher < lower"),
        ("diverse documents near the top", "two AND method = 'vector'", "coalesce(diverse <= 3, false)")]
    checks = " UNION ALL ".join(f"""SELECT method, query, '{check}' AS "check", {holds} AS pass FROM a WHERE {applies}""" for check, applies, holds in rules)
    return f"""WITH s AS ({_fixture_sql()}), k AS (SELECT *, row_number() OVER (PARTITION BY method, query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
a AS (SELECT method, query, {least(validation.FREQUENT)} AS frequent, {least(validation.BOTH)} AS two_words, {least(validation.DIVERSE)} AS diverse,
  count(DISTINCT doc_id) FILTER (doc_id IN ({names(validation.RARE)})) AS n_rare, {least(['doc1.txt'])} AS higher, {least(['doc3.txt'])} AS lower,
  contains(query, 'apple') AND NOT contains(query, 'rare') AS apple, contains(query, 'rare_term') AS rare, contains(query, 'apple') AND contains(query, 'banana') AS two
  FROM k WHERE rank <= 5 GROUP BY method, query) {checks}"""


@register(_principles_sql())
def fixture_principles(spark, sf_dir):
    scores = _fixture_scores(spark, sf_dir).withColumn("group", F.concat_ws("/", "method", "query"))
    return validation.principles(ranking.top_per_group(scores, "group", 5).withColumn("name", base_name(F.col("doc_id"))))


@register("SELECT count(*) AS n_methods, true AS ascending, true AS measured FROM (VALUES ('none'), ('tfidf'), ('bm25'), ('vector')) v(method)")
def latency_report(spark, sf_dir):
    """Mean seconds per method are measured and come in ascending order; their values are no result."""
    rows = validation.method_latency(SearchEngine(plain_index(spark, sf_dir)), ["this AND with", "was OR are"])
    order = F.array_agg("mean_seconds")
    return rows.agg(F.count("*").alias("n_methods"), (order == F.array_sort(order)).alias("ascending"), F.bool_and(F.col("mean_seconds") > 0).alias("measured"))


@register(BASE + """SELECT layout, q.term AS query, df.df AS found, true AS measured
FROM (VALUES ('rows'), ('lists'), ('binary')) l(layout) CROSS JOIN (VALUES ('this'), ('with')) q(term) JOIN df ON df.term = q.term""")
def layout_report(spark, sf_dir):
    """Postings of a term from three layouts: rows, lists and the binary form."""
    i, root = plain_index(spark, sf_dir), shared_folder(spark)
    index.inverted_lists(i.postings).write.parquet(f"{root}/lists")
    codec.encoded_chunks(i.postings).write.parquet(f"{root}/binary")
    lists, binary = spark.read.parquet(f"{root}/lists"), spark.read.parquet(f"{root}/binary")
    layouts = {
        "rows": lambda q: i.term_postings(q).select("doc_id"),
        "lists": lambda q: lists.where(F.col("term") == q).select(F.explode("postings").alias("doc_id")),
        "binary": lambda q: codec.decode_chunks(binary.where(F.col("term") == q)).select("doc_id"),
    }
    found = None
    for name, f in layouts.items():
        for q in ("this", "with"):
            one = f(q).agg(F.count("*").alias("found")).select(F.lit(name).alias("layout"), F.lit(q).alias("query"), "found")
            found = one if found is None else found.unionByName(one)
    seconds = validation.compare_layouts(layouts, ["this", "with"], spark)
    return found.join(seconds, ["layout", "query"]).select("layout", "query", "found", ((F.col("seconds") > 0) & (F.col("times") > 0)).alias("measured"))


@register(BASE + """SELECT n_files, CAST(ceil(total_tokens / 5001) AS BIGINT) AS n_blocks, true AS times_measured, true AS driver_measured, true AS executors_measured FROM c""")
def build_report(spark, sf_dir):
    """The report of a build: how many files and blocks; that its times and memory were measured."""
    docs, path = documents(spark, sf_dir), f"{shared_folder(spark)}/index"
    built = []
    seconds = {"listing": validation.timed(docs.count), "indexing": validation.timed(lambda: built.append(index.build_index(docs, LETTERS).write(path)))}
    n_blocks = index.block_stats(built[0].doc_stats, 5000).count()
    heap = validation.executor_memory(spark).agg(F.max("heap_mb")).first()[0]
    report = files.metrics_report(spark, seconds | {"total": sum(seconds.values())}, {"driver_peak": validation.peak_memory_mb(), "executor_heap_peak": heap}, n_blocks)
    return report.select(
        F.lit(built[0].corpus["n_files"]).cast("long").alias("n_files"), "n_blocks", ((F.col("listing_s") > 0) & (F.col("indexing_s") > 0)).alias("times_measured"),
        (F.col("driver_peak_mb") > 1).alias("driver_measured"), (F.col("executor_heap_peak_mb") >= 0).alias("executors_measured"))


_PROMPT = _score_sql("bm25", {"this": 1, "with": 1}, _AND)


@register(_PROMPT + """, o AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS i, row_number() OVER (ORDER BY doc_id) AS j, doc_id FROM r),
n AS (SELECT count(*) AS n FROM r)
SELECT CAST(line AS INTEGER) AS line, said FROM (
  SELECT 0 AS line, 'ranking: bm25' AS said
  UNION ALL SELECT i, i || '. ' || doc_id FROM o WHERE i <= 10
  UNION ALL SELECT 11, '... and ' || (n - 10) || ' more' FROM n WHERE n > 10
  UNION ALL SELECT 11 + a.i, a.i || '. ' || a.doc_id || ' | ' || b.doc_id FROM o a JOIN o b ON b.j = a.i WHERE a.i <= 5
  UNION ALL SELECT 17, 'no documents'
  UNION ALL SELECT 18, 'ranking: tfidf'
  UNION ALL SELECT 19, 'not a query: NOT lacks an operand in ' || chr(39) || 'NOT' || chr(39))""")
def prompt_session(spark, sf_dir):
    """What the prompt answers to a session of all its commands."""
    asked = iter(["!ranking bm25", "this with", "!compare this with", "nosuchword", "!ranking nonsense", "NOT", "!quit"])
    said: list[str] = []
    prompt(SearchEngine(plain_index(spark, sf_dir)), lambda _: next(asked), said.append)
    return spark.createDataFrame(list(enumerate(said)), "line int, said string")


# --- stemmed ------------------------------------------------------------------------


@register(STEMMED + "SELECT term, df, cf FROM df")
def stemmed_term_df(spark, sf_dir):
    return index_of(spark, sf_dir, LETTERS_PORTER).term_stats


@register(STEMMED + "SELECT term, doc_id, tf FROM p")
def stemmed_postings(spark, sf_dir):
    return index_of(spark, sf_dir, LETTERS_PORTER).postings.drop("dl")


@register(_score_sql("bm25", {"thi": 1, "with": 1}, f"{_flag('thi')} AND {_flag('with')}", STEMMED) + "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM r ORDER BY 1 LIMIT 10")
def stemmed_topk_bm25(spark, sf_dir):
    return SearchEngine(index_of(spark, sf_dir, LETTERS_PORTER), "bm25").top("this with").withColumn("score", six("score"))


def queries() -> dict[str, Query]:
    return dict(found)


def oracle_sql() -> dict[str, str]:
    return dict(sql)
