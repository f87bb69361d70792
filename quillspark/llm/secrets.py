r"""Secret scans: a random forest over Spark expressions removes false positives.

Candidates are values assigned to a telling key (six characters or more) and bare strings of
16 or more word characters with a digit. Each gets integers for its length, character
classes and their transitions, the shares that dictionary words and words of placeholders
cover, its likeness to a path, and its neighbouring words. A forest of decision trees
learned from labelled findings is emitted as ``CASE`` expressions; candidates with a mean
vote of at least ``threshold`` are secrets. Everything runs on whole texts as SQL
expressions; only the fit of the forest, on a bounded table of labelled findings, runs on
the driver.

The dictionary is a list of words, such as the most common whole words of a public
tokenizer's vocabulary (``dictionary_words``), at most ``_DICTIONARY_LIMIT`` of them. Without
a table of labelled findings ``labelled_findings`` composes one from kinds of values and
kinds of contexts.

Defined results: a null or empty text has no findings; a value that occurs again is found
again; very long texts are scanned whole, their candidates in one array; repeated rows give
repeated findings; other columns pass through, clashing ones are replaced; an empty table
gives no rows. ``fit`` looks at no more than ``rows`` findings, the first in the order of a
hash of theirs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.quality import let

MASK = "[SECRET]"
_KEY = r"""(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?)"""
# The digit may stand anywhere: letters before it are passed once, without going back.
_BARE = r"(?<![\w+/=-])(?=[a-zA-Z_+/=-]*+[0-9])[\w+/=-]{16,}"
CANDIDATE = rf"""{_KEY}[^\s"'<>]{{6,}}|{_BARE}"""
_PREFIX = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|rk_live_|eyJ)"
# Words and parts of placeholders, identifiers and paths that real secrets rarely hold.
_PARTS = r"(?:example|sample|dummy|placeholder|changeme|change|default|insert|replace|enter|your|here|test|demo|fake|none|null|true|false|value|string|password|secret|token|user|name|admin|local|host|public|config|class|handler|account|image|file|page|index|http|html|json|lib|usr|bin|src|node|modules|packages|site|the|and|tion|ing|ment|xxxx|abcd|1234|0000)"
_NEAR_KEYS = r"(?i)\b(?:\w*(?:password|passwd|pwd|secret|token|key|credential|bearer|authorization|auth|login)\w*)\b"
_NEAR_OTHERS = r"(?i)\b(?:commit|revision|sha1|sha256|sha512|md5|checksum|digest|hash|etag|uuid|guid|isbn|card|order|invoice|build|version|file|img|image|path|url|see|call)\b"
_CONTEXT = 48
_DICTIONARY_LIMIT = 4000
_BLOCK = 256


def _left_over(v: Column, pattern: str) -> Column:
    """Length of what is left when matches of ``pattern`` are deleted."""
    return F.length(F.regexp_replace(v, pattern, ""))


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def dictionary_words(path: str, size: int = 2000, least: int = 4) -> list[str]:
    """The first ``size`` whole words of ``least`` letters or more in a tokenizer file's vocabulary, which is in order of frequency."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    return list(islice((w for w in whole if len(w) >= least and w.isascii() and w.isalpha() and w.islower()), size))


def _covered(value: Column, dictionary: list[str]) -> Column:
    """Characters in dictionary words; words end where letters end or a new one begins with a capital."""
    if not dictionary:
        return F.lit(0)
    words = F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    known = F.transform(words, lambda w: F.when(F.lower(w).isin(dictionary), F.length(w)).otherwise(F.lit(0)))
    return F.aggregate(known, F.lit(0), lambda a, x: a + x)


def features(value: Column, before: Column, source: Column, dictionary: list[str]) -> dict[str, Column]:
    n = F.length(value)
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^a-zA-Z0-9]+", "_")
    return {
        "length": n,
        "digits": n - _left_over(value, "[0-9]+"),
        "upper": n - _left_over(value, "[A-Z]+"),
        "lower": n - _left_over(value, "[a-z]+"),
        "other": _left_over(value, "[0-9A-Za-z]+"),
        "transitions": F.floor(100 * (F.length(runs) - 1) / F.greatest(n, F.lit(1))).cast("int"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))),
        "hex": _flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)[^0-9A-Za-z]*$")),
        "dictionary": F.floor(100 * _covered(value, dictionary) / F.greatest(n, F.lit(1))).cast("int"),
        "placeholder": F.floor(100 * (n - _left_over(F.lower(value), _PARTS)) / F.greatest(n, F.lit(1))).cast("int"),
        "path": _left_over(value, "[^/.]+"),
        "source_path": _flag(F.coalesce(source, F.lit("")).rlike("(?i)(?:test|example|fixture|spec|docs?)(?:[/_.-]|$)")),
        "near_keys": _flag(before.rlike(_NEAR_KEYS)),
        "near_others": _flag(F.right(before, F.lit(24)).rlike(_NEAR_OTHERS)),
        "assigned": _flag(before.rlike("""[:=][ \t]{0,3}["']?$""")),
        "prefix": _flag(value.rlike(_PREFIX)),
        "uuid": _flag(value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-")),
    }


NAMES = ("length", "digits", "upper", "lower", "other", "transitions", "distinct", "hex", "dictionary", "placeholder", "path", "source_path", "near_keys", "near_others", "assigned", "prefix", "uuid")


def _starts(parts: Column, matches: Column) -> Column:
    """Where each match begins: prefix sums in blocks, so that many matches cost no square."""
    lengths = F.transform(matches, lambda m, k: F.length(F.get(parts, k)) + F.length(m))
    add = lambda a, x: a + x

    def from_lengths(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add))
        bases = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return let(bases, lambda base: F.transform(matches, lambda m, k: F.get(base, F.floor(k / _BLOCK).cast("int"))
                   + F.aggregate(F.slice(n, F.floor(k / _BLOCK).cast("int") * _BLOCK + 1, F.pmod(k, F.lit(_BLOCK))), F.lit(0), add) + F.length(F.get(parts, k))))

    return let(lengths, from_lengths)


def _candidates(parts: Column, matches: Column, source: Column, dictionary: list[str]) -> Column:
    def one(start: Column, k: Column) -> Column:
        match = F.get(matches, k)
        value = F.regexp_replace(match, "^" + _KEY, "")

        def of_value(v: Column) -> Column:
            lead = F.substring(match, F.lit(1), F.length(match) - F.length(v))
            before = F.concat(F.right(F.get(parts, k), F.lit(_CONTEXT)), lead)
            return F.struct((start + F.length(lead)).alias("start"), lead.alias("lead"), v.alias("value"), F.array(*[c.cast("int") for c in features(v, before, source, dictionary).values()]).alias("features"))

        return let(value, of_value)

    return F.transform(_starts(parts, matches), one)


def _with_candidates(text: Column, source: Column, dictionary: list[str], body, none: Column) -> Column:
    """``body(parts, matches, candidates)``, or ``none`` for a text without candidates."""
    t = F.coalesce(text, F.lit(""))

    def of_matches(m: Column) -> Column:
        full = let(F.split(t, CANDIDATE, -1), lambda p: let(_candidates(p, m, source, dictionary), lambda c: body(p, m, c)))
        return F.when(F.size(m) == 0, none).otherwise(full)

    return let(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), of_matches)


@dataclass
class Node:
    feature: int = -1
    threshold: int = 0
    low: "Node | None" = None
    high: "Node | None" = None
    vote: float = 0.0

    def expression(self, values: Column) -> Column:
        if self.low is None:
            return F.lit(round(self.vote, 6))
        return F.when(F.get(values, F.lit(self.feature)) <= self.threshold, self.low.expression(values)).otherwise(self.high.expression(values))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), round(self.vote, 6))
        return np.where(x[:, self.feature] <= self.threshold, self.low.score(x), self.high.score(x))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 4) -> Node:
    """A tree by the lowest Gini impurity among a random part of the features at each node."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return Node(vote=float(y.mean()))
    best = None
    for j in rng.permutation(x.shape[1])[: max(2, round(x.shape[1] ** 0.5) + 1)]:
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(v))
        cut = (v[1:] > v[:-1]) & (n >= least) & (n <= len(v) - least)
        if not cut.any():
            continue
        p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
        impurity = np.where(cut, n * p * (1 - p) + (len(v) - n) * q * (1 - q), np.inf)
        at = int(impurity.argmin())
        if best is None or impurity[at] < best[0]:
            best = (impurity[at], int(j), int(v[at]))
    if best is None:
        return Node(vote=float(y.mean()))
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[low], y[low], rng, depth - 1, least), grow(x[~low], y[~low], rng, depth - 1, least))


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 0) -> list[Node]:
    rng = np.random.default_rng(seed)
    draws = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return [grow(x[d], y[d].astype(float), rng, depth) for d in draws]


def probability(trees: Sequence[Node], values: Column) -> Column:
    total = trees[0].expression(values)
    for t in trees[1:]:
        total = total + t.expression(values)
    return total / len(trees)


@dataclass(frozen=True)
class Model:
    trees: tuple[Node, ...]
    dictionary: tuple[str, ...] = ()


def _pick(salt: int, options: list[str]) -> str:
    return f"element_at(array({', '.join(options)}), cast(pmod(xxhash64(id, {salt}), {len(options)}) as int) + 1)"


def _text(value: str) -> str:
    return '"' + value.replace('"', '\\"') + '"'


# SQL of values, made from digests of the row number, and of what stands before and after them.
_HEX = "concat(sha2(cast(id as string), 256), sha2(cast(-id as string), 256))"
_BASE64 = "translate(base64(unhex(concat(sha2(cast(id as string), 256), sha2(cast(-id as string), 256)))), '=+/\\r\\n', 'xyz')"
_DIGITS = "translate(substr(sha2(cast(id as string), 256), 1, 16), 'abcdef', '012345')"
_LENGTH = "cast({} + pmod(xxhash64(id, 9), {}) as int)"
_KEYS = ["token = ", "TOKEN = ", "token: ", "api_key=", "API-KEY: ", "apikey = ", "password: ", "passwd=", "secret = ", "client_secret=", "auth_token = ", "access_key: ", "export GITHUB_TOKEN="]
_QUOTES = ["", '"', '"', "'"]
_AFTER = ["", ".", "!!", "###", " ", ","]
_AROUND = ["was of the there. ", "Inor ent. ", "le un des ", "der im und ", "", "and on thhe ", "el que los "]
_SECRET_VALUES = {
    "hex": f"substr({_HEX}, 1, {_LENGTH.format(24, 41)})",
    "hex40": f"substr({_HEX}, 1, 40)",
    "upper": f"upper(substr({_HEX}, 1, {_LENGTH.format(24, 41)}))",
    "mixed": f"concat(substr({_BASE64}, 1, {_LENGTH.format(16, 40)}), '7')",
    "short": f"concat(substr({_BASE64}, 1, {_LENGTH.format(10, 8)}), '!4')",
}
_BARE_SECRETS = {
    "aws": f"concat('aws access key AKIA', upper(substr({_BASE64}, 1, 15)), '9')",
    "bearer": f"concat('Authorization: Bearer ', substr({_BASE64}, 1, 60), '3')",
    "stripe": f"concat('stripe sk_live_', substr({_BASE64}, 1, 24), '1')",
    "github": f"concat('login with ghp_', substr({_BASE64}, 1, 35), '2')",
}
_ID_WORDS = [_text(w) for w in ("account", "handler", "manager", "session", "default", "service", "project", "window", "master", "system")]
_FALSE_VALUES = {
    "your": f"concat('your_', {_pick(3, [_text(w) for w in ('token', 'api_key', 'password', 'secret')])}, '_here_1234')",
    "changeme": "concat('changeme', cast(pmod(id, 1000) as string), '456')",
    "example": "concat('EXAMPLEKEY', lpad(cast(pmod(id, 97) as string), 8, '0'))",
    "word": f"concat({_pick(4, _ID_WORDS)}, '-', {_pick(5, _ID_WORDS)})",
    "xs": "concat('xxxxxxxx', substr('xxxxxxxxxxxx', 1, cast(pmod(id, 12) as int)), '0000')",
}
_BARE_FALSE = {
    **{w: f"concat('{w} ', substr({_HEX}, 1, {n}))" for w, n in (("commit", 40), ("sha256", 64), ("md5 checksum", 32), ("etag", 40), ("revision", 40), ("digest:", 64), ("build", 32))},
    "uuid": f"concat('id ', concat_ws('-', substr({_HEX}, 1, 8), substr({_HEX}, 9, 4), substr({_HEX}, 13, 4), substr({_HEX}, 17, 4), substr({_HEX}, 21, 12)))",
    **{w or "digits": f"concat('{w} ', {_DIGITS}, '{tail}')" for w, tail in (("", ""), ("card", ""), ("order", "0"), ("invoice", "11"))},
    "path": f"concat('see /usr/lib/python3/', {_pick(6, _ID_WORDS)}, '-packages/x', cast(pmod(id, 9) as string))",
    "call": f"concat('call get', initcap({_pick(7, _ID_WORDS)}), 'ById', cast(pmod(id, 99) as string), initcap({_pick(8, _ID_WORDS)}), 'Test')",
    "image": "concat('IMG_20231115_0930', cast(100000 + id as string), '_file')",
}
KINDS = [*_SECRET_VALUES, *_BARE_SECRETS, *_FALSE_VALUES, *_BARE_FALSE]


def labelled_findings(spark: SparkSession, rows: int = 3200, kinds: list[str] = KINDS) -> DataFrame:
    """Findings to learn from: text, source, kind and is_secret, half of them secrets."""
    picked = lambda salt, values: _pick(salt, [_text(v) for v in values])
    quote = picked(2, _QUOTES)

    def told(values: dict[str, str], bare: dict[str, str]) -> str:
        options = [f"struct('{k}' as kind, concat({picked(1, _KEYS)}, {quote}, {v}, {quote}, {picked(10, _AFTER)}) as x)" for k, v in values.items() if k in kinds]
        options += [f"struct('{k}' as kind, {v} as x)" for k, v in bare.items() if k in kinds]
        return _pick(11, options)

    found = spark.range(rows).selectExpr("id", f"case when id % 2 = 0 then {told(_SECRET_VALUES, _BARE_SECRETS)} else {told(_FALSE_VALUES, _BARE_FALSE)} end as f")
    return found.selectExpr(
        f"concat({picked(12, _AROUND)}, f.x, ' ', {picked(13, _AROUND)}) as text", "case when id % 11 = 0 then 'src/main' else 'src3' end as source", "f.kind as kind", "id % 2 = 0 as is_secret")


def fit(spark: SparkSession, dictionary: list[str] = [], findings: DataFrame | None = None, rows: int = 5000) -> Model:
    """Learn from at most ``rows`` candidates of labelled findings (text, source, is_secret)."""
    dictionary = dictionary[:_DICTIONARY_LIMIT]
    findings = labelled_findings(spark) if findings is None else findings
    c = _with_candidates(F.col("text"), F.col("source"), dictionary, lambda p, m, c: F.transform(c, lambda x: x["features"]), F.array().cast("array<array<int>>"))
    found = findings.select("is_secret", F.xxhash64("text", "source").alias("h"), F.explode(c).alias("f"))
    got = found.orderBy("h", "f", "is_secret").limit(rows).collect()
    if not got:
        return Model((Node(),), tuple(dictionary))
    return Model(tuple(forest(np.asarray([r["f"] for r in got], np.int64), np.asarray([r["is_secret"] for r in got], bool))), tuple(dictionary))


def _finding(c: Column, model: Model, threshold: float) -> Column:
    values = c["features"]
    kind = F.when(F.get(values, F.lit(NAMES.index("prefix"))) == 1, "prefixed").when(F.get(values, F.lit(NAMES.index("hex"))) == 1, "hex").otherwise("opaque")
    return let(probability(model.trees, values), lambda p: F.struct(
        c["start"].alias("start"), F.length(c["value"]).alias("length"), kind.alias("kind"), c["value"].alias("value"), F.round(p, 6).alias("probability"), (p >= threshold).alias("is_secret")))


_FINDINGS = "array<struct<start:int,length:int,kind:string,value:string,probability:double,is_secret:boolean>>"


def _source(df: DataFrame, source: str) -> Column:
    return F.col(source) if source in df.columns else F.lit("")


def scan(df: DataFrame, model: Model, text: str = "text", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """Add ``findings``: every candidate with its span in code points, its value and its score."""
    found = _with_candidates(F.col(text), _source(df, source), list(model.dictionary), lambda p, m, c: F.transform(c, lambda x: _finding(x, model, threshold)), F.array().cast(_FINDINGS))
    return df.withColumn("findings", found)


def redact(df: DataFrame, model: Model, text: str = "text", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """Replace the secrets in ``text`` by a mask; all else stays as it is."""

    def body(parts: Column, matches: Column, candidates: Column) -> Column:
        kept = F.transform(candidates, lambda c, k: F.when(probability(model.trees, c["features"]) >= threshold, F.concat(c["lead"], F.lit(MASK))).otherwise(F.get(matches, k)))
        return let(kept, lambda m: F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.coalesce(F.get(m, k), F.lit("")))), ""))

    t = F.col(text)
    return df.withColumn(text, F.when(t.isNotNull(), _with_candidates(t, _source(df, source), list(model.dictionary), body, t)))


def query(docs: DataFrame, dictionary: list[str]) -> DataFrame:
    model = fit(docs.sparkSession, dictionary)
    f = scan(docs.select("doc_id", "source", "text"), model).select("doc_id", F.explode("findings").alias("f"))
    return f.select("doc_id", F.col("f.start").alias("start"), F.col("f.length").alias("length"), F.col("f.kind").alias("kind"), F.sha2(F.encode("f.value", "UTF-8"), 256).alias("value_sha256"), F.col("f.probability").alias("probability"), F.col("f.is_secret").alias("is_secret"))
