"""Porter's algorithm as plain SQL, step by step as CTEs: an independent form of the stemmer for the oracles.

A word's shape has C for a consonant and V for a vowel; the measure of a stem is how often
VC occurs in its shape.
"""

from __future__ import annotations

from quillspark.functions.porter import IRREGULAR, STEP2, STEP3, STEP4


def _shape(word: str) -> str:
    """y is a consonant first and after a vowel; each round settles the next letter of a run of y."""
    out = f"translate({word}, 'aeioubcdfghjklmnpqrstvwxz', 'VVVVVCCCCCCCCCCCCCCCCCCCC')"
    out = f"regexp_replace({out}, '^y', 'C')"
    for _ in range(8):
        out = f"replace(replace({out}, 'Cy', 'CV'), 'Vy', 'VC')"
    return out


def _measure(shape: str) -> str:
    return f"((length({shape}) - length(replace({shape}, 'VC', ''))) // 2)"


def _cut(n: int, of: str = "x") -> str:
    return f"left({of}, length({of}) - {n})"


def _short(word: str, shape: str) -> str:
    return f"(({shape} LIKE '%CVC' AND right({word}, 1) NOT IN ('w', 'x', 'y')) OR {shape} = 'VC')"


def _replaced(rules: list[tuple[str, str]], condition) -> str:
    """The first suffix that fits decides."""
    cases = " ".join(f"WHEN x LIKE '%{a}' THEN CASE WHEN {condition(a)} THEN {_cut(len(a))} || '{b}' ELSE x END" for a, b in rules)
    return f"CASE {cases} ELSE x END"


def stems_sql(words: str, name: str = "stems") -> str:
    """CTEs that end in ``name`` (term, stem) for the distinct words of the query ``words`` (term)."""
    plural = f"CASE WHEN x LIKE '%ies' AND length(x) = 4 THEN {_cut(1)} WHEN x LIKE '%sses' THEN {_cut(2)} WHEN x LIKE '%ies' THEN {_cut(2)} WHEN x LIKE '%ss' THEN x WHEN x LIKE '%s' THEN {_cut(1)} ELSE x END"
    past = f"CASE WHEN x LIKE '%ied' OR x LIKE '%eed' THEN 0 WHEN x LIKE '%ed' AND contains({_cut(2, 's')}, 'V') THEN 2 WHEN x LIKE '%ing' AND contains({_cut(3, 's')}, 'V') THEN 3 ELSE 0 END"
    bare = "left(x, length(x) - k)"
    bare_s = "left(s, length(s) - k)"
    double = f"(length({bare}) > 1 AND right({bare}, 1) = left(right({bare}, 2), 1) AND {bare_s} LIKE '%C')"
    after_past = f"""CASE WHEN x LIKE '%ied' THEN CASE WHEN length(x) = 4 THEN {_cut(1)} ELSE {_cut(2)} END
      WHEN x LIKE '%eed' THEN CASE WHEN {_measure(_cut(3, 's'))} > 0 THEN {_cut(1)} ELSE x END
      WHEN k = 0 THEN x WHEN right({bare}, 2) IN ('at', 'bl', 'iz') THEN {bare} || 'e'
      WHEN {double} THEN CASE WHEN right({bare}, 1) IN ('l', 's', 'z') THEN {bare} ELSE left({bare}, length({bare}) - 1) END
      WHEN {_measure(bare_s)} = 1 AND {_short(bare, bare_s)} THEN {bare} || 'e' ELSE {bare} END"""
    final_y = f"CASE WHEN x LIKE '%y' AND length(x) > 2 AND left(right(s, 2), 1) = 'C' THEN {_cut(1)} || 'i' ELSE x END"
    alli = f"CASE WHEN x LIKE '%alli' AND {_measure(_cut(4, 's'))} > 0 THEN {_cut(2)} ELSE x END"
    second = _replaced(STEP2, lambda a: f"{_measure(_cut(len(a), 's') + (" || 'C'" if a == 'logi' else ''))} > 0")
    third = _replaced(STEP3, lambda a: f"{_measure(_cut(len(a), 's'))} > 0")
    fourth = _replaced([(a, "") for a in STEP4], lambda a: f"{_measure(_cut(len(a), 's'))} > 1" + (f" AND right({_cut(3)}, 1) IN ('s', 't')" if a == "ion" else ""))
    cut_s = _cut(1, "s")
    final_e = f"CASE WHEN x LIKE '%e' AND ({_measure(cut_s)} > 1 OR ({_measure(cut_s)} = 1 AND NOT {_short(_cut(1), cut_s)})) THEN {_cut(1)} ELSE x END"
    last = f"CASE WHEN x LIKE '%ll' AND {_measure(cut_s)} > 1 THEN {_cut(1)} ELSE x END"
    odd = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR.items())
    steps = [plural, None, after_past, final_y, alli, second, third, fourth, final_e, last]
    out = [f"{name}_odd AS (SELECT * FROM (VALUES {odd}) v(term, stem))", f"{name}_0 AS (SELECT term, term AS x, {_shape('term')} AS s FROM (SELECT DISTINCT term FROM ({words})) WHERE length(term) > 2)"]
    for i, step in enumerate(steps):
        if step is None:
            out.append(f"{name}_{i + 1} AS (SELECT term, x, s, {past} AS k FROM {name}_{i})")
        else:
            out.append(f"{name}_{i + 1} AS (SELECT term, x, {_shape('x')} AS s FROM (SELECT term, {step} AS x FROM {name}_{i}))")
    out.append(f"{name} AS (SELECT w.term, coalesce(o.stem, n.x, w.term) AS stem FROM (SELECT DISTINCT term FROM ({words})) w LEFT JOIN {name}_odd o ON o.term = w.term LEFT JOIN {name}_{len(steps)} n ON n.term = w.term)")
    return ",\n".join(out)
