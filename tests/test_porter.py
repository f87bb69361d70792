import pytest

from quillspark.functions.porter import measure, stem

PAIRS = """caresses caress|ponies poni|ties tie|dies die|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing
conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|enjoy enjoy|by by
relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|conformabli conform|radicalli radic|differentli differ|vileli vile|analogousli analog
vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl
triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good
revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler
probate probat|rate rate|cease ceas|controll control|roll roll|apple appl|orange orang|cherry cherri|elderberry elderberri|are are|skies sky|dying die|news news|innings inning|proceed proceed
spied spi|tied tie|archaeology archaeolog|generically gener|hopefully hope"""


@pytest.mark.parametrize("pair", [p for line in PAIRS.split("\n") for p in line.split("|")])
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_measure():
    assert [measure(w) for w in ("tr", "ee", "tree", "trouble", "oats", "troubles", "oaten")] == [0, 0, 0, 1, 1, 2, 2]


def test_column_equals_function(spark):
    from pyspark.sql import functions as F

    from quillspark.functions.porter import stem_column

    words = ["apple", "running", "apple", "skies", "a"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.s for r in df.select(stem_column(F.col("w")).alias("s")).collect()] == [stem(w) for w in words]


def test_sql_form_equals_the_function():
    """The oracle's chain of CTEs against the stemmer, on words made of all suffixes."""
    import random

    import duckdb

    from quillspark.functions.porter import STEP2, STEP3, STEP4
    from quillspark.functions.porter_sql import stems_sql

    rng = random.Random(1)
    ends = [a for a, _ in STEP2 + STEP3] + STEP4 + ["ed", "ing", "s", "ies", "ied", "eed", "y", "e", "ll", "sses", "ss", ""]
    words = {w for line in PAIRS.split("\n") for p in line.split("|") for w in p.split()}
    words |= {"".join(rng.choice("abcdeiolstyyzvx") for _ in range(rng.randint(1, 6))) + "".join(rng.choice(ends) for _ in range(rng.randint(0, 3))) for _ in range(20_000)}
    con = duckdb.connect()
    con.execute("CREATE TABLE d (term VARCHAR)")
    con.execute("INSERT INTO d SELECT unnest(?)", [sorted(words)])
    got = dict(con.execute("WITH " + stems_sql("SELECT term FROM d") + " SELECT term, stem FROM stems").fetchall())
    assert got == {w: stem(w) for w in words}
