import hashlib

from pyspark.sql import functions as F

from quillspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>", "<||im_end|>", "<", "|x", "<|turn|>", "\\|<|<||", "<|im_start|>assistant\nok<|im_end|>\n", None, "", "a\nb"]
    rows = [(1, i, r, t, "") for i, t in enumerate(texts) for r in (("user", "assistant")[i // 2 % 2],)]
    rows += [(2, 0, None, "<|im_end|>", ""), (2, 1, "ro\nle<|nl|>", "x", ""), (2, 2, "<|null|>", "y", ""), (None, 0, "user", "z", "")]
    out = chat.parse(chat.chat_format(spark.createDataFrame(rows, SCHEMA))).collect()
    got = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in out}
    assert got[1] == [(r, t or "", r == "assistant") for _, _, r, t, _ in rows[:10]]
    assert got[2] == [(None, "<|im_end|>", False), ("ro\nle<|nl|>", "x", False), ("<|null|>", "y", False)]
    assert got[None] == [("user", "z", False)]
    one = next(r.formatted for r in out if r.conv_id == 1)
    assert one.count("<|im_start|>") == 5 and one.count("<|turn|>") == 5


def test_merges_neighbours_and_sorts(spark):
    rows = [(1, 3, "assistant", "c", ""), (1, 1, "user", "a", ""), (1, 2, "user", "b", ""), (1, 2, "user", "b", "")]
    r = chat.chat_format(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "<|im_start|>user\na<|turn|>b<|turn|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [(b.role, b.texts) for b in r.blocks] == [("user", ["a", "b", "b"]), ("assistant", ["c"])]


def test_huge_conversation_and_clashing_columns(spark):
    n = 30_000
    turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id div 3 % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text", "'own' as formatted", "'own' as blocks")
    turns = turns.unionByName(turns.where("turn = 0").withColumn("conv_id", F.lit(2).cast("long")).withColumn("text", F.repeat(F.lit("x<|"), 500_000)))
    out = {r.conv_id: r for r in chat.parse(chat.chat_format(turns)).collect()}
    assert [t.text for t in out[1].turns] == [f"t{i}" for i in range(n)]
    assert out[1].formatted.count("<|im_start|>") == n // 3
    assert out[2].turns[0].text == "x<|" * 500_000


def test_query_holds_the_added_conversation(spark):
    r = chat.query(spark.createDataFrame([], SCHEMA)).collect()
    assert len(r) == 1 and r[0].conv_id == -1 and r[0].n_turns == 2
    text = "<|im_end|><|im_start|>assistant ok"
    assert r[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and r[0].loss_chars == len(text)


def test_plan_is_native(spark):
    df = chat.query(spark.createDataFrame([], SCHEMA).union(spark.range(5).select(F.col("id"), F.col("id"), F.lit("user"), F.lit("t"), F.lit(""))))
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
