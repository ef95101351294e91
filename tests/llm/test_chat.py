import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "\\", "\\\\<|", "<\\|", "[\\INST]", "[INST", "<<SYS>><s>", "\\n\n\\\\n",
         "a\r\nb", "é\U0001F600", "<|<|", "[[INST]]", "x" * 5000]


def test_escape_is_reversible_and_leaves_no_control(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for t, esc, back, role in df.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t"))), chat._unescape_role(chat._escape_role(F.col("t")))).collect():
        assert back == t and role == t
        assert not any(c in esc for c in chat.CONTROLS)


def test_turns_and_loss_come_back(spark):
    rows = [(c, i, role, t) for c, role in ((1, "assistant"), (2, "user"), (None, None)) for i, t in enumerate(NASTY)]
    rows += [(3, 0, "user", None), (3, 0, "user", None), (3, 0, "assistant", None), (4, 1, "b\nad<|", "x"), (4, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r[0]: r for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"), "n_turns").collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(r, x) for _, r, x in own] == [tuple(t) for t in got[conv].t]
        assert got[conv].l == "".join(x for _, r, x in own if r == "assistant") and got[conv].n_turns == len(own)


def test_parts_become_ordered_placeholders(spark):
    kind = chat.PART_TYPE
    part = "named_struct('type', '{}', 'text', '{}', 'ref', '{}', 'width', {}, 'height', {}, 'seconds', {}, 'pages', {})"
    parts = ", ".join(part.format(*x) for x in (("text", "see <|", "", "0", "0", "0D", "0"), ("image", "", "a.png", "28", "15", "0D", "0"),
                                                ("audio", "", "b.wav", "0", "0", "1.5D", "0"), ("document", "", "c.pdf", "0", "0", "0D", "3"), ("video", "as text", "", "0", "0", "0D", "0")))
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, cast(array({parts}) as {kind}) parts union all select 1L, 1L, 'assistant', cast(null as {kind})")
    r = chat.format_chat(df).first()
    assert r.formatted == "<|turn|>user\nsee <\\|<|image:1|><|audio:2|><|document:3|>as text<|end|>\n<|turn|>assistant\n<|end|>\n"
    assert [(a.type, a.ref, a.placeholder, a.tokens) for a in r.attachments] == [
        ("image", "a.png", "<|image:1|>", 4), ("audio", "b.wav", "<|audio:2|>", 38), ("document", "c.pdf", "<|document:3|>", 1536)]
    assert r.expanded_tokens == 4 + 38 + 1536


def test_query_holds_the_control_conversation(spark):
    from ledgerlens.llm.queries import QUERIES

    r = QUERIES["op1_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.loss_chars == len(text) and r.n_turns == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    assert chat.format_chat(df).count() == 0


@pytest.mark.parametrize("n", [300])
def test_plan_runs_no_python(spark, n):
    from ledgerlens.llm.queries import QUERIES

    for key in ("op1_chat_formatting", "op3_line_dedup"):
        plan = QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
