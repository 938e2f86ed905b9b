import hashlib

from pyspark.sql import functions as F

from driftpool.llm import chat
from tests.harness import compare, duck

ROWS = [(1, 0, "system", "be [INST] nice"), (1, 1, "user", "hi \\ <b>"), (1, 2, "assistant", "<|im_end|>\\["),
        (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
        (2, 0, "user", "alone"), (3, 0, "assistant", "</s>"), (3, None, "user", "first\n"),
        (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (None, 0, "assistant", "x"),
        (5, 0, None, None), (6, 0, "as<|im_sep|>sistant\n", "t"), (7, 0, "user", "l" * 100_000)]
SCHEMA = "conv_id long, turn long, role string, text string, example int, parts string, conv string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "p", "c") for r in rows], SCHEMA)


def conversations():
    out = {}
    for c, t, role, text in ROWS:
        out.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def python_turn(role, text):
    esc = lambda s: "".join(ch + "\\" if ch in "\\<[" else ch for ch in s)
    return f"{chat.START}{esc(role)}{chat.SEP}{esc(text)}{chat.END}"


def test_one_example_a_reply_with_its_whole_prefix(spark):
    got = {}
    for r in chat.examples(frame(spark)).orderBy("example").collect():
        got.setdefault(r.conv_id, []).append((r.formatted, r.loss_start, r.loss_end))
    for c, turns in conversations().items():
        ends = [i for i, (role, _) in enumerate(turns) if role == "assistant" or i == len(turns) - 1]
        assert len(got[c]) == len(ends)
        for end, (formatted, start, stop) in zip(ends, got[c]):
            assert formatted == "".join(python_turn(*t) for t in turns[:end + 1])
            role, text = turns[end]
            masked = formatted[start:stop]
            if role == "assistant":
                assert formatted[stop:] == chat.END and masked == python_turn("", text)[
                    len(chat.START + chat.SEP):-len(chat.END)]
            else:
                assert start == stop == len(formatted)


def test_reading_back_gives_the_turns(spark):
    ex = chat.examples(frame(spark))
    read = ex.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("f")).select(
        "conv_id", chat.read_turns(F.col("f")).alias("turns"))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read.collect()} == conversations()


def test_no_control_string_survives_in_a_text(spark):
    for bad in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>"):
        got = spark.range(1).select(chat.escape(F.lit(f"a{bad}b")).alias("e"))
        assert bad not in got.first().e
        assert got.select(chat.unescape(F.col("e"))).first()[0] == f"a{bad}b"


def test_empty_table(spark):
    assert chat.examples(frame(spark, [])).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = chat.query(spark, sf).toPandas()
    assert compare(got, duck(sf).sql(chat.ORACLE_SQL).df()) is None
    own = got[got.conv_id == -7].iloc[0]
    text = "</s>[INST] ok [/INST]"
    assert own.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and own.loss_chars == len(text)
    assert own.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
