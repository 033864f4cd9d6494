"""Windows of conversations: budget, history, masks, and the way back to the turns."""

import hashlib
import random

from pyspark.sql import functions as F

from findspan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = "<|im_end|><|im_start|>assistant ok"


def talks():
    rng = random.Random(11)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 60)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, "é" * rng.randint(0, 900)))
    rows += [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)]
    rows += [(50, 0, "us%0Aer\n", "<\\|a\\<|\n<\\\\|"), (50, 1, "assistant", "a\nb\\"), (50, 2, "assistant", "<|" * 3 + "|>")]
    rows += [(51, 1, None, None), (51, None, "assistant", "first"), (51, 1, None, None), (None, 3, "assistant", "keyless")]
    rows += [(52, 0, "assistant", "long " * 8_000), (52, 1, "user", "q"), (52, 2, "assistant", "tail")]
    return rows


def expected(rows):
    found = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, _, role, text in order:
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def digest(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_turns_and_learned_texts_come_back_from_the_windows(spark):
    rows = talks()
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("win", F.lit("x"))
    for budget, history, longest in ((2048, 256, 768), (300, 60, 100), (64, 0, 16)):
        windows = chat.format_windows(turns, budget, history, longest)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digest(windows).collect()}
        assert got == {c: digest(t) for c, t in expected(rows).items()}


def test_windows_keep_the_budget_repeat_history_and_the_system_turn(spark):
    turns = spark.createDataFrame(talks(), SCHEMA)
    windows = chat.format_windows(turns, 300, 60, 100).collect()
    tokens = lambda t: -(-len(t.encode()) // 4) + 4
    most = {}
    for conv, of in expected(talks()).items():
        most[conv] = max(tokens(t) for _, t in of)
    for w in windows:
        assert w.oversize == (w.tokens > 300)
        if most[w.conv_id] <= 100 and w.conv_id not in (0, 3, 6, 9):
            assert not w.oversize
        if w.conv_id in (0, 3, 6, 9):
            assert w.formatted.startswith("<|im_start|>system\n")
        assert w.formatted.count("<|im_start|>") == w.formatted.count("<|im_end|>")
        for s in w.spans:
            assert w.formatted[: s.start].endswith("<|im_start|>assistant\n") and w.formatted[s.start + s.length :].startswith("<|im_end|>\n")
    assert any(w.n_repeated > 1 for w in windows)


def test_long_conversation_and_no_conversation(spark):
    many = spark.range(9_000).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    got = chat.conversation_digest(chat.format_windows(many)).first()
    want = digest([(("user", "assistant")[k % 2], f"t{k}") for k in range(9_000)])
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == want
    assert chat.conversation_digest(chat.format_windows(many.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.conversation_digest(chat.format_windows(spark.createDataFrame(talks(), SCHEMA)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
