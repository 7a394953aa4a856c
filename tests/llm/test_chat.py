import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|user|>", "\\", "\\\\</s>", "<", "|", "<|", "|>", "<|>", "<<SYS>>", "a\\", "", "<</SYS>></s>",
         "<\\/s>", "é\n\n", "<s"]


def turns_of(windows):
    found = {}
    for r in sorted(chat.read_turns(windows).collect(), key=lambda r: (r.window, r.place)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    return found


def targets_of(windows):
    found = {}
    for r in sorted(chat.read_targets(windows).collect(), key=lambda r: (r.window, r.place)):
        found.setdefault(r.conv_id, []).append(r.text)
    return found


def test_control_strings_read_back(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "x string")
    rows = df.select("x", chat.escaped(F.col("x")).alias("e"), chat.unescaped(chat.escaped(F.col("x"))).alias("u")).collect()
    assert all(r.x == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in chat.CONTROL)


@pytest.mark.parametrize("budget,history", [(60, 20), (512, 128), (30, 10)])
def test_every_turn_is_new_once_and_windows_keep_to_the_budget(spark, budget, history):
    rows = []
    for c in range(6):
        if c % 2:
            rows.append((c, 0, "system", "be kind " * 3))
        rows += [(c, t, "user" if t % 2 else "assistant", f"{NASTY[t % len(NASTY)]} " + "w " * (t * (c + 1) % 23)) for t in range(1, 60)]
    rows += [(7, 0, "assistant", "long " * 400), (7, 1, "user", "x"), (8, 0, None, None), (None, 1, "assistant", "a"),
             (None, 0, "user", NASTY[0]), (9, None, "user", "first"), (9, 3, "user", "b"), (9, 3, "user", "b"), (9, 3, "assistant", "a"),
             (10, -5, "|>role<|", "odd")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("window", "block", "tokens", "of", "before")})
    windows = chat.formatted(df, budget, history).cache()
    want, answers = {}, {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
        if role == "assistant":
            answers.setdefault(c, []).append(text or "")
    assert turns_of(windows) == want and targets_of(windows) == answers
    for w in windows.collect():
        n_new = w.text.count(chat.END) - w.n_context
        assert n_new >= 1 and (w.n_tokens <= budget or n_new == 1)
    later = [w for w in windows.where("conv_id = 3").collect() if w.n_context]
    assert later and all(w.text.startswith("<|system|>be kind") for w in later)
    windows.unpersist()


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
