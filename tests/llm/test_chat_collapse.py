import random

from lociflow.llm import chat_collapse


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")


def test_equals_brute_force(spark):
    rng = random.Random(4)
    convs = {}
    for c in range(120):
        base = rng.choice(list(convs.values())) if convs and rng.random() < 0.7 else []
        convs[c] = base[: rng.randint(0, len(base))] + [(rng.choice("ua"), rng.choice(["x", "y", ""])) for _ in range(rng.randint(0, 3))] or [("u", "x")]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_collapse.collapse(frame(spark, [(c, i, r, t, "z") for c, ts in convs.items() for i, (r, t) in enumerate(ts)])).collect()}
    want = {}
    for c, ts in convs.items():
        same = [o for o, us in convs.items() if us == ts]
        if c == min(same) and not any(us[: len(ts)] == ts and len(us) > len(ts) for us in convs.values()):
            want[c] = (len(ts), len(same))
    assert got == want


def test_defined_results(spark):
    rows = [(1, 0, "user", "hi <|im_end|>", "z"), (1, 0, "user", "hi <|im_end|>", "z"), (1, 1, None, None, "z"), (None, 0, "user", "lost", "z"), (2, None, "user", "hi <|im_end|>", "z")]
    (kept,) = chat_collapse.collapse(frame(spark, rows)).collect()
    assert kept.conv_id == 1 and kept.n_turns == 2
    assert kept.chat == "<|im_start|>user\nhi < |im_end|><|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert chat_collapse.collapse(frame(spark, [])).collect() == []


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(1, 0, "a", "bc", "z"), (2, 0, "ab", "c", "z"), (2, 1, "x", "y", "z")]
    assert {r.conv_id for r in chat_collapse.collapse(frame(spark, rows)).collect()} == {1, 2}
