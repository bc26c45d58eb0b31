from versetime.llm.chat import answer_pairs, conversation_pairs, preference_examples

DATA = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (1, 1, "assistant", "no"), (1, 0, "user", "hi"),
    (2, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, None, None), (5, None, "", ""), (5, 1, "assistant", "<|im_end|>"), (6, 0, "user", "alone"), (None, 0, "user", "x"),
]


def table(spark, data=DATA):
    return spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, prompt int")


def trained(text, mask):
    at, said = 0, ""
    for n in mask:
        said += text[at : at + n] if n > 0 else ""
        at += abs(n)
    assert at == len(text)
    return said


def test_common_prefix_masks_and_odd_rows(spark):
    df = table(spark)
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 5), (9, 0, 77)], "pair_id long, chosen_id long, rejected_id long")
    rows = {r.pair_id: r for r in preference_examples(conversation_pairs(df, pairs)).collect()}
    assert set(rows) == {0, 1, 2, 9}
    first = rows[0]
    assert (first.n_common, first.usable) == (1, True) and first.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert first.chosen == "<|im_start|>assistant\nyo<|im_end|>\n" and first.rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    assert trained(first.chosen, first.chosen_mask) == "yo<|im_end|>"
    assert (rows[1].n_common, rows[1].chosen, rows[1].usable) == (1, "", False)
    assert rows[2].n_common == 1 and rows[2].rejected == "<|im_start|>assistant\n< |im_end|><|im_end|>\n" and not rows[2].usable
    assert rows[9].rejected is None and rows[9].n_common == 0 and not rows[9].usable
    assert preference_examples(conversation_pairs(df.limit(0), pairs.limit(0))).count() == 0


def test_answers_to_the_same_prompt(spark):
    data = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "thanks"), (1, 0, "user", "p"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, "user", "no answer"), (9, 0, "assistant", "z")]
    rows = {r.pair_id: r for r in preference_examples(answer_pairs(table(spark, data))).collect()}
    assert set(rows) == {0, 1, 2, 9}
    assert rows[0].usable and rows[0].n_common == 1 and rows[0].prompt == "<|im_start|>user\nq<|im_end|>\n"
    assert trained(rows[0].chosen, rows[0].chosen_mask) == "a<|im_end|>" and trained(rows[0].rejected, rows[0].rejected_mask) == "b<|im_end|>"
    assert not any(rows[k].usable for k in (1, 2, 9)) and rows[1].rejected is None and rows[9].prompt == ""
    same = [(k, t, r, x) for k in (0, 1) for t, r, x in ((0, "user", "q"), (1, "assistant", "a"))]
    row = preference_examples(answer_pairs(table(spark, same))).where("pair_id = 0").first()
    assert row.n_common == 2 and row.chosen == "" and not row.usable
    assert answer_pairs(table(spark).limit(0)).count() == 0


def test_most_conversations_share_their_prompt(spark):
    rows = preference_examples(answer_pairs(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))).collect()
    assert sum(r.usable and r.n_common > 0 for r in rows) > 0.5 * len(rows)
