"""One conversation of many messages, which may hold most of all rows."""

import random

from cadenza.llm import quotes


def test_a_conversation_of_many_messages(spark):
    rng, n = random.Random(7), 20_000
    data, reply = [], {}
    for i in range(n):
        text, reply[i] = f"message {i} says word{i * 7} and more", i - 1 if i else None
        if i > 10 and rng.random() < 0.2:
            j = rng.randrange(max(0, i - 5000), i - 1)
            text, reply[i] = f"> message {j} says word{j * 7} and more\n{text}", j
        data.append((1, i, "user", text))
    data += [(c, 0, "user", "alone") for c in range(2, 40)]
    m = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.turn: r for r in quotes.threads(quotes.conversations(m)).where("conv_id = 1").collect()}
    assert len(got) == n and {i: r.reply_to for i, r in got.items()} == reply
    depth = {}
    for i in range(n):
        depth[i] = 0 if reply[i] is None else depth[reply[i]] + 1
    assert {i: r.depth for i, r in got.items()} == depth and {r.thread for r in got.values()} == {0}
