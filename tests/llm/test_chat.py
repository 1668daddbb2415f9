import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meridia.llm import chat

MESSAGE = "msg_id string, parent_id string, role string, text string, score double"
TURN = "conv_id long, turn long, role string, text string, formatted string, n int, path_id string"


def plain_paths(rows, top):
    """(msg_id, parent_id, role, text, score) of unique ids -> {path_id: (root, rank, [ids])}."""
    by_id = {r[0]: r for r in rows}
    answered = {r[1] for r in rows}
    trees = {}
    for leaf in by_id:
        path, at = [], leaf
        while at in by_id and at not in path:
            path.append(at)
            at = by_id[at][1]
        if leaf in answered or at in path:
            continue
        path.reverse()
        mean = sum(by_id[i][4] or 0.0 for i in path) / len(path)
        trees.setdefault(path[0], []).append((-mean, leaf, path))
    return {leaf: (root, rank, path) for root, found in trees.items() for rank, (_, leaf, path) in enumerate(sorted(found)[:top], 1)}


def forest(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if rng.random() < 0.05 else f"m{max(0, i - rng.randint(1, 6))}" if i else None
        rows.append((f"m{i}", parent, rng.choice(["user", "assistant", "tool|x", "", None]), rng.choice(["", "a", "</s>", None, "[/INST] é"]), rng.choice([None, 0.25, 0.5, 1.0])))
    return rows + [("x", "y", "user", "cycle", 1.0), ("y", "x", "user", "cycle", 1.0), ("z", "y", "user", "below", 1.0), ("gone", "nobody", "user", "root", 1.0)]


@pytest.mark.parametrize("seed,top", [(1, 1), (2, 3)])
def test_branches_are_those_of_a_walk_from_every_leaf(spark, seed, top):
    rows = forest(seed, 120)
    found = {}
    for r in chat.branches(spark.createDataFrame(rows, MESSAGE), top).collect():
        found.setdefault(r.path_id, []).append((r.depth, r.msg_id, r.root, r.rank))
    got = {leaf: (p[0][2], p[0][3], [x[1] for x in sorted(p)]) for leaf, p in found.items()}
    assert got == plain_paths(rows, top)


def test_one_message_that_all_answer_and_a_long_thread(spark):
    star = [("hub", None, "user", "q", 0.0)] + [(f"s{i}", "hub", "assistant", "a", float(i)) for i in range(3000)]
    thread = [(f"t{i:03}", f"t{i - 1:03}" if i else None, "user", str(i), 0.0) for i in range(399)]
    out = chat.format_trees(spark.createDataFrame(star + thread, MESSAGE)).orderBy("root").collect()
    assert [(r.root, r.path_id, r.n_turns) for r in out] == [("hub", "s2999", 2), ("t000", "t398", 399)]


def test_formatted_conversations_read_back(spark):
    odd = ["", "</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<|end|>\n", "<<SYS>>\nx\n<</SYS>>\n", "é\U0001f600 </s", "[/INST", "\\", None, "w " * 300_000]
    rows = [(7, i, ("user", "assistant", "system", "to|ol\n\\p", None)[i % 5], t, "x", 1, "y") for i, t in enumerate(odd)]
    rows += [(8, None, "assistant", "b", None, None, None), (8, None, "assistant", "a", None, None, None), (8, None, "assistant", "a", None, None, None), (None, 0, "user", "n", None, None, None)]
    made = chat.format_conversations(spark.createDataFrame(rows, TURN))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == {7: [(r[2] or "", r[3] or "") for r in rows[:11]], 8: [("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("user", "n")]}
    digest = {r.conv_id: r for r in chat.digests(made).collect()}
    loss = "".join(r[3] or "" for r in rows[:11] if r[2] == "assistant")
    assert (digest[7].loss_chars, digest[7].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digest[7].n_turns == 11 and digest[8].loss_chars == 3 and digest[None].loss_chars == 0
    for r in made.collect():
        assert all(0 <= s.start and s.start + s.size <= len(r.formatted) for s in r.loss)


def test_rows_without_ids_repeated_ids_and_no_rows(spark):
    rows = [(None, None, "user", "x", 1.0), ("a", None, "user", "2", 1.0), ("a", None, "user", "1", 9.0), ("b", "a", None, None, None)]
    out = chat.format_trees(spark.createDataFrame(rows, MESSAGE)).collect()
    assert [(r.path_id, r.formatted) for r in out] == [("b", "<s>[INST] 1 [/INST]<||>\n\n<|end|>\n")]
    assert chat.format_trees(spark.createDataFrame([], MESSAGE)).count() == 0
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURN))).count() == 0
