import random

from pyspark.sql import functions as F

from alertmill.llm import chat


def turns_of(rows):
    return {(r.tree, r.leaf): [(t.role, t.text) for t in r.turns] for r in rows.select("tree", "leaf", chat.read_turns(F.col("formatted")).alias("turns")).collect()}


def test_branches_are_enumerated_and_ranked(spark):
    rnd, nodes = random.Random(5), []
    for tree in range(6):
        for node in range(1, 40):
            parent = rnd.randrange(1, node) if node > 1 and rnd.random() < 0.95 else None
            nodes.append((tree, node, parent, rnd.choice([None, 0.0, 0.5, 1.0]), rnd.choice(["user", "assistant"]), f"{tree} {node}"))
    rows = spark.createDataFrame(nodes, "tree long, node long, parent long, score double, role string, text string").withColumn("leaf", F.lit(1))
    paths = {}
    for tree in range(6):
        own = {n[1]: n for n in nodes if n[0] == tree}
        for leaf in set(own) - {n[2] for n in own.values()}:
            path = [leaf]
            while own[path[-1]][2]:
                path.append(own[path[-1]][2])
            paths[tree, leaf] = path[::-1]
    said = {(n[0], n[1]): n for n in nodes}
    score = {k: sum(said[k[0], n][3] or 0.0 for n in p) / len(p) for k, p in paths.items()}
    for per_tree in (1, 3, 100):
        want = {}
        for tree in range(6):
            best = sorted((k for k in paths if k[0] == tree), key=lambda k: (-score[k], -len(paths[k]), k[1]))[:per_tree]
            want |= {k: [said[tree, n][4:] for n in paths[k]] for k in best}
        assert turns_of(chat.format_reply_trees(rows, per_tree)) == want


def test_control_strings_come_back(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>\n<turn>x", "\\l\\b\\n\n", "", None, "é🙂\\", "<"]
    rows = [(1, k, ["user", "assistant", "a\nb</turn>", None][k % 4], t) for k, t in enumerate(odd * 2)] + [(None, 0, "assistant", "n"), (2, None, "user", "t"), (2, None, "user", "t")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_reply_trees(chat.linear_replies(messages))
    got = {k[0]: v for k, v in turns_of(done).items()}
    assert got[1] == [(r or "", t or "") for _, _, r, t in rows[:14]] and got[None] == [("assistant", "n")] and got[2] == [("user", "t")] * 2
    loss = {r.tree: r.t for r in done.select("tree", chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("t")).collect()}
    assert loss[1] == "".join(t or "" for _, _, r, t in rows[:14] if r == "assistant") and loss[2] == ""


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_reply_trees(chat.linear_replies(empty)).collect() == []
