"""Preference pairs against plain rendering."""

import pytest
from pyspark.sql import functions as F

from backtrail.llm import chat

KIND = "conv_id string, turn long, role string, text string"


def say(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        stop = at + len(say([(r, t)]))
        if r == "assistant":
            out.append(f"{at + len(r) + 5}:{stop}")
        at = stop
    return ",".join(out)


def plain(told, pairs):
    out = {}
    for pair, a, b in pairs:
        c, r = told.get(a, []), told.get(b, [])
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        out[pair] = (n, say(c[:n]), say(c[n:]), spans(c[n:]), say(r[n:]), spans(r[n:]), spans(c[n:]) != "" != spans(r[n:]))
    return out


def test_cases(spark):
    told = {
        "a": [("system", "be é𝄞"), ("user", "hi"), ("assistant", "yo"), ("user", "x")], "b": [("system", "be é𝄞"), ("user", "hi"), ("assistant", "no"), ("assistant", "z")],
        "c": [("user", "")], "d": [("user", ""), ("assistant", "w" * 500_000)], "e": [("assistant", "a"), ("assistant", "a")],
    }
    pairs = [(1, "a", "b"), (2, "a", "a"), (3, "c", "d"), (4, "d", "c"), (5, "a", "none"), (6, None, None), (7, "e", "c"), (8, "b", "e")]
    rows = [(k, i, r, t) for k, v in told.items() for i, (r, t) in reversed(list(enumerate(v)))]
    turns = spark.createDataFrame(rows + [("n", 0, None, None), (None, 0, "user", "lost")], KIND).withColumn("prompt", F.lit(1))
    told["n"] = [("", "")]
    pairs.append((9, "n", "c"))
    df = spark.createDataFrame(pairs, "pair_id int, chosen_id string, rejected_id string").withColumn("turns", F.lit(2))
    got = {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.chosen_spans, r.rejected, r.rejected_spans, r.usable) for r in chat.preferences(turns, df).collect()}
    assert got == plain(told, pairs)
    assert chat.preferences(turns, df.limit(0)).count() == 0
    assert chat.preferences(turns.limit(0), df).filter("prompt <> ''").count() == 0


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "r0"), (0, 2, "user", "t"), (1, 0, "assistant", "r1"), (2, 0, "assistant", "alone"), (4, 0, "user", "none"), (None, 0, "user", "x")]
    turns, pairs = chat.swapped_answers(spark.createDataFrame(rows, KIND.replace("string", "long", 1)))
    got = {r.pair_id: r for r in chat.preferences(turns, pairs).collect()}
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == (say([("user", "q")]), say([("assistant", "r0"), ("user", "t")]), say([("assistant", "r1")]))
    assert got[2].rejected == "" and not got[2].usable and got[4].chosen == "" and set(got) == {0, 1, 2, 4}


@pytest.mark.parametrize("name", ["op7_chat_preferences", "op2_secret_scans", "op1_embedding_near_duplicates"])
def test_queries_equal_their_sql(spark, name):
    from check import compare, oracle

    from backtrail.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, folder)
    cursor = oracle(folder).execute(SQL[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cursor.fetchall(), [d[0] for d in cursor.description]) is None
