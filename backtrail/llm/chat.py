"""Preference pairs as one prompt and two masked completions, by column functions only.

A turn is written as `<|role|>`, a line end, its text, `<|end|>`, a line end. The turns that chosen and
rejected conversation begin with alike are written once, as the prompt. What follows in each is a
completion; its spans, in characters, are what is learnt from: text and end mark of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNT = "assistant"


def conversations(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation's turns as (role, text), by turn, role, text.

    Nulls in role and text are empty. A row of the result holds one conversation, as an example does.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(said))
    return turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def written(turn: Column) -> Column:
    return F.concat(header(turn), turn["text"], F.lit("<|end|>\n"))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, written), "")


def learnt_spans(turns: Column) -> Column:
    """start:stop of the learnt characters of a completion, end exclusive, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        stop = acc["at"] + F.length(written(turn))
        span = F.array(F.concat_ws(":", acc["at"] + F.length(header(turn)), stop))
        return F.struct(stop.alias("at"), F.when(turn["role"] == LEARNT, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per row of `pairs` (pair_id, chosen_id, rejected_id), for `turns` (conv_id, turn, role, text).

    Columns: pair_id, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans, usable. The prompt is the
    longest common prefix in whole turns. A conversation that is null or has no turns is empty. A pair
    is usable when both completions hold something to learn. Repeated pairs stay; repeated turns are turns.
    """
    told = conversations(turns)
    empty = F.array().cast("array<struct<role:string,text:string>>")
    both = (
        pairs.select("pair_id", "chosen_id", "rejected_id")
        .join(told.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("_c")), "chosen_id", "left")
        .join(told.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("_r")), "rejected_id", "left")
        .select("pair_id", F.coalesce("_c", empty).alias("_c"), F.coalesce("_r", empty).alias("_r"))
    )
    alike = F.zip_with("_c", "_r", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(alike, False)
    shared = both.withColumn("_n", F.when(first > 0, first - 1).otherwise(F.size(alike)).cast("int"))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    cut = shared.select("pair_id", "_n", F.slice("_c", 1, F.col("_n")).alias("_p"), rest("_c").alias("_c"), rest("_r").alias("_r"))
    out = cut.select(
        "pair_id", F.col("_n").alias("prompt_turns"), joined(F.col("_p")).alias("prompt"), joined(F.col("_c")).alias("chosen"),
        learnt_spans(F.col("_c")).alias("chosen_spans"), joined(F.col("_r")).alias("rejected"), learnt_spans(F.col("_r")).alias("rejected_spans"),
    )
    return out.withColumn("usable", (F.col("chosen_spans") != "") & (F.col("rejected_spans") != ""))


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, pairs): each conversation against itself with another one's last answer, as a source of pairs.

    The rejected side keeps the turns before the last assistant turn, followed by the last assistant turn of the
    conversation whose id differs in the lowest bit; without such a one nothing follows.
    Conversation ids are whole numbers; pair_id is the chosen one. Rows without an id are left out.
    """
    some = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    answers = some.filter(F.col("role") == LEARNT).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("conv_id"), F.col("last.text").alias("text"))
    ends = answers.select("conv_id", F.col("last.turn").alias("end"))
    before = some.join(ends, "conv_id", "left").filter(F.col("end").isNull() | (F.col("turn") < F.col("end")))
    answer = ends.join(other, "conv_id").select("conv_id", F.col("end").alias("turn"), F.lit(LEARNT).alias("role"), "text")
    name = lambda side: F.concat(F.lit(side), F.col("conv_id").cast("string")).alias("conv_id")
    rejected = before.select("conv_id", "turn", "role", "text").union(answer)
    both = some.select(name("c"), "turn", "role", "text").union(rejected.select(name("r"), "turn", "role", "text"))
    ids = some.select("conv_id").distinct()
    return both, ids.select(F.col("conv_id").alias("pair_id"), name("c").alias("chosen_id"), name("r").alias("rejected_id"))


_TURN = "'<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10)"


def _spans_sql(side: str) -> str:
    before = f"coalesce(list_sum(list_transform({side}[1:i-1], lambda s: length({_TURN}))), 0)::BIGINT"
    whole = f"length(list_transform({side}[i:i], lambda s: {_TURN})[1])"
    head = f"length('<|' || {side}[i].role || '|>') + 1"
    some = f"list_filter(generate_series(1, len({side})), lambda i: {side}[i].role = '{LEARNT}')"
    return f"array_to_string(list_transform({some}, lambda i: ({before} + {head}) || ':' || ({before} + {whole})), ',')"


#: DuckDB SQL for `preferences` of `swapped_answers` over `conversations`.
SQL = f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(turn) AS "end", arg_max(text, turn) AS text FROM t WHERE role = '{LEARNT}' GROUP BY conv_id),
r AS (SELECT t.* FROM t LEFT JOIN a USING (conv_id) WHERE "end" IS NULL OR turn < "end"
  UNION ALL SELECT a.conv_id, a."end", '{LEARNT}', b.text FROM a JOIN a b ON b.conv_id = xor(a.conv_id, 1)),
cs AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, role, text) AS c FROM t GROUP BY conv_id),
rs AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, role, text) AS r FROM r GROUP BY conv_id),
b AS (SELECT conv_id, c, coalesce(r, []) AS r FROM cs LEFT JOIN rs USING (conv_id)),
n AS (SELECT *, coalesce(list_min(list_filter(generate_series(1, greatest(len(c), len(r))), lambda i: c[i] IS DISTINCT FROM r[i])),
  greatest(len(c), len(r)) + 1) - 1 AS n FROM b),
p AS (SELECT conv_id, n, c[1:n] AS p, c[n+1:] AS c, r[n+1:] AS r FROM n)
SELECT conv_id AS pair_id, n::INT AS prompt_turns, array_to_string(list_transform(p, lambda s: {_TURN}), '') AS prompt,
  array_to_string(list_transform(c, lambda s: {_TURN}), '') AS chosen, {_spans_sql('c')} AS chosen_spans,
  array_to_string(list_transform(r, lambda s: {_TURN}), '') AS rejected, {_spans_sql('r')} AS rejected_spans,
  chosen_spans <> '' AND rejected_spans <> '' AS usable
FROM p"""
