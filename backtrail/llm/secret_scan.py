"""Secrets in texts, told apart by how many repositories and owners hold the same value.

Built-in column functions only. `candidates` finds spans in every text; their values are hashed, and
`ownership` counts, over the whole corpus, the distinct repositories and owners of each hash. A
value that many owners hold is an example that was copied about; one that few hold looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut, row_key

# The kinds in their order, their patterns, and the least length of a value.
KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
GENERIC = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "generic")
LEAST_ASSIGN = 6
BLOCK = 256  # spans of one text that are gone through at once

SPAN = "struct<start:bigint,rank:int,stop:bigint,value:string>"


def _bound(value: Column, use) -> Column:
    """`use` of a value that is made once, however often and in whatever lambda it is needed."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, rank: int, value) -> Column:
    """Leftmost matches that do not overlap, as (start, rank, stop, value) in code points.

    The text is cut at the matches only where there is one; a start is the length of what lies
    before it. Lengths are summed in blocks of `BLOCK` matches first, so that a start adds up one block and the sums before it.
    """
    match, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    none, add = F.lit(0).cast("bigint"), lambda a, n: a + n

    def located(m: Column, r: Column) -> Column:
        return _bound(F.struct(m.alias("m"), r.alias("r")), lambda a: _bound(
            F.transform(a["m"], lambda x, i: F.length(x) + F.length(F.get(a["r"], i))), lambda lengths: blocked(a, lengths)
        ))

    def blocked(a: Column, lengths: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), none, add))
        part = lambda c, b: F.slice(c, b * BLOCK + 1, BLOCK)
        return _bound(sums, lambda before: F.flatten(F.transform(blocks, lambda b: _bound(
            F.struct(part(a["m"], b).alias("m"), part(a["r"], b).alias("r"), part(lengths, b).alias("lengths"), F.aggregate(F.slice(before, F.lit(1), b), none, add).alias("at")),
            lambda z: F.transform(z["m"], lambda x, i: span(z, x, i)),
        ))))

    def span(z: Column, x: Column, i: Column) -> Column:
        start = z["at"] + F.aggregate(F.slice(z["lengths"], F.lit(1), i), F.length(F.get(z["r"], i)).cast("bigint"), add)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("stop"), value(x).alias("value"))

    return F.when(F.regexp_count(text, F.lit(pattern)) > 0, located(match, rest)).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base` and `generic`: arrays of (start, rank, stop, value), by start, then rank.

    base: assigned, access-key and long hexadecimal values. generic: runs of 20 and more characters
    of base64 with a letter and a digit that no base span touches. A null text has none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(
        _spans(body, ASSIGN, 0, lambda x: F.regexp_extract(x, ASSIGN, 2)), lambda s: F.length(s["value"]) >= LEAST_ASSIGN
    )
    base = F.array_sort(F.concat(assign, _spans(body, ACCESS, 1, lambda x: x), _spans(body, HEX, 2, lambda x: x)))
    mixed = F.filter(_spans(body, GENERIC, 3, lambda x: x), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    some = docs.withColumn("base", base).withColumn("generic", mixed)
    return some.withColumn("generic", F.when((F.size("base") > 0) & (F.size("generic") > 0), _apart(F.col("generic"), F.col("base"))).otherwise(F.col("generic")))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that no base span touches. Base spans are taken in blocks with their reach, so that a span looks into few of them."""
    meets = lambda s: lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])

    def blocks(all_base: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_base) - 1) / BLOCK).cast("int"))
        cut_up = F.transform(numbers, lambda b: F.slice(all_base, b * BLOCK + 1, BLOCK))
        return F.transform(cut_up, lambda s: F.struct(F.get(s, F.lit(0))["start"].alias("start"), F.array_max(F.transform(s, lambda x: x["stop"])).alias("stop"), s.alias("spans")))

    return _bound(F.struct(spans.alias("spans"), _bound(base, blocks).alias("blocks")), lambda a: F.filter(
        a["spans"], lambda s: ~F.exists(a["blocks"], lambda b: meets(s)(b) & F.exists(b["spans"], meets(s)))
    ))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners): in how many distinct ones each value occurs. found: (hash, repo, owner).

    A null repository or owner counts as one of its own. Counts fold before each shuffle.
    """
    some = found.select("hash", F.struct("repo").alias("repo"), F.struct("owner").alias("owner"))
    return some.groupBy("hash").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"))


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source",
    most_repositories: int = 20, most_owners: int = 4,
) -> DataFrame:
    """One row per row of `docs`: doc_id, base (array of spans) and spans (base and live generic ones).

    A span is (start, rank, stop, live, repositories, owners); rank is the place in `KINDS`. A value of
    one owner is live in however many repositories it lies; one of several owners is a copied example if more than `most_owners`
    of them, or more than `most_repositories` repositories, hold it. Base spans are always in `spans`, generic ones only where live.
    Repeated rows come back as often as they are given; a null id is kept, a null text has no
    spans. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    named = docs.select(
        F.col(doc_id).alias("_doc"), F.col(text).alias("_body"), F.col(repo).alias("repo"), F.col(owner).alias("owner")
    )
    rows = candidates(named, "_body").select(
        "_doc", *row_key("_doc", "_body"), "repo", "owner",
        F.transform(F.concat("base", "generic"), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), F.sha2(s["value"], 256).alias("hash"))).alias("found"),
    )
    rows = cut(rows, "candidates")
    held = rows.filter(F.size("found") > 0)
    each = held.select("_id", "_text", "repo", "owner", F.explode("found").alias("s")).select("_id", "_text", "repo", "owner", "s.*")
    counted = cut(ownership(each), "ownership")
    live = (F.col("owners") <= 1) | (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = each.drop("repo", "owner").join(counted, "hash").withColumn("live", live)
    span = F.struct("start", "rank", "stop", "live", "repositories", "owners")
    per_row = judged.groupBy("_id", "_text").agg(F.array_sort(F.collect_set(span)).alias("judged"))
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,live:boolean,repositories:bigint,owners:bigint>>")
    joined = rows.join(per_row, ["_id", "_text"], "left").withColumn("judged", F.coalesce("judged", none))
    return joined.select(
        F.col("_doc").alias(doc_id), "_id", "_text",
        F.filter("judged", lambda s: s["rank"] < 3).alias("base"),
        F.filter("judged", lambda s: (s["rank"] < 3) | s["live"]).alias("spans"),
    )


def written(spans: str) -> Column:
    """kind:start:stop of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[secret]", **limits) -> DataFrame:
    """`docs` with every live span of `text` replaced by `mask`, and n_chars, where present, counted anew.

    Only texts with a span move: the others keep their place. Columns are those of `docs`. Null texts stay null, rows with a
    null id are masked as others, repeated rows come back as often as given, a null n_chars of a text with a span
    becomes its length. Empty in, empty out.
    """
    found = scan(docs, doc_id, text, **limits)
    live = F.filter("spans", lambda s: s["live"])
    hit = cut(found.select("_id", "_text", live.alias("_live")).filter(F.size("_live") > 0).dropDuplicates(["_id", "_text"]), "live")
    keyed = docs.select("*", *row_key(doc_id, text)).join(hit, ["_id", "_text"], "left")
    # overlapping spans make one gap: each piece runs from the furthest stop so far to the next start
    walk = F.aggregate(
        "_live",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.col(text).substr(acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
    )
    tail = F.concat(walk["out"], F.col(text).substr(walk["at"].cast("int") + 1, F.length(text)))
    clean = F.when(F.col("_live").isNull(), F.col(text)).otherwise(tail)
    out = keyed.withColumn(text, clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_live").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _sql_spans(name: str, pattern: str, rank: int, value: str, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT rid, {rank} AS rank, st AS start, st + length(m) AS stop, {value} AS value FROM (
    SELECT rid, i, ms[i] AS m, (list_sum(list_transform(rs[1:i], lambda x: length(x)))
      + CASE WHEN i = 1 THEN 0 ELSE list_sum(list_transform(ms[1:i-1], lambda x: length(x))) END)::BIGINT AS st
    FROM (SELECT rid, ms, rs, unnest(generate_series(1, len(ms))) AS i FROM (
      SELECT rid, regexp_extract_all(body, '{quoted}') AS ms, string_split_regex(body, '{quoted}') AS rs FROM d) WHERE len(ms) > 0))
  WHERE {keep})"""


def sql(most_repositories: int = 20, most_owners: int = 4) -> str:
    """DuckDB SQL for the digest of `scan` over `documents`."""
    assign = ASSIGN.replace("'", "''")
    value = f"regexp_extract(m, '{assign}', 2)"
    parts = ", ".join([
        _sql_spans("a", ASSIGN, 0, value, f"length({value}) >= {LEAST_ASSIGN}"), _sql_spans("k", ACCESS, 1, "m", "true"),
        _sql_spans("h", HEX, 2, "m", "true"), _sql_spans("g", GENERIC, 3, "m", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
    ])
    kinds = "['assign', 'access', 'hex', 'generic'][rank + 1]"
    line = f"{kinds} || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents), {parts},
base AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM g WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.rid = g.rid AND b.start < g.stop AND g.start < b.stop)),
held AS (SELECT value, count(DISTINCT coalesce(doc_id, -1)) AS repos, count(DISTINCT coalesce(source, '')) AS owners
  FROM cand JOIN d USING (rid) GROUP BY value),
judged AS (SELECT cand.*, owners <= 1 OR (owners <= {most_owners} AND repos <= {most_repositories}) AS live FROM cand JOIN held USING (value)),
per AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg({line}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base_spans,
  string_agg({line}, ',' ORDER BY start, rank) FILTER (rank < 3 OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (rid)"""
