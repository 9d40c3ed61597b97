"""Secret scans against plain regular expressions, and masking."""

import re

from pyspark.sql import functions as F

from backtrail.llm import secret_scan
from backtrail.llm.common import read

FOLDER = "/root/testdata/sf0.01"
A = re.compile(r"(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def plain_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def base(df):
    return [(r[0], [(s.start, s.rank, s.stop) for s in r.base]) for r in df.collect()]


def test_spans_equal_plain_expressions(spark):
    docs = read(spark, FOLDER, "documents")
    got = dict(base(secret_scan.scan(docs)))
    want = {r.doc_id: plain_base(r.text) for r in docs.collect()}
    assert got == want and any(want.values())


HEXES = "0123456789abcdef01234567"
CASES = [
    (1, None), (2, ""), (3, f"é𝄞 Token='abc.def-1' AKIA{'A1' * 9} {HEXES}{HEXES}"), (4, "token:token:abcdef api_key==abcdef APIKEY : zzz"),
    (5, f"x{'AKIA' * 6} {HEXES[:23]} {HEXES[:23]}g"), (6, f"token={HEXES} " * 50), (6, f"token={HEXES} " * 50), (None, f"secret: {HEXES}"),
    (7, "abc " * 200_000 + "password = hunter22"), (8, "tokens token\n=abcdef toKen=abcdef"),
]


def test_corner_rows(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).withColumn("base", F.lit(1))
    got = sorted(base(secret_scan.scan(docs)), key=str)
    assert got == sorted([(i, plain_base(t)) for i, t in CASES], key=str)
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_ownership_parts_copies_from_live_values(spark):
    generic = "QUJDREVGR0hJSktMTU5PUFFSUw1"
    rows = [(i, f"see {generic} and token=copied{i % 2}value", f"s{i}") for i in range(10)] + [(50, "one QWJDREVGR0hJSktMTU5PUFFSUw9", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in secret_scan.scan(docs, most_owners=5).collect()}
    assert [(s.rank, s.live, s.owners) for s in found[0].spans] == [(0, True, 5)]
    assert [s.rank for s in found[50].spans] == [3]
    assert [s.rank for s in {r.doc_id: r for r in secret_scan.scan(docs, most_owners=10).collect()}[0].spans] == [3, 0]
    assert [s.live for s in {r.doc_id: r for r in secret_scan.scan(docs, most_owners=4).collect()}[0].spans] == [False]


def test_masked(spark):
    rows = [(1, f"é token={HEXES} end", "a", 0), (2, "clean text", "a", 10), (3, None, "b", None), (None, f"{HEXES} {HEXES}x", "b", 1), (1, f"é token={HEXES} end", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = sorted([tuple(r) for r in secret_scan.masked(docs).collect()], key=str)
    want = [(1, "é [secret] end", "a", 14), (1, "é [secret] end", "a", 14), (2, "clean text", "a", 10), (3, None, "b", None), (None, "[secret] [secret]x", "b", 18)]
    assert got == sorted(want, key=str)
    assert secret_scan.masked(docs).schema == docs.schema
    assert secret_scan.masked(docs.limit(0)).count() == 0


def test_owners_are_judged_first(spark):
    """21 copies in one source are the owner's own; in two sources they are an example, and so are five owners."""
    rows = [(i, f"token=only{0}owner", "a", 0) for i in range(21)] + [(100 + i, "token=shared1two", f"s{i % 2}", 0) for i in range(21)]
    rows += [(200 + i, "token=shared2two", f"s{i % 2}", 0) for i in range(20)] + [(300 + i, "token=five1owners", f"s{i}", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    live = {r.doc_id: r.spans[0].live for r in secret_scan.scan(docs).collect()}
    assert live == {i: i < 100 or 200 <= i < 300 for i, *_ in rows}
    assert {r.doc_id for r in secret_scan.masked(docs).collect() if "[secret]" in r.text} == {i for i, keep in live.items() if keep}


def test_many_spans_in_one_text(spark):
    """60,000 tokens of three kinds in one text, in seconds."""
    import time

    text = " ".join(f"token=abc{i}def {HEXES}{i % 10} Zm9vYmFyQmF6UXV4{i:08d}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("source", F.lit("s"))
    began = time.time()
    (row,) = secret_scan.candidates(docs).select("base", F.size("generic").alias("n")).collect()
    took = time.time() - began
    assert [(s.start, s.rank, s.stop) for s in row.base] == plain_base(text) and row.n == 20_000
    assert took < 60, took
