"""Quality rules against a plain count over all documents."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from backtrail.llm import rules
from backtrail.llm.common import read

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, least_words=50, most_documents=20, most_share=0.01, left_over=0.3):
    hosts, holders = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    for doc, text, host in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                hosts[host].add(doc)
                holders[host, norm(line)].add(doc)
    often = {k for k, v in holders.items() if len(v) > most_documents and len(v) > most_share * len(hosts[k[0]])}
    out = []
    for doc, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        gone = [x for x in lines if (host, norm(x)) in often]
        removed = sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < least_words or 100 * len(covered) > 50 * len(words)
        kept = not failed and len(words) - removed >= left_over * len(words)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len({norm(x) for x in gone}), removed, failed, kept))
    return sorted(out, key=str)


def got(docs, **limits):
    names = ["doc_id", *rules.COUNTS, "removed_lines", "removed_words", "base_failed", "kept"]
    return sorted([tuple(r) for r in rules.rules(docs, **limits).select(*names).collect()], key=str)


def test_equals_plain_count(spark):
    docs = read(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert got(docs) == plain(rows)
    limits = {"most_documents": 2, "most_share": 0.02, "left_over": 0.9}
    assert got(docs, **limits) == plain(rows, **limits)


def test_a_large_host_loses_the_same_lines_as_a_small_one(spark):
    shared = "This line is in twenty-one documents of its host"
    rows = [(1000 * h + i, f"{shared}\nown words {h} {i}" if i < 21 else f"own words {h} {i}", f"host{h}") for h, size in enumerate((100, 4000)) for i in range(size)]
    rows += [(9000 + i, f"Only twenty documents have it\nown {i}" if i < 20 else f"own {i}", "host2") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = rules.rules(docs).filter("removed_lines > 0").groupBy("host").count().collect()
    assert {r.host: r["count"] for r in found} == {"host0": 21, "host1": 21}


def test_corner_rows(spark):
    common = "This line   is Shared\n"
    rows = [(i, common * 2 + f"own words {i} é 𝄞 # <b>", "a" if i % 2 else None) for i in range(12)]
    rows += [(20, None, "a"), (21, "", None), (22, "a b a b a b a b", "a"), (23, "x y " * 100_000, "a"), (None, common, "a"), (3, rows[3][1], "a"), (24, "   \n\x1c", "a"), (25, "w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit(1)).withColumn("n_words", F.lit("z"))
    limits = {"least_words": 4, "most_documents": 3, "most_share": 0.1, "left_over": 0.5}
    assert got(docs, **limits) == plain(rows, **limits)
    assert got(docs.limit(0)) == []
