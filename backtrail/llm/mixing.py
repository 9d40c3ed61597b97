"""Rates of documents such that the expected tokens of each domain meet target weights.

Built-in column functions only. A classifier learnt from a labelled table gives each document a
posterior over the domains (multinomial naive Bayes over hashed words, tempered by length). The rates
r >= 0 minimise || W (sum of r t p - target) || over all documents, t being a document's tokens and p its
posterior, by projected gradient steps from r = 1. A step needs the sums of one number per domain, and moves the rate
of a document by its own posterior and those few numbers, so nothing but the sums leaves the tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut, hash_share, release, row_key

PLACES = 1 << 16  # hashed words; also the bound of the model's rows
NAMES = 64  # bound of the domains
WRITTEN = 6  # steps after which the rates are written
LONG = 60  # steps after which gains are held against the first residual
PATIENCE = 10  # steps that must have lowered the residual


def words(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Each word of each row, as its place; a text without any gives one row with a null place.

    `first` is 1 on one row per row of `docs`, so that its sum counts rows. Words are split at spaces and line ends.
    """
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    each = docs.select(*keep, F.posexplode(F.split(F.translate(body, "\n\t\r", "   "), " ", -1)).alias("pos", "word"))
    place = F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(PLACES)))
    return each.select(*keep, place.alias("place"), (F.col("pos") == 0).cast("int").alias("first"))


def learn(docs: DataFrame, labelled: DataFrame, doc_id: str, text: str, domain: str, sample: int, smooth: float = 0.5) -> tuple[list[str], list[float], DataFrame]:
    """(domains, their priors, (place, p0, p1, ...) of log chances) from a sample of at most about `sample` labelled rows.

    The sample is chosen by a hash of the id; the chosen labels are broadcast under that bound. A
    document with several domains has the smallest.
    """
    known = labelled.filter(F.col(doc_id).isNotNull() & F.col(domain).isNotNull())
    known = cut(known.groupBy(F.col(doc_id).alias("_doc")).agg(F.min(F.col(domain).cast("string")).alias("domain")), "labels")
    size = known.count()
    chosen = known if size <= sample else known.filter(hash_share([F.col("_doc"), F.lit("mixing")]) < sample / size)
    each = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_body")).join(F.broadcast(chosen), "_doc")
    counts = cut(words(each, ["domain"], "_body").groupBy("domain", "place").agg(F.count("*").alias("n"), F.sum("first").alias("rows")), "counts")
    rows = {r.domain: r for r in counts.groupBy("domain").agg(F.sum("rows").alias("rows"), F.count_if(F.col("place").isNotNull()), F.sum(F.when(F.col("place").isNotNull(), F.col("n"))).alias("n")).orderBy("domain").limit(NAMES + 1).collect()}
    if len(rows) > NAMES:
        raise ValueError(f"more than {NAMES} domains")
    names = list(rows)
    total = sum(r.rows for r in rows.values())
    logs = [
        F.log((F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) + smooth) / ((rows[d].n or 0) + smooth * PLACES)).alias(f"p{i}")
        for i, d in enumerate(names)
    ]
    table = counts.filter(F.col("place").isNotNull()).groupBy("place").agg(*logs) if names else counts
    return names, [rows[d].rows / total for d in names], cut(table, "chances")


def posteriors(docs: DataFrame, names: list[str], priors: list[float], chances: DataFrame, missing: list[float], doc_id: str, text: str) -> DataFrame:
    """One row per distinct row of `docs` (id and text): doc_id, key, n_rows, tokens, p0, p1, ...

    The words meet the chances by a broadcast of at most `PLACES` rows and fold to a row per document
    in the task that reads it. Log likelihoods are divided by the root of the words, so that long
    texts stay soft. A text without words has the priors.
    """
    each = words(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_text"), F.col(text).alias("_body")), ["doc_id", "_text"], "_body")
    met = each.join(F.broadcast(chances), "place", "left")
    value = lambda i: F.sum(F.when(F.col("place").isNotNull(), F.coalesce(f"p{i}", F.lit(missing[i])))).alias(f"s{i}")
    summed = met.groupBy("doc_id", "_text").agg(F.sum("first").alias("n_rows"), F.count("place").alias("n"), *[value(i) for i in range(len(names))])
    root = F.sqrt(F.greatest(F.col("n"), F.lit(1)) * F.col("n_rows"))
    raw = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) / root + float(np.log(p)) for i, p in enumerate(priors)]
    logged = summed.select("doc_id", row_key("doc_id", "doc_id")[0], "_text", "n_rows", (F.col("n") / F.col("n_rows")).alias("tokens"), *[c.alias(f"s{i}") for i, c in enumerate(raw)])
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(names))]) if len(names) > 1 else F.col("s0")
    shares = logged.select("*", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(len(names))])
    whole = sum((F.col(f"e{i}") for i in range(1, len(names))), F.col("e0"))
    return shares.select("doc_id", "_id", "_text", "n_rows", "tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(len(names))])


def with_rates(table: DataFrame, target: np.ndarray, least: float = 0.0, close: float = 1e-6, most_steps: int = 2000) -> DataFrame:
    """`table` (n_rows, tokens, p0, p1, ...) with the rates that bring the sums of rate x tokens x posterior nearest to `target`.

    Projected gradient from rate 1 with momentum, which starts anew whenever the residual grew; rates stay at least `least`. Rates are
    measured in units that weigh a document by its tokens, residuals by the inverse of the posteriors' second moments: then the
    largest curvature is 1, a full step is safe, and with no rate at its bound one is enough. It ends when targets are met
    within `close` of all tokens, or when `PATIENCE` steps have lowered the squared residual by less than a thousandth, after `LONG`
    steps by less than a ten-thousandth of what it was at first: then rates hardly come nearer. The rates of every few steps are written. Beyond `most_steps` a RuntimeError is raised.
    """
    size = len(target)
    weight = F.col("n_rows") * F.col("tokens")
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    moments = table.agg(*[F.sum(weight * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]).first()
    second = np.zeros((size, size))
    for (i, j), v in zip(pairs, moments):
        second[i, j] = second[j, i] = v or 0.0
    inverse = np.linalg.pinv(second, rcond=1e-10, hermitian=True)
    small = close * max(target.sum(), 1.0)
    current, written = table.withColumn("rate", F.lit(1.0)).withColumn("_ahead", F.lit(1.0)), None
    momentum, costs = 1.0, []
    for step in range(most_steps + 1):
        sums = [F.sum(weight * F.col(c) * F.col(f"p{i}")) for c in ("rate", "_ahead") for i in range(size)]
        found = np.array([v or 0.0 for v in current.agg(*sums).first()])
        gap, ahead = found[:size] - target, found[size:] - target
        costs.append(float(gap @ inverse @ gap))
        gain = min(costs[:-PATIENCE], default=float("inf")) - min(costs)
        stuck = gain <= 1e-3 * min(costs) or step >= LONG and gain <= 1e-4 * costs[0]
        if np.abs(gap).max() <= small or stuck:
            return current.drop("_ahead")
        start = "_ahead"
        if step and costs[-1] > costs[-2]:
            momentum, start, ahead = 1.0, "rate", gap
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        move = sum((F.col(f"p{i}") * float(u) for i, u in enumerate(inverse @ ahead)), F.lit(0.0))
        stepped = current.withColumn("_next", F.greatest(F.lit(float(least)), F.col(start) - move))
        stepped = stepped.withColumn("_ahead", F.col("_next") + float((momentum - 1) / after) * (F.col("_next") - F.col("rate")))
        current, momentum = stepped.withColumn("rate", F.col("_next")).drop("_next"), after
        if step % WRITTEN == WRITTEN - 1:
            before, written = written, cut(current, "rates")
            current = written
            if before is not None:
                release(before)
    raise RuntimeError(f"rates did not settle in {most_steps} steps")


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text", domain: str = "domain",
    sample: int = 20_000, tokens: float | None = None,
) -> tuple[DataFrame, list[str]]:
    """((doc_id, key, n_rows, tokens, posterior, rate), domains): one row per distinct (id, text) of `docs`.

    labelled: (doc_id, domain). weights: share of the tokens that each domain shall have; domains that
    no labelled row has are left out, domains without a weight get 0. tokens: how many there shall be,
    by default as many as there are. A null or empty text has no tokens and rate 1 less the steps of its priors.
    Repeated rows are one row with n_rows; a null id is kept. Without labels every rate is 1.
    """
    table, names = _posterior_table(docs, labelled, doc_id, text, domain, sample)
    now = _tokens(table, len(names))
    share = np.array([weights.get(n, 0.0) for n in names]) if names != ["all"] else np.ones(1)
    if share.sum() <= 0:
        raise ValueError(f"no weight for any of the domains {names}")
    target = share / share.sum() * (now.sum() if tokens is None else tokens)
    return _named(with_rates(table, target), names), names


def lifted(
    docs: DataFrame, labelled: DataFrame, floors: dict[str, float], doc_id: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = 20_000,
) -> DataFrame:
    """Like `mix`, but each domain's target is what it has, or its floor as a share of all if that is more; rates are at least 1.

    Nulls, repeated rows and empty tables as in `mix`.
    """
    table, names = _posterior_table(docs, labelled, doc_id, text, domain, sample)
    now = _tokens(table, len(names))
    target = np.maximum(now, now.sum() * np.array([floors.get(n, 0.0) for n in names]))
    return _named(with_rates(table, target, least=1.0), names)


def raised(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = 20_000,
    most_growth: float = 20.0,
) -> tuple[DataFrame, list[str]]:
    """Like `mix`, but no document goes: rates are at least 1, and the total grows until no domain has more than its share.

    The total is the least at which each domain with a weight has a target of at least what it has, and no more than `most_growth`
    times the tokens of these domains: beyond, the largest domains keep more than their share. Tokens of domains
    without a weight stay as they are; with no domain of a weight every rate is 1. Null and empty texts have no tokens, repeated
    rows are one row with n_rows, a null id is kept, an empty table gives an empty one. `totals` tells what is met.
    """
    table, names = _posterior_table(docs, labelled, doc_id, text, domain, sample)
    now = _tokens(table, len(names))
    share = np.array([weights.get(n, 0.0) for n in names])
    some = share > 0
    target = now.copy()
    if some.any():
        total = min((now[some] / share[some]).max(), most_growth * now[some].sum() / share[some].sum())
        target[some] = np.maximum(now[some], share[some] * total)
    return _named(with_rates(table, target, least=1.0), names), names


def _posterior_table(docs, labelled, doc_id, text, domain, sample) -> tuple[DataFrame, list[str]]:
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labelled.select(F.col(doc_id).alias("doc_id"), F.col(domain).alias("domain"))
    names, priors, chances = learn(base, known, "doc_id", "text", "domain", sample)
    if not names:  # nothing is known: one domain that all texts are in
        names, priors = ["all"], [1.0]
        chances = base.select(F.lit(0).cast("bigint").alias("place"), F.lit(0.0).alias("p0")).limit(0)
    # a word that no labelled text has says nothing about the domain
    return cut(posteriors(base, names, priors, chances, [0.0] * len(names), "doc_id", "text"), "posteriors"), names


def _tokens(table: DataFrame, size: int) -> np.ndarray:
    """Expected tokens of each domain as the documents are."""
    weight = F.col("n_rows") * F.col("tokens")
    return np.array([v or 0.0 for v in table.agg(*[F.sum(weight * F.col(f"p{i}")) for i in range(size)]).first()])


def _named(rated: DataFrame, names: list[str]) -> DataFrame:
    posterior = F.array(*[F.col(f"p{i}") for i in range(len(names))]).alias("posterior")
    return rated.select("doc_id", "_id", "_text", "n_rows", "tokens", posterior, "rate")


def totals(mixed: DataFrame, names: list[str]) -> DataFrame:
    """(domain, tokens, expected): tokens of each domain before and after the rates."""
    each = mixed.select("n_rows", "tokens", "rate", F.posexplode("posterior").alias("i", "p"))
    weight = F.col("n_rows") * F.col("tokens") * F.col("p")
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("i"))
    return each.groupBy(named.alias("domain")).agg(F.sum(weight).alias("tokens"), F.sum(weight * F.col("rate")).alias("expected"))


def sampled_copies(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> DataFrame:
    """`docs` with each row as often as its rate says: the whole part, and once more by a hash with the chance of the rest.

    Equal rows share a rate and a chance, so they are copied alike; rows with null ids or texts are rows as others. Empty in, empty out.
    """
    chance = hash_share([F.col("_id"), F.col("_text"), F.lit(seed)])
    whole = F.floor("rate")
    copies = (whole + (chance < F.col("rate") - whole).cast("int")).cast("int")
    wanted = mixed.select("_id", "_text", copies.alias("_copies"))
    keyed = docs.select("*", *row_key(doc_id, text)).join(wanted, ["_id", "_text"]).filter("_copies > 0")
    return keyed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
