"""Mixing documents to target domain weights with soft membership, in DataFrame operations only.

1. A naive Bayes classifier is counted from at most ``per_domain`` labelled documents of each
   domain (the first by a hash of the id): all words of their whole texts; the most telling :data:`VOCABULARY` words (by how far their domain shares are apart) form
   the model, a table of proven size that is broadcast.
2. Every document gets its posterior over the domains from all words of its whole text. The
   log likelihood is taken per word and scaled to ``evidence`` words, so that a long mixed document
   keeps a soft membership.
3. Nonnegative document rates r are fitted by accelerated projected-gradient least squares so
   that the expected domain shares ``s_d = sum_i r_i n_i p_id / N`` match the targets, with a small
   pull ``ridge`` towards r = 1 (which decides among the many solutions and spreads the change
   over documents). In the token-weighted metric a step is
   ``r_i <- max(0, y_i - eta * (p_i . (s(y) - t) + ridge * (y_i - 1)))``: each document needs only
   its own posterior and the D shares, so a round is one aggregate with D partial sums. Rates
   are kept in stored tables every few rounds; D numbers a round reach the driver.

Defined results: null text reads as empty; a document without words has the prior as posterior, no
tokens, and gets the rate of its posterior; repeated rows get equal rates; domains without a
labelled word get no mass; null domains are not learned from. An empty corpus, or no labelled
document, gives rate 1.0 everywhere. Targets are normalised to sum 1; labelled domains that are
not among the targets count as one domain ``other`` with target 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import drop_stored, store, text_of

VOCABULARY = 4000
ROUNDS_PER_TABLE = 6


def _words(text: Column) -> Column:
    """Words of a text: lower-cased runs without ASCII white space."""
    return F.split(F.trim(F.translate(F.lower(text), "\t\n\x0b\f\r", "     ")), " +")


def vocabulary(docs: DataFrame, domain: Column, domains: list[str], size: int = VOCABULARY) -> DataFrame:
    """(word, ll): at most ``size`` words with their log likelihoods in the order of ``domains``.

    ``docs`` has ``text``; ``domain`` names each labelled document's domain. All words of all
    labelled documents are counted (partial sums before the shuffle).
    """
    words = docs.select(domain.alias("domain"), F.explode(_words(text_of())).alias("word")).where("word <> '' AND domain IS NOT NULL")
    counts = words.groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains)])
    counts = store(counts, "mixing-words")
    totals = counts.agg(F.count("*").alias("v"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(domains))]).first()
    sizes = [(totals[f"c{k}"] or 0) + 0.5 * totals["v"] for k in range(len(domains))]
    likelihood = [F.log((F.col(f"c{k}") + 0.5) / F.lit(max(n, 1.0))) for k, n in enumerate(sizes)]
    # a word tells domains apart by its spread of log likelihoods, weighted by how often it occurs
    total = sum((F.col(f"c{k}") for k in range(len(domains))), F.lit(0))
    mean = sum(likelihood, F.lit(0.0)) / len(domains)
    spread = total * (F.greatest(*likelihood) - mean) if len(domains) > 1 else total
    out = counts.select("word", F.array(*likelihood).alias("ll"), spread.alias("spread")).orderBy(F.desc("spread"), "word").limit(size)
    out = store(out.select("word", "ll"), "mixing-vocabulary")
    drop_stored(counts)
    return out


def posteriors(docs: DataFrame, words: DataFrame, prior: list[float], evidence: float = 30.0) -> DataFrame:
    """(row, copies, n_tokens, p): domain posteriors of the different rows of ``docs`` (``row``, ``text``)."""
    texts = docs.select("row", F.explode(_words(text_of())).alias("word")).where("word <> ''")
    d = range(len(prior))
    known = texts.join(F.broadcast(words), "word", "left")  # at most VOCABULARY rows
    sums = known.groupBy("row").agg(
        F.count("*").alias("n"), F.count("ll").alias("known"), *[F.sum(F.col("ll")[k]).alias(f"l{k}") for k in d]
    )
    rows = docs.groupBy("row").agg(F.count("*").alias("copies")).join(sums, "row", "left")
    # equal rows share a key, so the sums hold each of them
    rows = rows.withColumn("n_tokens", F.coalesce(F.expr("n div copies"), F.lit(0))).withColumn("known", F.col("known") / F.col("copies"))
    scale = F.when(F.col("known") > evidence, evidence / F.col("known")).otherwise(1.0)
    logits = [F.lit(math.log(max(prior[k], 1e-12))) + F.coalesce(F.col(f"l{k}") / F.col("copies") * scale, F.lit(0.0)) for k in d]
    top = F.greatest(*logits) if len(prior) > 1 else logits[0]
    e = F.transform(F.array(*logits), lambda x: F.exp(x - top))
    return rows.select("row", "copies", "n_tokens", e.alias("e")).select(
        "row", "copies", "n_tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p")
    )


def fit_rates(members: DataFrame, targets: list[float], ridge: float = 1e-4, tolerance: float = 1e-4, rounds: int = 120) -> DataFrame:
    """(row, n_tokens, p, rate) for rows (row, copies, n_tokens, p): rates whose expected shares match ``targets``.

    Stops when a round moves no share by more than ``tolerance * 0.1`` or after ``rounds`` rounds.
    """
    d = range(len(targets))
    total = members.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    eta = 1.0 / (1.0 + ridge)
    state = store(members.select("row", "copies", "n_tokens", "p", F.lit(1.0).alias("rate"), F.lit(1.0).alias("y")), "mixing-rates")
    ahead, current, last, momentum = 0, state, None, 1.0

    def shares(df: DataFrame, column: str) -> list[float]:
        got = df.agg(*[F.sum(F.col(column) * F.col("n_tokens") * F.col("copies") * F.col("p")[k]).alias(f"s{k}") for k in d]).first()
        return [float(got[k]) / total for k in d]

    for _ in range(rounds):
        s = shares(current, "y")
        if last and max(abs(a - b) for a, b in zip(s, last, strict=True)) < 0.1 * tolerance:
            break
        last = s
        slope = sum((F.col("p")[k] * (s[k] - targets[k]) for k in d), F.lit(0.0)) + ridge * (F.col("y") - 1.0)
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        moved = current.withColumn("next", F.greatest(F.lit(0.0), F.col("y") - eta * slope))
        current = moved.select("row", "copies", "n_tokens", "p", F.col("next").alias("rate"), (F.col("next") + (momentum - 1) / following * (F.col("next") - F.col("rate"))).alias("y"))
        momentum = following
        ahead += 1
        if ahead == ROUNDS_PER_TABLE:  # a short plan, and nothing is computed twice for long
            after = store(current, "mixing-rates")
            drop_stored(state)
            state, current, ahead = after, after, 0
    return current.select("row", "n_tokens", "p", "rate")


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id",
    ridge: float = 1e-4, evidence: float = 30.0, tolerance: float = 1e-4, per_domain: int = 4000,
) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_posterior`` (domain -> probability) and ``mix_rate``.

    ``labelled`` has (id_col, domain); ``targets`` maps each domain to its weight.
    """
    clash = {"mix_tokens", "mix_posterior", "mix_rate"} & set(docs.columns)
    if clash:
        raise ValueError(f"the input has columns named {sorted(clash)}; rename them")
    row = F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit(1), *docs.columns).alias("b"))
    marked = docs.withColumn("_row", row)
    domain = F.when(F.col("domain").isin(*targets), F.col("domain")).otherwise("other")
    named = (
        labelled.where(F.col("domain").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.min("domain").alias("domain")).select("_id", domain.alias("domain"))
    )
    priors = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(set(priors) | set(targets))
    weight, seen = sum(targets.values()), sum(priors.values())
    goal = [targets.get(d, 0.0) / weight for d in domains]
    rows = marked.select(F.col("_row").alias("row"), text_of(text_col).alias("text"))
    if not seen:
        p = F.array(*[F.lit(float(g)) for g in goal])
        fitted = rows.select("row").distinct().select("row", F.lit(0).cast("bigint").alias("n_tokens"), p.alias("p"), F.lit(1.0).alias("rate"))
    else:
        parts = [named.where(F.col("domain") == d).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(per_domain) for d in domains]
        sample = reduce(DataFrame.unionByName, parts)  # at most per_domain rows of each domain
        learn = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "_id").select("text", "domain")
        words = vocabulary(learn, F.col("domain"), domains)
        prior = [(priors.get(d, 0) + 0.5) / (seen + 0.5 * len(domains)) for d in domains]
        members = store(posteriors(rows, words, prior, evidence), "mixing-members")
        fitted = fit_rates(members, goal, ridge, tolerance)
    names = F.array(*[F.lit(d) for d in domains])
    out = fitted.select(
        F.col("row").alias("_row"), F.col("n_tokens").alias("mix_tokens"), F.map_from_arrays(names, "p").alias("mix_posterior"), F.col("rate").alias("mix_rate")
    )
    return marked.join(out, "_row").drop("_row")


def copies(rate_col: str = "mix_rate", *key_cols: str) -> Column:
    """Whole copies of a row for its rate: the floor, and one more with the probability of the rest (by a hash)."""
    draw = F.pmod(F.xxhash64(*key_cols, F.lit(29)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    return (F.floor(rate_col) + F.when(draw < F.col(rate_col) - F.floor(rate_col), 1).otherwise(0)).cast("bigint")
