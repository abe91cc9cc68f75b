"""Mixing to target weights with soft membership, in DataFrame operations only.

Which domain a document belongs to is not known for most documents, so it is predicted: a naive
Bayes classifier is counted from labelled documents as a table of log-likelihoods, one row for
each telling word and each bin of a few statistics, and gives every document a posterior over the
domains. A document then adds to every domain in proportion to its posterior.

The mixture is a rate for each document (how often it is drawn, 0 or more) such that the expected
tokens by domain match the targets. Among all such rates, those nearest to 1 are wanted (least
squares over tokens). They are found by lazy projection with damped Newton steps instead of plain
gradient steps: the steps by domain are summed up, and a document's rate is

    1 - posterior . summed steps, projected to 0 or above (to 0 .. max_rate if there is one)

One step needs the tokens drawn by domain and their curvature (how they answer to a change), a few
sums over all documents; a step solves the small matrix of curvatures on the driver, and a step that
gains too little of the dual value (least squares plus the steps' part, which is largest at the
wanted rates) is halved. It ends when the targets are met or, if they cannot be, when no step gains,
and then has the rates that came nearest. Tokens wanted and drawn by domain are returned, and a miss
is logged as a warning. A domain without a target takes no part: its tokens follow from the others.
Rates are an expression of the posterior, so none are stored or moved.

Bounds: the classifier is counted on at most ``per_domain`` labelled documents of each domain (the
smallest by hash) and uses at most ``n_words`` words; everything else covers all documents. Only
sums by domain, the classifier's table and the steps reach the driver.

Defined results: labels without a document here teach nothing, not even the prior. A null or empty
text has no tokens and keeps the rate its posterior gives; a null id is not learned. Repeated rows
are learned once and count each in the totals. A domain without labelled documents, or without
tokens, takes no part; if none is left, every rate is 1. An empty table gives no rows. Columns other
than the named ones are not read.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dripline.llm.host_rules import SPACE, bind
from dripline.llm.support import smallest_by_hash
from dripline.session import materialize

PER_DOMAIN = 3_000
N_WORDS = 200
SMOOTHING = 1.0
STEPS = 40
TOLERANCE = 1e-4
LEAST_SCALE = 1 / 64
LEAST_GAIN = 1e-4
# For callers that want a cap: no document is drawn more often than this. The operators have none.
MAX_RATE = 4.0

_log = logging.getLogger(__name__)

# Shares of the tokens of the mixture, by domain.
TARGETS = {"good": 0.88, "low": 0.06, "toxic": 0.06}

# Upper ends of the bins of the statistics; the last bin is open.
BINS = {
    "symbols": (0.0, 0.01, 0.03, 0.06, 0.12),
    "marks": (0.005, 0.02, 0.05, 0.10),
    "upper": (0.01, 0.03, 0.08, 0.25, 0.5),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9),
}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the label table: toxic, low or good; the worst of several rows."""
    return (
        labels.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select(
            "doc_id",
            F.when(F.col("toxic") == 1, "toxic")
            .when(F.col("quality") == 0, "low")
            .when(F.col("quality") == 1, "good")
            .alias("domain"),
        )
    )


def words_of(text: Column) -> Column:
    """The lower-cased runs of letters and digits (and characters beyond ASCII) of a text."""
    return F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def evidence(text: Column) -> dict[str, Column]:
    """Tokens (words between white space), distinct words, and bins of the statistics."""
    filled = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(filled), F.lit(1))

    def share_of(kept: str) -> Column:
        return F.length(F.regexp_replace(filled, f"[^{kept}]+", "")) / size

    return {
        "found": bind(
            F.array_remove(words_of(filled), ""),
            lambda words: bind(
                F.array_distinct(words),
                lambda distinct: F.struct(
                    F.size(words).alias("n"),
                    (F.size(distinct) / F.greatest(F.size(words), F.lit(1))).alias("distinct"),
                    distinct.alias("words"),
                ),
            ),
        ),
        "symbols": share_of("#*$%&|<>"),
        "marks": share_of("!?"),
        "upper": share_of("A-Z"),
        "n_tokens": F.size(F.array_remove(F.split(filled, SPACE), "")).cast("bigint"),
    }


def bin_of(value: Column, ends: tuple[float, ...]) -> Column:
    return sum(((value > end).cast("int") for end in ends), F.lit(0))


def binned(rows: DataFrame) -> dict[str, Column]:
    found = {"distinct": F.col("found.distinct")}
    return {name: bin_of(found.get(name, F.col(name)), ends) for name, ends in BINS.items()}


@dataclass
class Classifier:
    """By domain: log of the prior, log of each word's share of texts over its mean share, and log
    of each bin's share. A word that a text lacks says nothing: short texts lack most words."""

    domains: list[str]
    constant: list[float]
    words: dict[str, list[float]]
    bins: dict[str, list[list[float]]]

    def posteriors(self, rows: DataFrame, *kept: str) -> DataFrame:
        """The kept columns of rows with evidence, ``n_tokens``, and an array of posteriors."""
        k = len(self.domains)
        if k == 0:
            none = F.array().cast("array<double>")
            return rows.select(*kept, "n_tokens", none.alias("posterior"))
        if self.words:
            vocabulary = F.array(*(F.lit(word) for word in self.words))
            weights = F.create_map(
                *(
                    x
                    for word, by_domain in self.words.items()
                    for x in (F.lit(word), F.array(*(F.lit(w) for w in by_domain)))
                )
            )
            by_words = F.aggregate(
                F.array_intersect(F.col("found.words"), vocabulary),
                F.array(*(F.lit(c) for c in self.constant)),
                lambda total, word: F.zip_with(total, weights[word], lambda a, b: a + b),
            )
        else:
            by_words = F.array(*(F.lit(c) for c in self.constant))
        table = {
            name: F.array(*(F.array(*(F.lit(v) for v in by_domain)) for by_domain in by_bin))
            for name, by_bin in self.bins.items()
        }
        places = {f"__bin_{name}": place for name, place in binned(rows).items()}
        logs = rows.select(
            *kept, "n_tokens", by_words.alias("__words"), *(p.alias(n) for n, p in places.items())
        ).select(
            *kept,
            "n_tokens",
            *(
                sum(
                    (F.get(F.get(table[name], F.col(f"__bin_{name}")), F.lit(d)) for name in table),
                    F.get(F.col("__words"), F.lit(d)),
                ).alias(f"__log_{d}")
                for d in range(k)
            ),
        )
        largest = F.array_max(F.array(*(F.col(f"__log_{d}") for d in range(k))))
        shifted = logs.select(
            *kept,
            "n_tokens",
            *(F.exp(F.col(f"__log_{d}") - largest).alias(f"__e_{d}") for d in range(k)),
        )
        total = sum((F.col(f"__e_{d}") for d in range(1, k)), F.col("__e_0"))
        return shifted.select(
            *kept,
            "n_tokens",
            F.array(*(F.col(f"__e_{d}") / total for d in range(k))).alias("posterior"),
        )


def fit_classifier(
    documents: DataFrame,
    labelled: DataFrame,
    per_domain: int = PER_DOMAIN,
    n_words: int = N_WORDS,
) -> Classifier:
    """Count the table from documents (doc_id, text) and labels (doc_id, domain).

    Priors and sample are those of the labels that have a document here.
    """
    known = materialize(
        labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).join(
            documents.select("doc_id").dropDuplicates(), "doc_id", "left_semi"
        )
    )
    chosen = smallest_by_hash(known, "domain", "doc_id", per_domain)
    texts = (
        # At most per_domain ids of each domain.
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "domain")
        .agg(F.min("text").alias("text"))
    )
    sample = texts.select(
        "doc_id", "domain", *(c.alias(n) for n, c in evidence(F.col("text")).items())
    )
    sample = materialize(
        sample.select("domain", F.col("found.words").alias("words"), *(
            c.alias(n) for n, c in binned(sample).items()
        ))
    )
    weights = {row["domain"]: row["n"] for row in known.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n")
    ).collect()}
    totals = {row["domain"]: row["n"] for row in sample.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n")
    ).collect()}
    domains = sorted(totals)
    if not domains:
        return Classifier([], [], {}, {})

    def smoothed(n: Column, domain: str, kinds: int) -> Column:
        return (F.coalesce(n, F.lit(0)) + SMOOTHING) / (totals[domain] + kinds * SMOOTHING)

    by_word = (
        sample.select("domain", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(
            *(
                F.sum((F.col("domain") == domain).cast("bigint")).alias(f"n_{d}")
                for d, domain in enumerate(domains)
            )
        )
    )
    shares = [smoothed(F.col(f"n_{d}"), domain, 2) for d, domain in enumerate(domains)]
    n = len(domains)
    mean = sum(shares[1:], shares[0]) / n
    spread = sum(((p - mean) * F.log(p / mean) for p in shares), F.lit(0.0))
    found = (
        by_word.select(
            "word", spread.alias("spread"), *(p.alias(f"p_{d}") for d, p in enumerate(shares))
        )
        .orderBy(F.desc("spread"), "word")
        .limit(n_words)
        .collect()
    )
    everyone = sum(weights.get(domain, 0) for domain in domains)
    constant = [math.log(weights[domain] / everyone) for domain in domains]
    words = {}
    for row in found:
        p = [row[f"p_{d}"] for d in range(n)]
        words[row["word"]] = [math.log(x * n / sum(p)) for x in p]
    bins = {}
    for name, ends in BINS.items():
        size = len(ends) + 1
        counted = {
            (row["domain"], row["bin"]): row["n"]
            for row in sample.groupBy("domain", F.col(name).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        }
        bins[name] = [
            [
                math.log(
                    (counted.get((domain, i), 0) + SMOOTHING)
                    / (totals[domain] + size * SMOOTHING)
                )
                for domain in domains
            ]
            for i in range(size)
        ]
    return Classifier(domains, constant, words, bins)


@dataclass
class Mixture:
    """Domains, summed gradients by domain, and tokens by domain: there are, wanted, drawn.

    A domain without a target wants None. Without ``max_rate`` rates have no upper bound.
    """

    domains: list[str]
    pull: list[float]
    available: list[float]
    wanted: list[float | None]
    drawn: list[float]
    max_rate: float | None = None

    def pulled(self) -> Column:
        return sum(
            (F.get(F.col("posterior"), F.lit(d)) * F.lit(x) for d, x in enumerate(self.pull)),
            F.lit(0.0),
        )

    def rate(self) -> Column:
        """The rate of a document as an expression of its posterior."""
        if not any(self.pull):
            return F.lit(1.0)
        rate = F.greatest(F.lit(1.0) - self.pulled(), F.lit(0.0))
        return rate if self.max_rate is None else F.least(rate, F.lit(self.max_rate))

    def missed(self, tolerance: float = TOLERANCE) -> dict[str, tuple[float, float]]:
        """(wanted, drawn) tokens of each domain whose target is missed by more than a share of
        all the tokens wanted."""
        total = sum(x for x in self.wanted if x is not None)
        return {
            name: (wanted, drawn)
            for name, wanted, drawn in zip(self.domains, self.wanted, self.drawn, strict=True)
            if wanted is not None and abs(drawn - wanted) > tolerance * total
        }


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The shortest solution of a small system: a domain that no rate can move gets 0."""
    return np.linalg.lstsq(np.array(matrix), np.array(right), rcond=1e-12)[0].tolist()


def fit_rates(
    members: DataFrame,
    domains: list[str],
    targets: dict[str, float],
    budget: float = 1.0,
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
    max_rate: float | None = MAX_RATE,
) -> Mixture:
    """Fit over rows (n_tokens, posterior). ``budget`` scales all the tokens there are.

    ``max_rate`` None sets no upper bound, as the operators do. ``members`` is summed once per step, so it should be stored.
    """
    k = len(domains)
    p = [F.get(F.col("posterior"), F.lit(d)) for d in range(k)]
    tokens = F.col("n_tokens")

    def drawn_with(pull: list[float]) -> tuple[list[float], list[list[float]], float]:
        """Tokens drawn by domain, how they answer to a change of the pull, and the dual value
        without the targets' part."""
        there = Mixture(domains, pull, [], [], [], max_rate)
        rate = there.rate()
        moves = (rate > 0 if max_rate is None else (rate > 0) & (rate < max_rate)).cast("double")
        none = F.lit(0.0)
        value = tokens * ((rate - 1) * (rate - 1) / 2 + there.pulled() * rate)
        row = members.agg(
            F.coalesce(F.sum(value), none).alias("value"),
            *(F.coalesce(F.sum(tokens * p[i] * rate), none).alias(f"a_{i}") for i in range(k)),
            *(
                F.coalesce(F.sum(tokens * p[i] * p[j] * moves), none).alias(f"g_{i}_{j}")
                for i in range(k)
                for j in range(i, k)
            ),
        ).first()
        answer = [[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
        return [row[f"a_{i}"] for i in range(k)], answer, row["value"]

    if k == 0:
        return Mixture([], [], [], [], [])
    available, answer, value = drawn_with([0.0] * k)
    part = [i for i in range(k) if domains[i] in targets and available[i] > 0]
    asked = {i: max(0.0, targets[domains[i]]) for i in part}
    total = sum(available[i] for i in part) * budget
    if total == 0 or sum(asked.values()) == 0:
        return Mixture(domains, [0.0] * k, available, [None] * k, available, max_rate)
    # A domain that takes no part wants what it gets.
    wanted = [total * asked[i] / sum(asked.values()) if i in asked else None for i in range(k)]
    mixture = Mixture(domains, [0.0] * k, available, wanted, list(available), max_rate)

    def off(drawn: list[float]) -> float:
        return max(abs(drawn[i] - wanted[i]) for i in part)

    pull, drawn, nearest = mixture.pull, mixture.drawn, mixture
    scale, step = 1.0, None
    for _ in range(steps):
        if off(drawn) <= tolerance * total or scale < LEAST_SCALE:
            break
        if step is None:
            gradient = [drawn[i] - wanted[i] for i in part]
            solved = solve([[answer[i][j] for j in part] for i in part], gradient)
            step = [0.0] * k
            for i, x in zip(part, solved, strict=True):
                step[i] = x
            gain = sum(x * y for x, y in zip(solved, gradient, strict=True))
            if gain <= tolerance * tolerance * total:
                break
        tried = [x + scale * y for x, y in zip(pull, step, strict=True)]
        drawn_there, answer_there, value_there = drawn_with(tried)
        value_there -= sum(tried[i] * wanted[i] for i in part)
        if off(drawn_there) < off(nearest.drawn):
            nearest = replace(mixture, pull=tried, drawn=drawn_there)
        met = off(drawn_there) <= tolerance * total
        if met or value_there >= value + LEAST_GAIN * scale * gain:
            pull, drawn, answer, value = tried, drawn_there, answer_there, value_there
            scale, step = min(1.0, 2 * scale), None
        else:
            scale /= 2
    for name, (asked_for, got) in nearest.missed(tolerance).items():
        _log.warning("target of %s missed: %.1f tokens wanted, %.1f drawn", name, asked_for, got)
    return nearest


def mix(documents: DataFrame, *args, **settings) -> DataFrame:
    """(doc_id, n_tokens, domain probabilities as a map, rate) of each document."""
    return mixed(documents, *args, **settings)[0]


def mixed(
    documents: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    budget: float = 1.0,
    max_rate: float | None = None,
    **settings,
) -> tuple[DataFrame, Mixture]:
    """The rows of :func:`mix`, and the mixture with the tokens wanted and drawn by domain."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    classifier = fit_classifier(docs, labelled, **settings)
    rows = docs.select("doc_id", *(c.alias(n) for n, c in evidence(F.col("text")).items()))
    members = materialize(classifier.posteriors(rows, "doc_id"))
    mixture = fit_rates(members, classifier.domains, targets, budget, max_rate=max_rate)
    names = F.array(*(F.lit(x) for x in classifier.domains)).cast("array<string>")
    rows = members.select(
        "doc_id",
        "n_tokens",
        F.map_from_arrays(names, F.col("posterior")).alias("domains"),
        mixture.rate().alias("rate"),
    )
    return rows, mixture


def with_rate(documents: DataFrame, *args, **settings) -> DataFrame:
    """The documents with their rate in column ``name`` (replaced if there is one)."""
    return rated(documents, *args, **settings)[0]


def rated(
    documents: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    name: str = "mix_rate",
    text: str = "text",
    budget: float = 1.0,
    max_rate: float | None = None,
    **settings,
) -> tuple[DataFrame, Mixture]:
    """The rows of :func:`with_rate`, and the mixture with the tokens wanted and drawn by domain."""
    plain = documents.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text"))
    classifier = fit_classifier(plain, labelled, **settings)
    found = evidence(F.col(text))
    kept = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__row")
    rows = documents.select(kept, *(c.alias(n) for n, c in found.items()))
    members = classifier.posteriors(rows, "__row")
    narrow = materialize(members.select("n_tokens", "posterior"))
    mixture = fit_rates(narrow, classifier.domains, targets, budget, max_rate=max_rate)
    columns = [c for c in documents.columns if c != name]
    rows = members.select(*(F.col(f"__row.`{c}`") for c in columns), mixture.rate().alias(name))
    return rows, mixture
