"""Quality rules by document and by host, in DataFrame operations only.

Each document is measured inside its own row (no exploded words, no shuffle of text). The rule
failures are then summed by host, each host's failure rate is shrunk towards the rate of all
hosts by a beta prior that is estimated from the hosts themselves (method of moments), and the
host's verdict is joined back to its documents.

A host with few documents keeps close to the common rate; one with many is judged by its own.
Only the counts of a host leave a task, so a host with a third of all rows is one small row per
task. The measures are written once to the shared folder, so that the text is read once.

Defined results: a null text is empty. A null host has no verdict, its documents stand on their
own. Rows are judged one by one: repeated rows give repeated results and count each, a null id
stays null, columns other than the named ones are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from dripline.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Further rules, which only count for the host: more symbols than this share of the characters in
# words, more repeated lines than this share of the words.
MAX_SYMBOL_PERCENT = 10
MAX_LINE_PERCENT = 20

# A host goes if more than this share of its documents is expected to fail a rule.
MAX_HOST_RATE = 0.6


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, though used many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    parts = F.split(text, SPACE)
    return F.filter(parts, lambda x: x != "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that is found twice or more.

    The windows are hashed and sorted with their places; a window whose neighbour in that order is
    equal is repeated. Its words reach to the next repeated window at most, so no word counts twice.
    """
    n = F.size(words)

    def marked(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return bind(F.sort_array(placed), covered)

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        repeated = F.filter(
            ordered,
            lambda x, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"]))
            | ((j < last) & (F.get(ordered, j + 1)["h"] == x["h"])),
        )
        return bind(F.sort_array(F.transform(repeated, lambda x: x["i"])), reach)

    def reach(places: Column) -> Column:
        gaps = F.transform(
            places,
            lambda p, j: F.least(
                F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))
            ),
        )
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def counted(hashes: Column) -> Column:
        # Most texts repeat nothing; a set of the hashes tells without sorting.
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), marked(hashes)
        ).otherwise(F.lit(0).cast("bigint"))

    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(n < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(bind(hashes, counted))


def measures(text: Column) -> dict[str, Column]:
    """n_words and n_repeat_words as one struct, and the other measures, of a text column."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    return {
        "by_words": bind(
            words_of(filled),
            lambda words: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                repeated_words(words).alias("n_repeat_words"),
                F.aggregate(
                    words,
                    F.lit(0).cast("bigint"),
                    lambda total, x: total + F.length(x),
                ).alias("word_chars"),
            ),
        ),
        "n_symbols": (
            F.length(filled) - F.length(F.translate(filled, SYMBOLS, ""))
        ).cast("bigint"),
        "n_dup_lines": bind(
            lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")
        ),
    }


def rule_failures() -> dict[str, Column]:
    """The rules, as conditions on the measures of a document."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > MAX_LINE_PERCENT * n,
    }


def measured(documents: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    found = measures(F.col("text"))
    flat = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")
    ).select("doc_id", "host", *(column.alias(name) for name, column in found.items()))
    flat = flat.select(
        "doc_id",
        "host",
        "by_words.n_words",
        "by_words.word_chars",
        "n_symbols",
        "n_dup_lines",
        "by_words.n_repeat_words",
    )
    rules = rule_failures()
    return flat.select(
        "*",
        (rules["short"] | rules["repeats"]).alias("base_failed"),
        F.struct(*(rule.alias(name) for name, rule in rules.items())).alias("failed"),
    )


def host_verdicts(rows: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures by rule, the shrunk rate, and whether it is kept.

    The prior has the mean and variance of the hosts' own rates: with mean m, variance v and
    strength s = m (1 - m) / v - 1 it is Beta(m s, (1 - m) s). Hosts that do not differ (v = 0)
    are judged by the common rate alone, as an infinitely strong prior has it.
    """
    any_rule = F.col("failed.short") | F.col("failed.repeats")
    any_rule = any_rule | F.col("failed.symbols") | F.col("failed.lines")
    hosts = materialize(
        rows.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(any_rule.cast("bigint")).alias("n_failed"),
            *(
                F.sum(F.col(f"failed.{name}").cast("bigint")).alias(f"n_{name}")
                for name in rule_failures()
            ),
        )
        .withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    )
    # Two numbers, however many hosts there are.
    mean, variance = hosts.agg(F.avg("rate"), F.var_pop("rate")).first()
    if not variance:
        shrunk = F.lit(mean or 0.0)
    else:
        strength = max(mean * (1 - mean) / variance - 1, 0.0)
        shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn(
        "host_kept", F.col("shrunk_rate") <= F.lit(max_rate)
    )


def quality_verdicts(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """One row per document: its measures, its failures, its host's rate, and ``kept``."""
    rows = materialize(measured(documents, doc_id, text, host))
    verdicts = host_verdicts(rows, max_rate).select(
        F.col("host").alias("known_host"), "shrunk_rate", "host_kept"
    )
    return rows.join(verdicts, F.col("host") == F.col("known_host"), "left").select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "failed",
        "base_failed",
        F.col("shrunk_rate").alias("host_rate"),
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"),
    )
