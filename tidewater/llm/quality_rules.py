"""Quality rules with host verdicts.

Each document is tested by rules of its own.  Rule failures are summed by host
(the ``source`` column), each host's failure rate is shrunk with a beta prior
fitted to all hosts by the method of moments, and the verdict on the host is
joined back to its documents.

Defined cases: a null text has no words and fails; null hosts form one host;
an empty table gives an empty result; repeated rows are judged one by one;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import materialize
from tidewater.llm.textstats import stats_batches

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A document whose words are more than this share of symbols fails.
SYMBOL_PERCENT = 8
#: A host whose shrunk failure rate is at least this loses all its documents.
HOST_RATE = 0.5


def base_counts(docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep`` and the counts of :mod:`textstats`, one row per document."""
    fields = [docs.schema[c] for c in keep] + [T.StructField(prefix + c, T.LongType()) for c in COUNTS]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(stats_batches(COUNTS, keep, prefix), T.StructType(fields))


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * words)


def symbols_failed(prefix: str = "") -> Column:
    return 100 * F.col(f"{prefix}n_symbols") > SYMBOL_PERCENT * F.col(f"{prefix}word_chars")


def host_of() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("none"))


def host_verdicts(rated: DataFrame) -> DataFrame:
    """host, n, rate (shrunk), host_ok from rows of (host, failed).

    Only sums by host are shuffled.  The prior's mean and weight come from one
    row of moments over hosts.
    """
    hosts = rated.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    hosts = hosts.withColumn("r", F.col("f") / F.col("n"))
    m = hosts.agg(F.sum("f").alias("f"), F.sum("n").alias("n"), F.var_pop("r").alias("v")).first()
    mean = (m["f"] / m["n"]) if m["n"] else 0.0
    weight = max(2.0, min(1e4, mean * (1 - mean) / m["v"] - 1)) if m["v"] else 1e4
    rate = (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", "n", rate.alias("rate"), (rate < HOST_RATE).alias("host_ok"))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts, rule outcomes, the host's rate and ``kept`` per document."""
    keep = keep or ["doc_id", "source"]
    base = materialize(base_counts(docs, keep), "rules")
    base = base.withColumns({"host": host_of(), "base_failed": base_failed(), "symbols_failed": symbols_failed()})
    base = base.withColumn("failed", F.col("base_failed") | F.col("symbols_failed"))
    hosts = host_verdicts(base)
    kept = ~F.col("failed") & F.col("host_ok")
    return base.join(hosts.select("host", "rate", "host_ok"), "host").withColumn("kept", kept)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    The texts are read twice, once for the hosts' sums and once to filter, so
    that no text is shuffled.
    """
    p = "_rules_"
    failed = base_failed(p) | symbols_failed(p)
    rated = base_counts(docs, ["source"], p).select(host_of().alias("host"), failed.alias("failed"))
    hosts = host_verdicts(rated).filter("host_ok").select(F.col("host").alias(f"{p}host"))
    good = base_counts(docs, docs.columns, p).filter(~failed).withColumn(f"{p}host", host_of())
    return good.join(hosts, f"{p}host", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
