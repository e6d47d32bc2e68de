"""Host-level quality rules: text statistics, failure rates by host, and verdicts for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.llm.common import NOT_SPACE, SPACE, as_row, back_to_columns, text_of, without_rows
from volsmith.session import stage

MIN_WORDS = 50
#: Words in repeated windows, in hundredths of all words, beyond which a text fails.
MAX_REPEATED = 50
#: A host is rejected where its shrunken failure rate, less two standard deviations, is above this.
MAX_HOST_RATE = 0.5
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
HOST = ["host_rate", "host_rejected", "kept"]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), use)[0]


def words_in_repeats(words: Column) -> Column:
    """Words that lie in a window of three words which the text has at least twice.

    Windows are sorted by hash, so that equal ones are neighbours; the starts of those that have an
    equal neighbour, in order, cover min(3, distance to the next start) words each. Two windows
    count as equal when their 64-bit hashes are.
    """
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.sort_array(F.transform(starts, lambda w, i: F.struct(
        F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(ordered, i + 1)["h"]) | (
            (i > 0) & (x["h"] == F.get(ordered, F.greatest(i - 1, F.lit(0)))["h"]))
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda total, x: total + x)

    return let(windows, lambda ordered: let(repeated(ordered), covered))


def rule_columns(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """A frame of ``row`` (all of ``docs``), ``host`` and the columns of ``RULES``.

    A null text has no words. Words are runs without white space; lines are split at line feeds.
    """
    body = text_of(text)
    words = F.filter(F.split("body", f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split("body", "\n"), lambda s: s.rlike(NOT_SPACE))
    numbers = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), words_in_repeats(w).cast("long").alias("n_repeat_words"))
    measured = as_row(docs, F.col(host).alias("host"), body.alias("body")).select(
        "row", "host", let(words, numbers).alias("of_words"),
        F.length(F.regexp_replace("body", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return measured.select("row", "host", "of_words.*", "word_chars", "n_symbols", "n_dup_lines").withColumn(
        "base_failed", failed)


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts that are rejected, with ``host_rate``; from rows of ``host`` and ``base_failed``.

    The failure rate of a host is shrunk by a beta prior whose two parameters follow from the mean
    and the variance of the hosts' rates (method of moments; binomial noise is taken off the
    variance). A host goes only when the posterior mean less two posterior standard deviations
    is above ``max_rate``: a few bad documents never condemn a host. Three sums over all hosts
    reach the driver.
    """
    hosts = stage(judged.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    rate = F.col("failed") / F.col("n")
    moments = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"),
                        F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"),
                        F.avg(1 / F.col("n")).alias("noise")).first()
    if moments["hosts"]:
        mean = (moments["failed"] + 0.5) / (moments["n"] + 1)
        spread = max(moments["spread"] - mean * (1 - mean) * moments["noise"], 1e-6)
        strength = max(mean * (1 - mean) / spread - 1, 1.0)
    else:
        mean, strength = 0.5, 1.0
    posterior = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    deviation = F.sqrt(posterior * (1 - posterior) / (F.col("n") + strength + 1))
    return stage(hosts.select("host", posterior.alias("host_rate"), (posterior - 2 * deviation).alias("low"))
                 .where(F.col("low") > max_rate).select("host", "host_rate"), "rejected")


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source",
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every row of ``docs`` with its rule columns, its rejected host's rate, and ``kept``.

    ``kept`` is false for texts that fail a base rule and for all texts of rejected hosts. The
    hosts' pass reads texts and shuffles one partial count for each host and task; rejected hosts, few
    or many, are joined by their measured size. Rows without a host are judged alone; empty and
    null texts fail (no words); repeated rows are judged alike; an empty table gives an empty
    result. A column of ``docs`` that has the name of an added one is replaced.
    """
    judged = rule_columns(docs, text, host)
    return with_hosts(judged, host_verdicts(judged.select("host", "base_failed"), max_rate), docs.columns)


def passing_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their own columns.

    The rules are evaluated once: places are staged with their verdicts, hosts are judged from that table, and
    the rows that fail are taken out of ``docs`` by place. ``docs`` has to be a stored table.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("of"))
    judged = stage(rule_columns(narrow, "text", "of").select("row.place", "host", "base_failed"), "judged")
    rejected = host_verdicts(judged.select("host", "base_failed"), max_rate)
    hosts = judged.where("not base_failed").join(rejected, "host", "left_semi").select("place")
    return without_rows(docs, stage(judged.where("base_failed").select("place").union(hosts), "failed"))


def with_hosts(judged: DataFrame, rejected: DataFrame, names: list[str]) -> DataFrame:
    """``judged`` rows with the verdicts of their hosts."""
    joined = judged.join(rejected, "host", "left").withColumn("host_rejected", F.col("host_rate").isNotNull())
    return back_to_columns(joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")),
                           names, RULES + HOST)
