"""Quality rules of documents and hosts, with DataFrame operations only.

Each whole text gets its measures and rule failures. Failures are summed by host. Hosts' true rates are taken to
follow a beta distribution: its mean is the corpus rate, and its spread is what the rates of hosts differ by beyond
what so many documents differ by chance. So a host's rate is shrunk towards the corpus the more, the fewer documents
it has and the less hosts differ. A host is suspect if its rate, by the posterior of its own failures, is above the
limit with probability SURE. Verdicts of hosts go back to documents: of a suspect host, documents that fail a rule of
their own go; elsewhere only those that fail a base rule. Documents that fail no rule stay everywhere.

Hosts with a thousandth of all documents or more, a thousand at most, are broadcast; documents of the others are joined
with their hosts by a shuffle. Null texts have no words; very long texts are measured whole; a null host is a host of its
own, and so is an empty one; repeated rows stay; of the table only key, text and host are read, so other names don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import SPACE, staged, with_table

_WHITE = " \t\n\x0b\f\r"
_MARKS = "#*$%&|<>"
WINDOW = 8
#: A host's limit: this many times the corpus rate, half at most.
TIMES, MOST_RATE = 1.5, 0.5
#: The probability of being above it that makes a host suspect, and its place on the normal distribution.
SURE, SURE_Z = 0.95, 1.6448536269514722
#: Documents of the corpus rate that the prior counts as, at least and at most.
PRIOR = (1.0, 1e6)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    dense = F.length(F.translate(t, _WHITE, "")).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    a = docs.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{host}`").alias("_host"), dense.alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, _MARKS, ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("_lines"),
        F.transform(F.filter(F.split(t, f"[{SPACE}]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_words"),
    )
    word = lambda i, k: F.get(F.col("_words"), i + k)
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[word(i, k) for k in range(WINDOW)]))
    )
    b = a.withColumn("_windows", windows)
    # only texts with a repeated window are sorted: by hash and place, equal neighbours are repeats
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    c = b.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get(F.col("_sorted"), i - 1)["h"] == x["h"]) | (F.get(F.col("_sorted"), i + 1)["h"] == x["h"])
    d = c.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda x, y: x + y
    )
    return d.select(
        F.col("_key").alias(key),
        F.col("_host").alias(host),
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def own_failed() -> Column:
    """A rule of the method fails: many symbols, many equal lines, many repeats, or odd word lengths."""
    n = F.col("n_words")
    return (5 * F.col("n_symbols") > n) | (
        3 * F.col("n_dup_lines") > F.col("n_lines")
    ) | (100 * F.col("n_repeat_words") > 20 * n) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight of the beta prior, from n and bad of each host. By moments: the hosts' squared differences from the
    mean, weighted by documents, less what they would be if all hosts had one rate."""
    t = hosts.agg(
        F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("bb")
    ).first()
    if not t["n"]:
        return 0.0, PRIOR[1]
    mean = t["bad"] / t["n"]
    chance, between = mean * (1 - mean), t["bb"] - t["n"] * mean * mean
    room = t["n"] - t["nn"] / t["n"] - (t["h"] - 1)
    spread = (between - (t["h"] - 1) * chance) / room if room > 0 else 0.0
    weight = chance / spread - 1 if spread > 0 else PRIOR[1]
    return mean, min(max(weight, PRIOR[0]), PRIOR[1])


def host_rates(rows: DataFrame, host: str) -> DataFrame:
    """_h (the host, null-safe), n, bad, host_rate (posterior mean) and host_suspect of each host."""
    hosts = rows.groupBy(_host(host).alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    hosts = staged(hosts, "hosts")
    mean, weight = prior(hosts)
    rate = (F.col("bad") + weight * mean) / (F.col("n") + weight)
    # the posterior's own spread; a beta of some weight is near enough to a normal one for a bound
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + weight + 1))
    limit = min(TIMES * mean, MOST_RATE)
    return hosts.withColumn("host_rate", rate).withColumn("host_suspect", (rate - SURE_Z * deviation > limit) & F.lit(mean > 0))


def _host(host: str) -> Column:
    """A name for each host, apart for null and empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit(""))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """measures() with base_failed, failed, host_rate, host_suspect and kept."""
    rows = staged(
        measures(docs, key, text, host).withColumn("base_failed", base_failed()).withColumn("failed", F.col("base_failed") | own_failed()),
        "rules"
    )
    judged = with_table(rows.withColumn("_h", _host(host)), host_rates(rows, host), "_h", "n").drop("_h", "bad")
    return judged.withColumn("kept", ~F.col("base_failed") & ~(F.col("failed") & F.col("host_suspect")))
