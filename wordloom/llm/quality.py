"""Quality rules by document and host, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import written

WINDOW = 5
#: Bad hosts are broadcast up to this many bytes of names and rows.
BROADCAST_BYTES = 8 << 20
#: Beyond it, rows of a host and the host's verdict are dealt into so many parts.
PARTS = 64


@dataclass(frozen=True)
class Rules:
    """Hard rules reject a document anywhere; soft ones only on a host that is judged bad.

    A host is bad if its share of hard failures, shrunk towards the beta prior that all hosts'
    shares suggest, lies more than ``bad_deviations`` standard deviations of that prior above its mean.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    bad_deviations: float = 2.0


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose value occurs twice or more, from (value, place) structs sorted by value."""
    twin = F.filter(
        F.transform(
            windows,
            lambda x, k: F.when(
                (F.get(windows, k - 1)["v"] == x["v"]) | (F.get(windows, k + 1)["v"] == x["v"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return F.sort_array(twin)


def measured(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(row, host, m): a struct of the columns to ``keep`` (all by default), the host, a struct of what the rules look at.

    A null text has no words."""
    keep = docs.columns if keep is None else keep
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    blank = r"[\x20\x09-\x0D]+"
    host = F.coalesce(F.concat(F.lit("h"), quoted(host_col).cast("string")), F.lit("-"))
    df = docs.select(F.struct(*map(quoted, keep)).alias("row"), host.alias("host"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", blank), ""))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    value = lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(WINDOW)))
    df = df.withColumn(
        "windows", F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: value(i))).otherwise(F.array().cast("array<long>"))
    )
    df = df.withColumn(
        "pairs",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda v, i: F.struct(v.alias("v"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<v:bigint,i:int>>")),
    )
    df = df.withColumn("at", _repeated(F.col("pairs")))
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    found = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    # through a generator, or filters would be pushed down with the whole expressions, once for every element
    return df.select("row", "host", F.explode(F.array(found)).alias("m"))


def hard_failure(rules: Rules) -> Column:
    return (F.col("m.n_words") < rules.min_words) | (
        100 * F.col("m.n_repeat_words") > rules.max_repeat_percent * F.col("m.n_words")
    )


def soft_failure(rules: Rules) -> Column:
    return (100 * F.col("m.n_symbols") > rules.max_symbol_percent * F.col("m.word_chars")) | (
        100 * F.col("m.n_dup_lines") > rules.max_dup_line_percent * F.col("m.n_lines")
    )


def host_verdicts(failures: DataFrame, deviations: float) -> DataFrame:
    """(host, share, bad) from (host, failed): each host's share of failures, shrunk by an empirical beta prior.

    The prior has the mean and variance of the hosts' shares (method of moments); where these admit
    no beta distribution its weight is one document. A host is bad where its shrunk share lies more
    than ``deviations`` of the prior's standard deviations above its mean; with equal shares none is.
    """
    hosts = failures.groupBy("host").agg(F.sum(F.col("failed").cast("long")).alias("failed"), F.count("*").alias("n"))
    hosts = written(hosts, "hosts")
    share = F.col("failed") / F.col("n")
    mean, var = hosts.agg(F.coalesce(F.avg(share), F.lit(0.0)), F.coalesce(F.var_pop(share), F.lit(0.0))).first()
    weight = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else 1.0
    shrunk = hosts.withColumn("share", (F.col("failed") + mean * weight) / (F.col("n") + weight))
    cut = mean + deviations * var**0.5 if var > 0 else float("inf")
    return shrunk.select("host", "share", (F.col("share") > cut).alias("bad"))


def judged(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(row, m, failed, bad_host, kept): ``row`` is a struct of the columns to ``keep``, all by default, so no name of theirs can clash.

    A document is kept if no hard rule fails and, where its host is bad, no soft one either. A null
    host is a host of its own; ties don't arise, as hosts are judged one by one. Rows are judged one
    by one, so null or repeated ids and an empty table need no rule; a null or empty text has no
    words and fails. A text of any length is one row.

    Texts are measured once and kept columns written with their measures; hosts' counts are summed
    by task before they travel. Only bad hosts are joined back: by a broadcast if their measured size
    allows it, so that no text is shuffled, or else in PARTS parts of each host, so that none is hot.
    """
    rows = written(measured(docs, text_col, host_col, keep), "measured")
    rows = rows.withColumn("failed", hard_failure(rules))
    bad = host_verdicts(rows.select("host", "failed"), rules.bad_deviations).where("bad").select("host", F.lit(True).alias("bad_host"))
    bad = written(bad, "bad_hosts")
    size = bad.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(bad), "host", "left")
    else:
        bad = bad.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        part = F.pmod(F.xxhash64("row", "m"), F.lit(PARTS)).cast("int")
        out = rows.withColumn("part", part).join(bad, ["host", "part"], "left")
    out = out.withColumn("bad_host", F.coalesce("bad_host", F.lit(False)))
    return out.select("row", "m", "failed", "bad_host", (~F.col("failed") & ~(F.col("bad_host") & soft_failure(rules))).alias("kept"))
