"""Quality rules judged by host. DataFrame functions only.

Each document gets a few counts and rule failures. Failures are added up by host, the host's
failure rate is shrunk towards that of all hosts by a beta prior fitted to them (method of
moments), and the host's verdict is joined back to its documents.

Edge cases: a null or empty text has no words and fails; a null host is a host of its own;
repeated rows count as rows and each gets the same verdict; an empty table gives an empty one;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, has_columns, stored, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bad hosts that are broadcast at most.
FEW_HOSTS = 10_000


def pair_hash(column: str, step: int) -> Column:
    """Hash of each element with the one ``step`` further on; the array gets ``step`` shorter."""
    n = F.size(column)
    rest = F.when(n > step, F.slice(column, step + 1, F.greatest(n - step, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    paired = F.zip_with(F.slice(column, 1, F.greatest(n - step, F.lit(0))), rest, lambda a, b: F.xxhash64(a, b))
    return paired


def with_repeat_words(df: DataFrame, tokens: str = "w") -> DataFrame:
    """Adds ``n_repeat_words``: the words inside windows of eight words that occur twice or more.

    Windows are compared by a 64-bit hash, within one document. The hashes come from three
    doublings (1, 2, 4, 8 words), each a column of its own so that it is computed once. Only
    texts in which a hash recurs take the last steps: the windows ordered by hash give the
    starts of the repeated ones, and each start adds what the one before hasn't covered.
    """
    df = df.withColumn("h1", F.transform(tokens, lambda x: F.xxhash64(x)))
    df = df.withColumn("h2", pair_hash("h1", 1))
    df = df.withColumn("h4", pair_hash("h2", 2))
    df = df.withColumn("h8", pair_hash("h4", 4))
    df = df.withColumn("again", F.size(F.array_distinct("h8")) < F.size("h8"))
    df = df.withColumn("o", F.when(F.col("again"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    none = F.lit(None).cast("array<int>")
    same = F.zip_with("o", F.slice("o", 2, F.greatest(F.size("o"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + (s + WINDOW) - F.greatest(s, acc["end"])).alias("n"), (s + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    repeated = F.when(F.col("again"), covered).otherwise(0)
    return df.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("h1", "h2", "h4", "h8", "again", "o")


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each row."""
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.col("`source`") if host is None else host).cast("string").alias("host"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"),
    )
    return counted(base).drop("t")


def counted(base: DataFrame) -> DataFrame:
    """Adds the counts of a text ``t`` to its row."""
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return with_repeat_words(base.withColumns({"w": words(F.col("t")), "l": lines})).select(
        *base.columns,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def failures(min_words: int, repeat_pct: int, symbol_pct: int, dup_line_pct: int) -> tuple[Column, Column]:
    """Whether counts break a base rule, and whether they break both softer rules."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))
    return base, (100 * F.col("n_symbols") > symbol_pct * F.col("word_chars")) & (100 * F.col("n_dup_lines") > dup_line_pct * F.col("n_words"))


def host_verdicts(stats: DataFrame, host_limit: float) -> DataFrame:
    """``host, host_docs, host_failed, host_rate, host_bad`` from ``host, failed``.

    ``host_rate`` is the posterior mean (failed + a) / (docs + a + b). a and b fit the mean and
    variance of the hosts' own rates; where these vary no more than chance would have them, the
    prior weighs as much as a host of mean size.
    """
    hosts = stats.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(
        F.sum("host_failed").alias("f"),
        F.sum("host_docs").alias("n"),
        F.count("*").alias("k"),
        F.var_pop(rate).alias("v"),
        F.avg(1 / F.col("host_docs")).alias("inv"),
    ).first()  # one row, whatever the number of hosts
    if not m["n"]:
        a, b = 1.0, 1.0
    else:
        mean = min(max(m["f"] / m["n"], 1e-6), 1 - 1e-6)
        spread = (m["v"] or 0.0) - mean * (1 - mean) * m["inv"]  # less what sampling alone adds
        weight = mean * (1 - mean) / spread - 1 if spread > 0 else m["n"] / m["k"]
        weight = min(max(weight, 1.0), max(m["n"] / m["k"], 1.0))
        a, b = mean * weight, (1 - mean) * weight
    shrunk = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", F.col("host_rate") > host_limit)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    min_words: int = 20,
    repeat_pct: int = 30,
    symbol_pct: int = 10,
    dup_line_pct: int = 30,
    host_limit: float = 0.5,
) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, the host's figures and ``kept``.

    A document is dropped if it fails a base rule (too short, too much repeated), if its host's
    shrunk rate of base failures is over ``host_limit``, or if it breaks both softer rules
    (symbols, duplicate lines) itself.
    """
    stats = document_stats(docs, id_col, text_col, host)
    base, soft = failures(min_words, repeat_pct, symbol_pct, dup_line_pct)
    stats = stored(stats.withColumn("base_failed", base).withColumn("soft_failed", soft).withColumn("failed", base), "quality-stats")
    hosts = host_verdicts(stats, host_limit).withColumnRenamed("host", "h")
    return stats.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("soft_failed") & ~F.coalesce("host_bad", F.lit(False))).alias("kept"),
        "host", "host_docs", "host_failed", "host_rate",
    )


def keep_good(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    min_words: int = 20,
    repeat_pct: int = 30,
    symbol_pct: int = 10,
    dup_line_pct: int = 30,
    host_limit: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, columns unchanged; each row is judged by itself.

    Rows are written once beside their own verdict (those that fail it without their columns), so that
    only verdicts of hosts have to be joined, and no text is shuffled. Bad hosts are broadcast up
    to ``FEW_HOSTS`` of them, and joined by their names beyond that.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    base = docs.select(row.alias("row"), (F.col("`source`") if host is None else host).cast("string").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    stats = counted(base)
    base_failed, soft_failed = failures(min_words, repeat_pct, symbol_pct, dup_line_pct)
    judged = stored(stats.select("host", base_failed.alias("failed"), F.when(~base_failed & ~soft_failed, F.col("row")).alias("row")), "quality-rows")
    bad = stored(host_verdicts(judged.select("host", "failed"), host_limit).filter("host_bad").select(F.col("host").alias("h")), "quality-hosts")
    if bad.count() <= FEW_HOSTS:
        bad = F.broadcast(bad)
    return judged.filter("row IS NOT NULL").join(bad, F.col("host").eqNullSafe(F.col("h")), "left_anti").select("row.*")


def op5_rows(docs: DataFrame) -> DataFrame:
    judged = quality_rules(has_columns(docs, "doc_id", "text", "source")).drop("host", "host_docs", "host_failed")
    return judged.withColumn("host_rate", F.round("host_rate", 6))
