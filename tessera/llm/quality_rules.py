"""Host-level quality rules, in DataFrame functions only.

Every document gets a handful of counts and rule outcomes. The outcomes are added up by host, each host's
failure rate is shrunk towards a beta prior fitted to all hosts (empirical Bayes, by weighted moments), and the host's
verdict is joined back to its documents.

A document is dropped if it breaks a base rule, or if its host fails a rule clearly more often than hosts do *and* the
document breaks the stricter form of that rule. So a clean document stays whatever its host is.

*Prior.* For a rule let host i have n_i documents, k_i of which fail, N documents and H hosts in all, m = sum k / N. Chance
alone makes S = sum n_i (k_i / n_i - m)^2 about (H - 1) m (1 - m); what is beyond it tells the correlation within hosts,

    rho = (S - (H - 1) m (1 - m)) / (m (1 - m) (N - sum n_i^2 / N - (H - 1))),

and the prior is Beta(m w, (1 - m) w) with w = (1 - rho) / rho, one document at least. Where hosts differ by no more than chance
(rho <= 0), or where there is nothing to tell it from, w is N. A host is suspect if its shrunk rate is over
``host_excess`` times m.

Defined results: null or empty text has 0 words and fails the length rule; a null host is a host of its own;
repeated rows are counted and returned as often as they occur; a text of any length is measured whole; other columns are
carried along untouched whatever their names (the operator's own results replace input columns of the same name); an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, cut

SYMBOLS = "#*$%&|<>"
#: Rules whose rates are tracked by host.
RULES = ("short", "repeats", "symbols", "duplicate_lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """Base limits, the stricter ones for documents of suspect hosts, and when a host is suspect."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 50
    dup_line_percent: int = 50
    strict_min_words: int = 60
    strict_repeat_percent: int = 35
    strict_symbol_percent: int = 25
    strict_dup_line_percent: int = 35
    #: A host is suspect for a rule if its shrunk failure rate is over so many times the rate of all documents.
    host_excess: float = 1.5
    #: Hosts with a share of at least so many documents get their verdicts by broadcast: at most 1 / hot_share hosts.
    hot_share: float = 1e-4


def measures(text: Column) -> dict[str, Column]:
    """Array and count expressions of one text; keys in the order in which they build on each other."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    return {
        "_w": F.filter(F.split(t, r"[ \t-\r]+"), lambda x: x != ""),
        "_lines": lines,
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    }


def _windows() -> Column:
    """(hash, place) of every 3-word window, sorted by hash: equal windows become neighbours."""
    w, n = F.col("_w"), F.size("_w")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))


def _repeated() -> Column:
    """Places, ascending, of the windows found twice or more."""
    s = F.col("_s")

    def place(x: Column, i: Column) -> Column:
        return F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])

    return F.sort_array(F.filter(F.transform(s, place), lambda p: p.isNotNull()))


def _covered() -> Column:
    """Words under windows that start at the places in _r: each adds 3, less what the next one covers too."""
    r = F.col("_r")
    return F.aggregate(F.transform(r, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(r, i + 1) - p), F.lit(3))), F.lit(0), lambda a, x: a + x).cast("long")


def document_measures(docs: DataFrame, text: str = "text", host: str = "source", drop: tuple[str, ...] = ()) -> DataFrame:
    """row (the other columns of ``docs`` in one struct, less ``drop``), of (the host), the counts of COUNTS and n_lines.

    Windows are compared by a 64-bit hash within one document only.
    """
    carried = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in drop]
    df = docs.select(F.struct(*carried).alias("row"), F.col(f"`{host}`").alias("of"), *[e.alias(n) for n, e in measures(F.col(f"`{text}`")).items()])
    df = df.withColumns({"_s": _windows(), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_lines": F.size("_lines").cast("long"), "n_words": F.size("_w").cast("long")})
    df = df.drop("_w", "_lines").withColumn("_r", _repeated()).drop("_s")
    return df.withColumn("n_repeat_words", _covered()).drop("_r")


def rule_failures(limits: Limits, strict: bool = False) -> dict[str, Column]:
    """Whether a document breaks each rule; integer arithmetic, so that no engine rounds."""
    p = limits
    words, rep, sym, dup = (p.strict_min_words, p.strict_repeat_percent, p.strict_symbol_percent, p.strict_dup_line_percent) if strict else (p.min_words, p.repeat_percent, p.symbol_percent, p.dup_line_percent)
    return {
        "short": F.col("n_words") < words,
        "repeats": F.col("n_repeat_words") * 100 > rep * F.col("n_words"),
        "symbols": F.col("n_symbols") * 100 > sym * F.col("n_words"),
        "duplicate_lines": F.col("n_dup_lines") * 100 > dup * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, limits: Limits) -> DataFrame:
    """One row a host: documents, shrunk failure rate and verdict of each rule."""
    failures = rule_failures(limits)
    hosts = measured.groupBy(F.col("of").alias("host")).agg(F.count("*").alias("n_docs"), *[F.sum(failures[r].cast("long")).alias(f"k_{r}") for r in RULES])
    prior = hosts.agg(
        F.count("*").alias("n_hosts"), F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("squares"),
        *[x for r in RULES for x in (F.sum(f"k_{r}").alias(f"all_{r}"), F.sum(F.col(f"k_{r}").cast("double") * F.col(f"k_{r}") / F.col("n_docs")).alias(f"spread_{r}"))],
    )
    joined = hosts.join(F.broadcast(prior))  # one row

    def rate(r: str) -> tuple[Column, Column]:
        n, m = F.col("all_docs").cast("double"), F.col(f"all_{r}") / F.col("all_docs")
        chance, room = (F.col("n_hosts") - 1) * m * (1 - m), m * (1 - m) * (n - F.col("squares") / n - (F.col("n_hosts") - 1))
        rho = F.when(room > 1e-9, (F.col(f"spread_{r}") - n * m * m - chance) / room)
        w = F.when(rho > 1e-9, F.greatest(F.lit(1.0), (1 - rho) / rho)).otherwise(n)
        return (F.col(f"k_{r}") + m * w) / (F.col("n_docs") + w), m

    rates = {r: rate(r) for r in RULES}
    return joined.select("host", "n_docs", "all_docs", *[rates[r][0].alias(f"rate_{r}") for r in RULES], *[(rates[r][0] > limits.host_excess * rates[r][1]).alias(f"suspect_{r}") for r in RULES])


def quality_verdicts(docs: DataFrame, host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Every row of ``docs`` (without its text) with its counts, host rates, ``base_failed`` and ``kept``."""
    told = ["n_docs", *[f"{a}_{r}" for a in ("rate", "suspect") for r in RULES]]
    own = {"n_lines", "base_failed", "kept", *COUNTS, *told}
    measured = cut(document_measures(docs, text, host, tuple(own)), "measures")
    hosts = cut(host_verdicts(measured, limits), "hosts")
    # A host may hold a third of all rows: such hosts are few, and their rows stay where they are.
    hot = F.col("n_docs") >= F.col("all_docs") * limits.hot_share
    known = F.broadcast(hosts.filter(hot).select("host", F.struct(*told).alias("of_host")))
    tagged = measured.join(known, F.col("of").eqNullSafe(F.col("host")), "left").drop("host")
    cold = tagged.filter(F.col("of_host").isNull()).drop("of_host").join(hosts.filter(~hot).select("host", F.struct(*told).alias("of_host")), F.col("of").eqNullSafe(F.col("host"))).drop("host")
    joined = tagged.filter(F.col("of_host").isNotNull()).unionByName(cold)
    base, strict = rule_failures(limits), rule_failures(limits, True)
    failed = base["short"] | base["repeats"]
    on_host = F.lit(False)
    for r in RULES:
        on_host = on_host | (F.col("of_host").getField(f"suspect_{r}") & strict[r])
    carried = [c for c in docs.columns if c != text and c not in own]
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in carried], *COUNTS, "n_lines", *[F.col("of_host").getField(c).alias(c) for c in told],
        failed.alias("base_failed"), (~failed & ~on_host).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    Rows meet their verdict by (doc_id, 64-bit text hash), so a doc_id with several texts keeps them apart.
    """
    key = F.xxhash64(F.col(f"`{text}`"))
    slim = docs.select(F.col("doc_id").alias("good_id"), F.col(f"`{host}`").alias("host_of"), key.alias("good_key"), F.col(f"`{text}`").alias("body"))
    good = quality_verdicts(slim, "host_of", "body", limits).filter("kept").select("good_id", "good_key", F.col("host_of").alias("good_host")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), key.alias("own_key"), F.col(f"`{host}`").alias("own_host"))
    same = F.col("own_id").eqNullSafe(F.col("good_id")) & (F.col("own_key") == F.col("good_key")) & F.col("own_host").eqNullSafe(F.col("good_host"))
    return whole.join(good, same, "left_semi").select("row.*")
