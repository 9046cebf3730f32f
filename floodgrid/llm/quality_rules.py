"""Weak supervision of text quality, in DataFrame functions only.

Rules look at counts of each text and vote good, vote bad or abstain. Expectation-maximisation over
the histogram of vote patterns (at most 3^rules rows, whatever the table's size) estimates how often
each rule is right on good and on bad texts and the share of good texts. Every text then has a
posterior probability of good quality, which decides instead of "all rules must pass". The whole
estimation is one fold over an array of patterns, so it runs inside Spark.

Cases: null and empty texts have no words and fail the base test; a text whose rules all abstain has
the share of good texts as its probability; ties at 0.5 are kept; repeated rows vote like others; an
empty table gives an empty result; extra columns are kept in ``row``.

Repeated 3-word windows are told by 64-bit hashes within one text: two different windows of one text
collide with a probability of about 1e-12 for 5,000 words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgrid.runtime import write_and_read as materialize

_SPACE = "\\x20\\x09-\\x0D"
ROUNDS = 40
_PSEUDO = 1.0
KEEP_FROM = 0.5
# Places, in words of 64, that the texts of rejected rows are marked in by ``kept_rows``.
PLACE_WORDS = 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the text."""
    n = F.size(words)

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["at"]))
        # Each window adds the words that the window before it has not covered.
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            zero,
            lambda a, at: F.struct(at.alias("last"), (a["n"] + F.least(F.lit(3), at - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def counted(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ordered, covered))

    hashes = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(n < 4, 0).otherwise(_let(hashes, counted)).cast("long")


def with_counts(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) and the counts that rules use."""
    columns = documents.columns if keep is None else keep
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), body.alias("t"))
    base = base.withColumn("words", F.array_remove(F.split("t", f"[{_SPACE}]+"), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    base = base.withColumn("lines", lines)

    def count(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern)).cast("long")

    return base.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        count("[#*$%&|<>!?]{2,}").alias("n_mark_runs"),
        count("[|]").alias("n_bars"),
        count("\\p{Lu}{2,}").alias("n_caps"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


# Each rule: when it votes good, when it votes bad; it abstains otherwise. The second of two
# conditions that hold together wins.
RULES: dict[str, tuple[str, str]] = {
    "few symbols": ("100 * n_symbols <= word_chars", "100 * n_symbols > 5 * word_chars"),
    "few mark runs": ("100 * n_mark_runs <= n_words", "100 * n_mark_runs > 10 * n_words"),
    "few bars": ("100 * n_bars <= n_words", "100 * n_bars > 10 * n_words"),
    "few capitals": ("100 * n_caps <= 10 * n_words", "100 * n_caps > 30 * n_words"),
    "few repeated windows": ("100 * n_repeat_words <= 15 * n_words", "100 * n_repeat_words > 40 * n_words"),
    "few repeated lines": ("n_lines > 1 AND n_dup_lines = 0", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    "many different words": (
        "n_words <= 2000 AND 100 * n_distinct >= 40 * n_words",
        "n_words BETWEEN 20 AND 2000 AND 100 * n_distinct < 20 * n_words",
    ),
}


def votes(rules: dict[str, tuple[str, str]] = RULES) -> Column:
    return F.array(*[_vote(good, bad) for good, bad in rules.values()])


def _log_odds(theta: Column, vote: Callable[[int], Column], k: int) -> Column:
    """Log odds of good. ``theta``: share of good, then P(good vote | good text) by rule, then P(bad vote | bad text)."""
    share = F.get(theta, F.lit(0))
    terms = [F.log(share / (1 - share))]
    for r in range(k):
        a, b = F.get(theta, F.lit(1 + r)), F.get(theta, F.lit(1 + k + r))
        terms.append(F.when(vote(r) == 1, F.log(a / (1 - b))).when(vote(r) == -1, F.log((1 - a) / b)).otherwise(0.0))
    return reduce(lambda x, y: x + y, terms)


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def estimate(counts: DataFrame, rules: dict[str, tuple[str, str]] = RULES, rounds: int = ROUNDS) -> list[float] | None:
    """The parameters after ``rounds`` of expectation-maximisation; None for an empty table."""
    k = len(rules)
    patterns = counts.groupBy(votes(rules).alias("v")).agg(F.count("*").alias("n"))
    # At most 3^rules rows meet here.
    table = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns"))

    def contribution(theta: Column) -> Callable[[Column], Column]:
        def of(p: Column) -> Column:
            q = _probability(_log_odds(theta, lambda r: F.get(p["v"], F.lit(r)), k))

            def sums(good: Column) -> Column:
                cells = [good, p["n"].cast("double")]
                for r in range(k):
                    v, bad = F.get(p["v"], F.lit(r)), p["n"] - good
                    voted = (v != 0).cast("double")
                    cells += [good * (v == 1).cast("double"), good * voted, bad * (v == -1).cast("double"), bad * voted]
                return F.array(*cells)

            return _let(p["n"] * q, sums)

        return of

    def step(theta: Column, _: Column) -> Column:
        zero = F.array(*[F.lit(0.0)] * (2 + 4 * k)).cast("array<double>")
        total = F.aggregate(
            F.transform("patterns", contribution(theta)), zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)
        )

        def renewed(s: Column) -> Column:
            def at(i: int) -> Column:
                return F.get(s, F.lit(i))

            cells = [(at(0) + _PSEUDO) / (at(1) + 2 * _PSEUDO)]
            cells += [(at(2 + 4 * r) + _PSEUDO) / (at(3 + 4 * r) + 2 * _PSEUDO) for r in range(k)]
            cells += [(at(4 + 4 * r) + _PSEUDO) / (at(5 + 4 * r) + 2 * _PSEUDO) for r in range(k)]
            return F.array(*cells)

        return _let(total, renewed).cast("array<double>")

    # Start: most texts are good, a bad vote is rarely wrong, one rule sees few of the bad texts.
    start = F.array(F.lit(0.8), *[F.lit(0.999)] * k, *[F.lit(0.3)] * k).cast("array<double>")
    fitted = table.where(F.size("patterns") > 0).select(
        F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("theta")
    )
    row = fitted.first()
    return None if row is None else list(row.theta)


def judge(documents: DataFrame, text: str = "text", keep: list[str] | None = None, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """``row``, the counts, ``base_failed``, ``probability`` of good quality and ``kept``.

    The counts are written once with what is kept: a filter on the verdict would else be pushed below
    them and have the costly ones computed once for every use.
    """
    counts = materialize(with_counts(documents, text, keep))
    return _with_verdict(counts, estimate(counts, rules), rules)


def _with_verdict(counts: DataFrame, theta: list[float] | None, rules: dict[str, tuple[str, str]]) -> DataFrame:
    literal = F.array(*[F.lit(x) for x in theta or [0.5] * (1 + 2 * len(rules))])
    odds = _log_odds(literal, lambda r: F.get(F.col("v"), F.lit(r)), len(rules))
    judged = counts.withColumn("v", votes(rules)).withColumn("probability", _probability(odds))
    return judged.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_FROM)
    )


def kept_rows(documents: DataFrame, text: str = "text", rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """The documents that ``judge`` keeps, with all columns, without a written copy of their texts.

    The counts are written without the rows. Places of rejected texts are marked in ``64 * PLACE_WORDS`` bits; a
    row whose place is unmarked is kept, all others are counted and judged again, so the marks steer work only.
    """
    place = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(64 * PLACE_WORDS))
    word = F.shiftright("place", 6).alias("word")
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    texts = documents.select(F.col(f"`{text}`").alias("text"), place.alias("place"))
    counts = materialize(with_counts(texts, "text", ["place"]))
    theta = estimate(counts, rules)
    rejected = _with_verdict(counts, theta, rules).where(~F.col("kept")).select("row.place")
    marks = rejected.groupBy(word).agg(F.bit_or(bit).alias("marks"))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), place.alias("place"))
    # At most PLACE_WORDS rows.
    marked = packed.withColumn("word", word).join(F.broadcast(marks), "word", "left")
    open_ = F.coalesce(F.col("marks").bitwiseAND(bit) != 0, F.lit(False))
    again = marked.where(open_).select("row", F.col(f"row.`{text}`").alias("text"))
    judged = _with_verdict(with_counts(again, "text", ["row"]), theta, rules)
    # A generator, below which the verdict's filter is not pushed: the counts are computed once.
    passed = judged.select(F.inline(F.when(F.col("kept"), F.array("row.row"))))
    return marked.where(~open_).select("row.*").unionByName(passed)
