"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every step is a DataFrame operation. A document's votes are one of at most 3^8 patterns; the counts by pattern, and
nothing else, reach the driver, where the two-class model is fitted in plain arithmetic.

Defined cases: a NULL or blank text has no words and fails the base test; equal texts get equal results; an empty table
gives an empty result; other columns of the input are neither read nor returned; texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch, where_computed, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are as with be at this from by an not "
    "de la que el en los del las por con para una su al como más pero sus "
    "der die und den von das mit sich des auf für ist dem nicht ein eine als auch "
    "le et les des est un une du dans qui pour pas sur au par avec plus"
).split()

RULES = ("symbols", "capitals", "repeats", "duplicate_lines", "word_length", "function_words", "exclamations", "variety")


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", words(t))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "__capitals": F.regexp_count(t, F.lit("\\p{Lu}")).cast("long"),
        "__exclamations": F.regexp_count(t, F.lit("!")).cast("long"),
        "__distinct": F.size(F.array_distinct("__w")).cast("long"),
        "__function": F.size(F.array_intersect("__w", F.array(*map(F.lit, FUNCTION_WORDS)))),
        "__lines": lines,
        "__h": F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))),
    })
    # Only windows that lie wholly inside the text, and a sort only where some window comes twice.
    df = df.withColumn("__h", F.when(F.col("n_words") >= 3, F.slice("__h", 1, F.greatest(F.size("__h") - 2, F.lit(1)))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"),
                                     F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.transform("__s", lambda e, j: F.when((e.h == F.get("__s", j - 1).h) | (e.h == F.get("__s", j + 1).h), e.i))
    df = df.withColumn("__p", F.sort_array(F.array_compact(twice)))
    covered = F.aggregate("__p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(3), x - a.last)).alias("n")), lambda a: a.n)
    return df.withColumns({
        "__n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__w", "__h", "__s", "__p", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes() -> Column:
    """One character for each of RULES: - (junk), + (text) or 0 (abstains)."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, "-").when(good, "+").otherwise("0")

    return F.concat(
        rule(F.col("n_symbols") > 0.05 * chars, F.col("n_symbols") < 0.01 * chars),
        rule(F.col("__capitals") > 0.4 * chars, F.col("__capitals") < 0.15 * chars),
        rule(F.col("n_repeat_words") > 0.3 * n, F.col("n_repeat_words") < 0.15 * n),
        rule(F.col("n_dup_lines") > 0.3 * F.col("__n_lines"), F.col("n_dup_lines") <= 0.1 * F.col("__n_lines")),
        rule((chars < 2.5 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        rule(F.col("__function") == 0, F.col("__function") >= 3),
        rule(F.col("__exclamations") > 0.2 * n, F.lit(False)),
        rule((F.col("__distinct") < 0.1 * n) & (n < 2000), F.col("__distinct") > 0.25 * n),
    )


@dataclass
class VoteModel:
    """Two classes (text, junk): the prior of text and, by rule, the chance of each vote in either class."""

    prior: float
    chance: list[dict[str, tuple[float, float]]]

    def posterior(self, pattern: str) -> float:
        text, junk = math.log(self.prior), math.log(1 - self.prior)
        for v, c in zip(pattern, self.chance, strict=True):
            text, junk = text + math.log(c[v][0]), junk + math.log(c[v][1])
        return 1 / (1 + math.exp(min(700.0, junk - text)))

    def accuracy(self) -> dict[str, float]:
        """By rule: how often a vote that was cast agrees with the class."""
        out = {}
        for name, c in zip(RULES, self.chance, strict=True):
            right = self.prior * c["+"][0] + (1 - self.prior) * c["-"][1]
            wrong = self.prior * c["-"][0] + (1 - self.prior) * c["+"][1]
            out[name] = right / (right + wrong)
        return out


def fit_votes(counts: dict[str, int], rounds: int = 50) -> VoteModel:
    """Expectation-maximisation over vote patterns, started from "junk if any rule says so".

    Pseudo-votes say that rules are more often right than wrong; they fix which class is which and keep every
    chance above 0. With no documents the model is that prior alone.
    """
    patterns = sorted(counts)
    text = {p: 0.05 if "-" in p else 0.95 for p in patterns}
    model = VoteModel(0.5, [{"+": (0.6, 0.2), "-": (0.05, 0.4), "0": (0.35, 0.4)} for _ in RULES])
    for _ in range(rounds if patterns else 0):
        total = sum(counts.values())
        good = sum(counts[p] * text[p] for p in patterns)
        model.prior = (good + 9) / (total + 10)
        for k in range(len(RULES)):
            sums = {"+": [6.0, 2.0], "-": [0.5, 4.0], "0": [3.5, 4.0]}
            for p in patterns:
                sums[p[k]][0] += counts[p] * text[p]
                sums[p[k]][1] += counts[p] * (1 - text[p])
            a, b = (sum(s[c] for s in sums.values()) for c in (0, 1))
            model.chance[k] = {v: (s[0] / a, s[1] / b) for v, s in sums.items()}
        text = {p: model.posterior(p) for p in patterns}
    return model


def fit(features: DataFrame) -> VoteModel:
    """Fit on every document that passes the base test; at most 3^8 rows reach the driver."""
    rows = where_computed(features, ~base_failed()).groupBy(votes().alias("v")).count().collect()
    return fit_votes({r["v"]: r["count"] for r in rows})


def with_posterior(features: DataFrame, model: VoteModel, seen: DataFrame | None = None) -> DataFrame:
    """Add p_text, the posterior as one expression over the votes, and kept."""
    v = votes()
    weight = F.lit(math.log(model.prior) - math.log(1 - model.prior))
    for k, c in enumerate(model.chance):
        vote = F.substring("__v", k + 1, 1)
        odds = {x: math.log(c[x][0]) - math.log(c[x][1]) for x in "+-0"}
        weight = weight + F.when(vote == "+", odds["+"]).when(vote == "-", odds["-"]).otherwise(odds["0"])
    return (features.withColumn("__v", v).withColumn("p_text", 1 / (1 + F.exp(-weight)))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_text") >= 0.5)))


def quality_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_text for each row."""
    scratch = Scratch(docs.sparkSession)
    features = base_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text").drop("__text")
    features = scratch.save(features, "features")
    return with_posterior(features, fit(features)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_text")


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns. The text is read twice and never shuffled."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text"))
    features = base_columns(packed, "__text")
    model = fit(features.drop("__row"))
    return where_computed(with_posterior(features, model), F.col("kept")).select("__row.*")
