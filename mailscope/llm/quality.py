"""Quality rules as weak supervision: rules vote or abstain, and a fitted model weighs the votes.

Each rule looks at one figure of a text and votes good or bad where the figure is clear, else it abstains. Nobody
says how far a rule can be trusted: expectation-maximisation estimates, for each rule, how often it votes good on
good texts and bad on bad ones, from how the rules agree. The posterior probability of quality takes the place of
"all rules must pass": a bad vote of a rule that is found to accuse good texts is outweighed, one of a rule that does not
decides. All work on texts is Spark expressions. The model is fitted on counts of vote patterns, at most 3 ** rules rows
however large the corpus is; a step of the fit is one aggregation over them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.llm.scan import bound
from mailscope.llm.scratch import materialise
from mailscope.llm.words import SPACE, WORD

SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more, from the windows' hashes and places, sorted."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (
                F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            ))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bound(bound(placed, places), total)
        )

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(bound(windows, covered))


def measures(text: Column) -> Column:
    """A struct of LONG figures of a text; null is measured like an empty text.

    `n_words`, `word_chars`, `n_symbols`, `n_lines` and `n_dup_lines` (lines with a word; equal to an earlier one),
    `n_repeat_words` (windows are compared by a 64-bit hash), `n_distinct`, `n_upper` (upper-case letters),
    `n_ends` (words at the end of a sentence), `n_bare` (words without a letter), `n_marked` (pairs of signs in a row).
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    from_words = bound(words, lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
        F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w).alias("repeat"),
    ))
    from_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    parts = {
        "n_symbols": count(SYMBOL),
        "n_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "n_ends": count(rf"[.!?](?={SPACE}|$)"),
        "n_bare": count(rf"(?<![^\x20\x09-\x0D])[^\p{{L}}\x20\x09-\x0D]+(?={SPACE}|$)"),
        "n_marked": count(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]{2}"),
    }
    return bound(F.struct(from_words.alias("w"), from_lines.alias("l")), lambda m: F.struct(
        m["w"]["n"].cast("long").alias("n_words"), m["w"]["chars"].cast("long").alias("word_chars"),
        m["w"]["distinct"].cast("long").alias("n_distinct"), m["w"]["repeat"].cast("long").alias("n_repeat_words"),
        m["l"]["n"].cast("long").alias("n_lines"), m["l"]["dup"].cast("long").alias("n_dup_lines"),
        *[c.cast("long").alias(name) for name, c in parts.items()],
    ))


@dataclass(frozen=True)
class Rule:
    """Votes good where `figure` / `per` is at most `good`, bad where it is above `bad`, and abstains between; also
    where there is nothing to divide by. With `good` above `bad` the other way round: high is good."""

    name: str
    figure: str
    per: str
    good: float
    bad: float

    def vote(self, of: Callable[[str], Column]) -> Column:
        share = of(self.figure) / F.nullif(of(self.per), F.lit(0))
        if self.good <= self.bad:
            return F.when(share <= self.good, 1).when(share > self.bad, 0)
        return F.when(share >= self.good, 1).when(share < self.bad, 0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.2, 0.4),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.2, 0.4),
    Rule("variety", "n_distinct", "n_words", 0.4, 0.15),
    Rule("upper_case", "n_upper", "word_chars", 0.15, 0.4),
    Rule("sentence_ends", "n_ends", "n_words", 0.25, 0.5),
    Rule("words_without_letters", "n_bare", "n_words", 0.1, 0.25),
    Rule("sign_runs", "n_marked", "n_words", 0.1, 0.3),
    # Signs of lists and of lost line breaks, but good texts have them too.
    Rule("short_lines", "n_words", "n_lines", 12, 5),
    Rule("long_lines", "n_words", "n_lines", 60, 120),
)


@dataclass(frozen=True)
class VoteModel:
    """`prior`: share of good texts. `good[r]`: how often rule r, where it votes, votes good on good texts;
    `bad[r]`: how often it votes bad on bad ones."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: Sequence[Column]) -> Column:
        """The weights are literals of an array, which generated code takes by reference: with numbers in the code, every step
        of a fit would be compiled anew, and the driver keeps what it has compiled."""
        weights = [
            F.struct(F.lit(math.log(g / (1 - b))).alias("good"), F.lit(math.log((1 - g) / b)).alias("bad"))
            for _, g, b in zip(votes, self.good, self.bad, strict=True)
        ]
        said = F.zip_with(F.array(*votes), F.array(*weights), lambda vote, w: (
            F.when(vote == 1, w["good"]).when(vote == 0, w["bad"]).otherwise(F.lit(0.0))
        ))
        odds = F.aggregate(said, F.lit(math.log(self.prior / (1 - self.prior))), lambda total, x: total + x)
        return 1 / (1 + F.exp(-odds))


#: Bounds of a rule's share of bad votes as the fit starts from it.
RAREST, MOST = 1e-6, 0.5


def _start(shares: Sequence[float]) -> VoteModel:
    """Where the fit starts, from each rule's share of bad votes: the rarer a rule's accusations, the more they are
    taken to be true and the more bad texts it is taken to miss, since it sees only its own fault."""
    shares = [min(max(s, RAREST), MOST) for s in shares]
    good, bad = (tuple(f(s) for s in shares) for f in (lambda s: 1 - s * s / 4, lambda s: max(math.sqrt(s), 0.05)))
    return VoteModel(1 - sum(shares) / max(1, len(shares)), good, bad)


def fit(patterns: DataFrame, names: Sequence[str], steps: int = 60, settled: float = 1e-5) -> VoteModel:
    """Expectation-maximisation over `patterns`: a vote column per name and `n`, how many texts vote so.

    Both accuracies of every rule are free; each step adds one text's worth of the starting values to every count, so that
    an estimate is never 0 or 1. A bad vote never speaks for quality. With no rows the starting values are the result.
    """
    n = F.col("n").cast("double")
    shares = [F.try_divide(F.sum(F.when(F.col(c) == 0, n)), F.sum(F.when(F.col(c).isNotNull(), n))) for c in names]
    votes = patterns.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"s{r}") for r, s in enumerate(shares)]).first()
    model = start = _start(votes)
    for _ in range(steps):
        scored, good = patterns.withColumn("_good", model.posterior([F.col(c) for c in names])), F.col("_good")
        sums = [F.sum(n).alias("all"), F.sum(n * good).alias("good")]
        for r, name in enumerate(names):
            for vote in (0, 1):
                cast = F.when(F.col(name) == vote, n).otherwise(0.0)
                sums += [F.sum(cast * good).alias(f"g{r}{vote}"), F.sum(cast * (1 - good)).alias(f"b{r}{vote}")]
        found = scored.agg(*sums).first()
        if not found["all"]:
            return model
        new_good, new_bad = [], []
        for r in range(len(names)):
            g = (found[f"g{r}1"] + start.good[r]) / (found[f"g{r}0"] + found[f"g{r}1"] + 1)
            b = (found[f"b{r}0"] + start.bad[r]) / (found[f"b{r}0"] + found[f"b{r}1"] + 1)
            new_good.append(g)
            new_bad.append(max(b, 1 - g + 1e-6))
        after = VoteModel((found["good"] + start.prior) / (found["all"] + 1), tuple(new_good), tuple(new_bad))
        change = max(abs(x - y) for x, y in zip((after.prior, *after.good, *after.bad), (model.prior, *model.good, *model.bad)))
        model = after
        if change < settled:
            break
    return model


def _judged(documents: DataFrame, carry: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """`carry` as it is, and the struct `_q`: the measures, `base_failed`, `quality` and `kept`."""
    measured = materialise(documents.select(*carry, measures(F.col("text")).alias("_q")), "quality-measures")
    names = [f"_vote_{rule.name}" for rule in rules]
    votes = [rule.vote(lambda c: F.col("_q")[c]) for rule in rules]
    patterns = materialise(
        measured.filter(F.col("_q.n_words") > 0).groupBy(*[v.alias(name) for v, name in zip(votes, names)]).agg(F.count("*").alias("n")),
        "quality-votes",
    )
    model = fit(patterns, names)
    words, repeat = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
    quality = model.posterior(votes)
    return measured.withColumn("_q", F.struct(
        F.col("_q.*"), failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= 0.5)).alias("kept")
    ))


def verdicts(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: `doc_id`, the measures, `base_failed`, `quality` (posterior) and `kept`.

    Null and empty texts measure 0 everywhere and fail the base. Repeated rows each get a row and each count in the
    fit. Other columns are ignored. No rows in, no rows out.
    """
    return _judged(documents, ["doc_id"], rules).select(
        "doc_id", *[F.col(f"_q.{c}").alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
        )]
    )


def keep_quality(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that are kept, all columns as they were."""
    rows = documents.select("text", F.struct(*documents.columns).alias("it"))
    return _judged(rows, ["it"], rules).filter(F.col("_q.kept")).select("it.*")
