"""The calibrated search: texts are rewritten, round after round, until the share of changed tokens meets its target.

All open cases go through a round together.  A case carries its conversation with the rewriter, its best attempts so far
and nothing of the others'; a round asks the rewriter once for each, measures the reply, and writes all cases with their
new state to the shared folder.  Accepted ones are read from there at the end; the rest is the next round's input.  Cases
that have only overshot when the rounds are used up get a second phase, with a plain request for so many replacements.

A search that was cut off is continued from its last whole round if it is given the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import text, tokens
from evenkeel.functions.special import let
from evenkeel.scratch import Scratch, exists

#: One message of a conversation.
MESSAGE = "struct<role: string, content: string>"
_ATTEMPT = "struct<off: double, attempt: int, pct: double, paraphrase: string>"


def one_place(x: Column) -> Column:
    return F.format_string("%.1f", x)


@dataclass(frozen=True)
class Prompts:
    """What the rewriter is told, as functions of columns."""

    first: Callable[[Column, Column, Column, Column], Column] = lambda t, target, n, edits: F.concat(
        F.lit("Paraphrase the text below so that "), one_place(target), F.lit("% of its "), n.cast("string"), F.lit(" tokens change, about "), edits.cast("string"),
        F.lit(" insertions, deletions or substitutions.  Keep its meaning, all facts, numbers and technical terms.  Answer with the paraphrase alone.\n\n"), t,
    )
    again: Callable[[Column, Column, Column], Column] = lambda actual, target, over: F.concat(
        F.lit("That changed "), one_place(actual), F.lit("% of the tokens; the target is "), one_place(target), F.lit("%. "), F.when(over, "Make fewer changes.").otherwise("Make more changes.")
    )
    hint: Callable[[Column, Column], Column] = lambda best, target: F.concat(
        F.lit("\n\nAn earlier attempt changed "), one_place(best), F.lit("% of the tokens. Make "), F.when(best < target, "more").otherwise("fewer"), F.lit(" changes than it did.")
    )
    refused: str = "That was a refusal. Give the paraphrased text only."
    synonyms: Callable[[Column, Column], Column] = lambda t, edits: F.concat(F.lit("Replace about "), edits.cast("string"), F.lit(" words of the text below by synonyms, and change nothing else.  Answer with the text alone.\n\n"), t)


#: Adds a string column `reply` to a DataFrame with a column `messages`; null for a call that failed.
Rewriter = Callable[[DataFrame], DataFrame]


def said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def bare(reply: Column) -> Column:
    """A reply without white space around it, and without one pair of double quotes, then one of single ones."""
    out = tokens.trimmed(reply)
    for q in ('"', "'"):
        out = let(out, _without(q))
    return out


def _without(q: str) -> Callable[[Column], Column]:
    return lambda o: F.when(F.startswith(o, F.lit(q)) & F.endswith(o, F.lit(q)), F.substring(o, F.lit(2), F.length(o) - 2)).otherwise(o)


def _measured(asked: DataFrame, attempt: int, tolerance: float, tokenizer: str) -> DataFrame:
    """Adds what the reply is worth, and what is best so far."""
    df = asked.withColumn("reply", bare(F.col("reply")))
    # A failed call counts like a refusal, but leaves no trace in the conversation.
    df = df.withColumn("usable", F.col("reply").isNotNull() & ~F.coalesce(text.is_refusal(F.col("reply")), F.lit(False)))
    # Only what is compared is split into tokens; those of the original have been counted.
    split = lambda c: F.when(F.col("usable") & (F.col("n") > 0), tokens.tokenized(F.col(c), tokenizer))
    df = df.withColumn("distance", tokens.distance(split("text"), split("reply")))
    empty = F.when(F.size(tokens.tokenized(F.col("reply"), tokenizer)) == 0, 0.0).otherwise(100.0)
    df = df.withColumn("pct", F.when(F.col("usable"), F.when(F.col("n") == 0, empty).otherwise(F.col("distance") * 100.0 / F.when(F.col("n") != 0, F.col("n")))))
    df = df.withColumn("off", F.abs(F.col("pct") - F.col("target")))
    df = df.withColumn("made", F.when(F.col("usable"), F.struct("off", F.lit(attempt).alias("attempt"), "pct", F.col("reply").alias("paraphrase"))))
    return df.withColumns({
        "best": F.least("best", "made"), "under": F.least("under", F.when(F.col("pct") <= F.col("target"), F.col("made"))),
        "overshot": F.col("overshot") & F.coalesce(F.col("pct") > F.col("target") + tolerance, F.lit(True)), "accepted": F.coalesce(F.col("off") <= tolerance, F.lit(False)),
    })


def _conversed(df: DataFrame, prompts: Prompts, attempt: int, reset_every: int, tolerance: float) -> DataFrame:
    """What the next round's messages are made of."""
    if (attempt + 1) % reset_every == 0:
        hint = F.when(F.col("best").isNotNull(), prompts.hint(F.col("best.pct"), F.col("target"))).otherwise("")
        return df.withColumns({"hint": hint, "turns": _no_turns()})
    over = F.col("pct") > F.col("target") + tolerance
    answer = F.when(F.col("usable"), prompts.again(F.col("pct"), F.col("target"), over)).otherwise(prompts.refused)
    more = F.array(said("assistant", F.col("reply")), said("user", answer))
    return df.withColumn("turns", F.when(F.col("reply").isNull(), F.col("turns")).otherwise(F.concat("turns", more)))


def _no_turns() -> Column:
    return F.array().cast(f"array<{MESSAGE}>")


def calibrate(
    spark: SparkSession, cases: DataFrame, rewrite: Rewriter, keys: list[str], text_col: str = "text", target_col: str = "target", prompts: Prompts = Prompts(), tokenizer: str = "words",
    max_retries: int = 50, tolerance: float = 0.5, reset_every: int = 10, folder: str | None = None,
) -> DataFrame:
    """keys, paraphrase, actual_pct, deviation, retries_used, phase (1 or 2; 0 where nothing was accepted) and attempts.

    The first reply within the tolerance is taken.  Else, of all replies, the closest that does not overshoot, or the
    closest; without any usable reply the text itself, with no change.  A null text or target gives nulls.  The keys tell
    cases apart; repeated rows are cases of their own.  An empty table gives no rows.
    """
    scratch = Scratch(spark, "search", folder)
    measured = F.size(tokens.tokenized(F.col("text"), tokenizer))
    start = cases.select(*keys, F.col(text_col).alias("text"), F.col(target_col).cast("double").alias("target"))
    none = start.where("text IS NULL OR target IS NULL").select(*keys, F.lit(None).cast("string").alias("paraphrase"), *[F.lit(None).cast("double").alias(c) for c in ("actual_pct", "deviation")], F.lit(0).alias("retries_used"), F.lit(0).alias("phase"), F.lit(0).alias("attempts"))
    # Dealt anew: a table of one row group, or of a few long files, would be one or a few tasks in every round.
    start = start.where("text IS NOT NULL AND target IS NOT NULL").hint("rebalance").withColumn("n", measured).withColumn("edits", tokens.target_edits(F.col("target"), F.col("n")))
    open_ = start.withColumns({
        "best": F.lit(None).cast(_ATTEMPT), "under": F.lit(None).cast(_ATTEMPT), "overshot": F.lit(True), "attempts": F.lit(0), "hint": F.lit(""), "turns": _no_turns(),
    })
    state = open_.columns
    paths: list[DataFrame] = []
    first = F.concat(prompts.first(F.col("text"), F.col("target"), F.col("n"), F.col("edits")), F.col("hint"))
    messages = {1: F.concat(F.array(said("user", first)), F.col("turns")), 2: F.array(said("user", prompts.synonyms(F.col("text"), F.greatest(F.lit(1), F.col("edits")))))}
    # A text is written once for each use that the next rounds have for it: the prompt is made anew, an accepted case
    # keeps its paraphrase alone, and where the best attempt is also the best that does not overshoot, it stands for both.
    both = F.col("under.attempt") == F.col("best.attempt")
    bare_under = F.struct("under.off", "under.attempt", "under.pct", F.lit(None).cast("string").alias("paraphrase"))

    def rounds(pending: DataFrame, phase: int) -> DataFrame:
        for k in range(max_retries + 1):
            name, attempt = f"phase-{phase}-round-{k}", k if phase == 1 else max_retries + k + 1
            done = _measured(rewrite(pending.withColumn("messages", messages[phase])), attempt, tolerance, tokenizer).withColumn("attempts", F.col("attempts") + F.col("usable").cast("int"))
            done = _conversed(done, prompts, k, reset_every, tolerance) if phase == 1 and k < max_retries else done.withColumn("turns", _no_turns())
            done = done.withColumn("under", F.when(both, bare_under).otherwise(F.col("under")))
            carried = [F.when(~F.col("accepted"), F.col(c)).alias(c) for c in state if c not in (*keys, "attempts")]
            whole = scratch.keep_once(done.select(*keys, "attempts", *carried, "accepted", F.when(F.col("accepted"), F.col("made")).alias("made"), F.lit(phase).alias("phase")), name)
            paths.append(whole.where("accepted").select(*keys, "made", "phase", "attempts"))
            pending = whole.where(~F.col("accepted")).select(*state).withColumn("under", F.when(both, F.col("best")).otherwise(F.col("under")))
            if pending.isEmpty():
                break
        return pending

    left = rounds(open_, 1)
    second = left.where("overshot AND best IS NOT NULL")
    rest = left.where("NOT overshot OR best IS NULL")
    if not second.isEmpty():
        rest = rest.unionByName(rounds(second, 2))
    taken = paths[0]
    for p in paths[1:]:
        taken = taken.unionByName(p)
    taken = taken.select(*keys, "made.paraphrase", F.col("made.pct").alias("actual_pct"), F.col("made.off").alias("deviation"), F.col("made.attempt").alias("retries_used"), "phase", "attempts")
    kept = F.coalesce("under", "best", F.struct(F.col("target").alias("off"), F.lit(max_retries).alias("attempt"), F.lit(0.0).alias("pct"), F.col("text").alias("paraphrase")))
    rest = rest.withColumn("kept", kept).select(*keys, "kept.paraphrase", F.col("kept.pct").alias("actual_pct"), F.col("kept.off").alias("deviation"), F.lit(max_retries).alias("retries_used"), F.lit(0).alias("phase"), "attempts")
    return taken.unionByName(rest).unionByName(none)
