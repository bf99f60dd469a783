"""Mixing sources to target weights by iterative proportional fitting, in SQL functions only.

Tokens are summed by source, language and topic. The cells are raked: their weights are scaled to the
target share of every source, then of every language, then of every topic, round after round, until all
three margins hold within ``TOLERANCE``. Given targets that cannot hold together are an error. A document is then kept with its cell's calibrated probability, decided by a hash of
its id, so a rerun keeps the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: Rounds over the three margins at least, and those planned together; the margins are measured after that.
ROUNDS = 12
TOGETHER = 4
#: How far a share may be from its target, and after how many rounds targets count as out of reach.
TOLERANCE = 1e-6
MAX_ROUNDS = 400
#: Without given targets a value's share is its share of tokens to this power, so large ones shrink.
TEMPERATURE = 0.5
#: The part of all tokens that the sample should hold.
BUDGET = 0.5

WORDS = r"[^\x20\x09-\x0D]+"

# What a text looks like, by the first pattern that it holds.
TOPICS = (
    ("listing", r"\|[^|]+\|[^|]+\|"),
    ("symbols", r"[*#$%&]{3}"),
    ("shouting", r"[A-Z]{2,}!!"),
    ("legal", r"(?i:licen[cs]e|copyright)"),
    ("figures", r"[0-9]{6}"),
)
OTHER_TOPIC = "prose"


def topic_of(text: str = "text") -> Column:
    """The kind of a text; a null is of the general kind."""
    known = F.coalesce(F.col(text), F.lit(""))
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        out = F.when(known.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def _targets(cells: DataFrame, margin: str, given: DataFrame | None, temperature: float) -> DataFrame:
    """``margin`` and its target share, which sum to one over the values that have tokens."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    if given is None:
        wanted = sums.withColumn("share", F.pow("tokens", F.lit(temperature)))
    else:
        share = given.select(F.col(given.columns[0]).alias("value"), F.col(given.columns[1]).cast("double").alias("share"))
        wanted = sums.join(share, sums[margin].eqNullSafe(share["value"])).where("share > 0")
    whole = wanted.agg(F.sum("share")).scalar()
    return wanted.select(F.col(margin).alias("value"), (F.col("share") / whole).alias(f"target_{margin}"))


def margin_error(cells: DataFrame, margins: tuple[str, ...]) -> tuple[float, str | None, str | None]:
    """The largest distance of a share from its target, with its margin and value.

    ``cells`` has ``margins``, ``weight`` and a ``target_`` column for each margin; weights count as they are, so they
    should sum to one. A value without cells of positive weight has share 0.
    """
    worst = (0.0, None, None)
    for margin in margins:
        sums = cells.where(f"target_{margin} is not null").groupBy(margin).agg(F.sum("weight").alias("share"), F.first(f"target_{margin}").alias("target"))
        off = F.abs(F.col("share") - F.col("target"))
        row = sums.agg(F.max(F.struct(off.alias("off"), F.col(margin).cast("string").alias("value"))).alias("m")).first()["m"]
        if row is not None and row["off"] > worst[0]:
            worst = (row["off"], margin, row["value"])
    return worst


def raked(
    cells: DataFrame,
    margins: tuple[str, ...],
    targets: Mapping[str, DataFrame] | None = None,
    temperature: float = TEMPERATURE,
    rounds: int | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``cells`` (``margins`` and ``tokens``) with ``weight``, whose margins are the target shares.

    ``targets`` gives a frame of value and share for some margins; values that it leaves out get weight 0. The
    others follow ``temperature``. Fitting ends after ``ROUNDS`` rounds or more, when every share is within
    ``tolerance`` of its target; with ``rounds`` given it does just these, unmeasured. Targets that cannot
    hold together never get there: a ``ValueError`` names the margin and value that are farthest off, if any
    targets were given. Without given ones the fit ends as soon as the distance shrinks too slowly to get there
    in ``MAX_ROUNDS``, and the last margin holds. A window holds the cells of one value; there are at most as many
    cells as the margins have combinations.
    """
    for margin in margins:
        wanted = _targets(cells, margin, (targets or {}).get(margin), temperature)
        cells = cells.join(wanted, cells[margin].eqNullSafe(wanted["value"]), "left").drop("value")
    weight = F.when(F.greatest(*[F.col(f"target_{m}") for m in margins]).isNotNull(), F.col("tokens").cast("double")).otherwise(F.lit(0.0))
    for margin in margins:
        weight = F.when(F.col(f"target_{margin}").isNull(), F.lit(0.0)).otherwise(weight)
    cells = written(cells.withColumn("weight", weight), "cells")
    done, before = 0, float("inf")
    while True:
        todo = TOGETHER if rounds is None else min(TOGETHER, rounds - done)
        for _ in range(todo):
            for margin in margins:
                now = F.sum("weight").over(Window.partitionBy(margin))
                cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"target_{margin}") / now).otherwise(F.lit(0.0)))
        done += todo
        cells = written(cells, "cells")
        if rounds is not None:
            if done >= rounds:
                break
            continue
        if done < ROUNDS:
            continue
        off, margin, value = margin_error(cells, margins)
        if off <= tolerance:
            break
        stuck = off > 0.99 * before  # an error that still shrinks loses more than that in these rounds
        if not targets and 0 < off < before < float("inf"):  # own targets are worth no long wait
            stuck = done + TOGETHER * math.log(tolerance / off) / math.log(off / before) > MAX_ROUNDS
        if stuck or done >= MAX_ROUNDS:
            if targets:
                raise ValueError(f"targets cannot hold together: after {done} rounds the share of {margin} = {value!r} is {off:.3g} off")
            break
        before = off
    return cells.drop(*[f"target_{m}" for m in margins])


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells`` (``tokens, weight``) with ``probability``: weights scaled until the sample holds ``budget`` of all tokens.

    No document is kept twice, so a probability ends at 1 and the cells below share what is then
    missing. The scale is found by sums over all cells: cells that a scale fills leave the rest a larger
    one, until no more are filled. If all cells are filled, every probability with weight is 1.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    cells = cells.withColumn("ratio", ratio)
    whole = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    scale, full = 0.0, -1
    while True:
        filled = (F.col("ratio") * F.lit(scale) >= 1) if scale else F.lit(False)
        row = cells.where("ratio > 0").agg(
            F.count_if(filled).alias("full"),
            F.sum(F.when(filled, F.col("tokens"))).alias("held"),
            F.sum(F.when(~filled, F.col("weight"))).alias("rest"),
        ).first()
        if not row["rest"]:
            probability = F.when(F.col("ratio") > 0, 1.0).otherwise(0.0)
            break
        if row["full"] <= full:
            probability = F.least(F.lit(1.0), F.lit(scale) * F.col("ratio"))
            break
        full, scale = row["full"], max(scale, (whole * budget - (row["held"] or 0)) / row["rest"])
    return cells.withColumn("probability", F.greatest(F.lit(0.0), probability)).drop("ratio")


def chance(doc_id: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id alone: 52 bits of its checksum."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, seed: int = 3, rounds: int | None = None
) -> DataFrame:
    """``docs`` with ``topic, n_tokens, probability, kept``.

    ``docs`` has ``doc_id, text, source, lang``. Nulls in ``source`` or ``lang`` are a value of their own. Null and empty
    texts have no tokens; a cell without any tokens gets probability 0. Rows that repeat an id are kept
    or left together, if they are in the same cell. Columns called like a new one are replaced. Given
    targets that cannot hold together raise a ``ValueError``.
    """
    margins = ("source", "lang", "topic")
    docs = docs.drop("topic", "n_tokens", "probability", "kept").withColumn("topic", topic_of()).withColumn("n_tokens", token_count())
    cells = docs.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens"))
    fitted = calibrated(raked(written(cells, "cells"), margins, targets, temperature, rounds), budget)
    keys = [F.col(m).alias(f"__{m}") for m in margins]
    side = broadcast_if_small(written(fitted.select(*keys, "probability"), "cells"))
    same = F.lit(True)
    for m in margins:
        same = same & docs[m].eqNullSafe(side[f"__{m}"])
    joined = docs.join(side, same, "left").drop(*[f"__{m}" for m in margins])
    return joined.withColumn("kept", chance("doc_id", seed) < F.col("probability"))
