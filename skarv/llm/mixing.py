"""Mixing sources to target weights, with capped repeats and reported shares.

Temperature mixing: token shares are raised to an exponent that bisection
finds, so that the weights meet a target entropy or a repetition limit; the
weights become token budgets, realised as block permutations of each source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.llm.tokens import VOCABULARY, token_count
from skarv.session import cut

STEPS = 80


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """``share ** exponent``, normalised; sources without tokens get nothing."""
    logs = {s: exponent * math.log(p) for s, p in shares.items() if p > 0}
    top = max(logs.values(), default=0.0)
    raised = {s: math.exp(x - top) for s, x in logs.items()}
    total = sum(raised.values())
    return {s: raised.get(s, 0.0) / total if total else 0.0 for s in shares}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(shares: dict[str, float], wanted: float | None = None, fits=None, highest: float = 64.0) -> float:
    """The exponent whose weights have the entropy ``wanted``, or the least that ``fits``.

    The entropy falls as the exponent grows. An entropy out of reach gives the
    nearer end, and so does a limit that no exponent satisfies.
    """
    low, high = 0.0, highest
    if fits is not None and fits(tempered(shares, low)):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        weights = tempered(shares, middle)
        up = not fits(weights) if fits is not None else entropy(weights) > wanted
        low, high = (middle, high) if up else (low, middle)
    return high


@dataclass(frozen=True)
class Budget:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    budget: float
    reachable: bool


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> list[Budget]:
    """A token budget for each listed source, for a mixture as large as all their documents.

    A source gets its target share where its repeats allow. What the others
    can't give goes to those with room, by token shares raised to the exponent
    that gives them the entropy of their targets; if that breaks a repetition
    limit, to the least exponent that keeps all within theirs; and if none
    does, the fullest is filled up and the rest is spread again. Runs on the
    driver over the listed sources only.
    """
    total = sum(tokens.get(s, 0) for s in targets)
    most = {s: tokens.get(s, 0) * max(0, repeats or 0) for s, (_, repeats) in targets.items()}
    want = {s: (share or 0.0) * total for s, (share, _) in targets.items()}
    got = {s: float(min(want[s], most[s])) for s in targets}
    rest = total - sum(got.values())
    room = {s: most[s] - got[s] for s in targets if most[s] > got[s] and tokens.get(s, 0) > 0}
    while rest > 1e-9 * max(1, total) and room:
        shares = {s: tokens[s] / total for s in room}
        fits = lambda w: all(rest * w[s] <= room[s] * (1 + 1e-12) for s in room)  # noqa: B023, E731
        wanted = sum(want[s] for s in room)
        weights = tempered(shares, bisect_exponent(shares, wanted=entropy({s: want[s] / wanted for s in room}) if wanted else 0.0))
        if not fits(weights):
            weights = tempered(shares, bisect_exponent(shares, fits=fits))
        if fits(weights):
            got = {s: x + rest * weights.get(s, 0.0) for s, x in got.items()}
            break
        full = max(room, key=lambda s: (rest * weights[s] / room[s], s))
        got[full] += min(room[full], rest)
        rest -= min(room[full], rest)
        del room[full]
    return [Budget(s, float(share or 0.0), int(repeats or 0), int(tokens.get(s, 0)), got[s], got[s] >= want[s]) for s, (share, repeats) in sorted(targets.items())]


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The wanted mixture; of a source listed twice the shares add up and the higher limit holds."""
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    return {r.source: (r.share or 0.0, r.repeats or 0) for r in rows.collect()}


def counted(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, _tokens`` of the listed sources' documents; a null text has no tokens."""
    listed = targets.select("source").where("source is not null").distinct()
    return documents.join(listed, "source", "left_semi").select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("_tokens"))


def _planned(known: DataFrame, targets: DataFrame) -> list[Budget]:
    """The plan for counted documents; what reaches the driver is one number for each source that ``targets`` lists."""
    sums = known.groupBy("source").agg(F.sum("_tokens").alias("tokens"))
    return plan({r.source: r.tokens for r in sums.collect()}, _targets(targets))


def budgets(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> list[Budget]:
    """The plan for a mixture of ``documents``."""
    return _planned(counted(documents, targets, vocabulary), targets)


SCHEMA = "source string, target_share double, max_repeats long, tokens long, budget double, reachable boolean"


def budget_table(spark: SparkSession, rows: list[Budget]) -> DataFrame:
    return spark.createDataFrame([tuple(vars(b).values()) for b in rows], SCHEMA)


def unreachable(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The sources whose budget in the mixture falls short of their share, even at ``max_repeats`` uses of every document."""
    return budget_table(documents.sparkSession, budgets(documents, targets, vocabulary)).where("not reachable").select("source")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 17, blocks: int = 4096) -> DataFrame:
    """``doc_id, source, tokens, uses``: how often the mixture uses each document.

    Each source's documents stand in the order of a seeded hash, cut into
    ``blocks``. Whole passes use every document; the last pass uses whole
    blocks up to the budget and, in the one block in which it ends, the
    documents whose middle lies within. Running sums thus go over at most
    ``blocks`` rows a source and over the one block, never over a source: one
    source may hold any share of the rows.

    Sources not listed, and documents without source or tokens, aren't used. Repeated
    rows count as further documents. Documents never used are left out.
    """
    return _mixed(cut(counted(documents, targets, vocabulary).where("_tokens > 0")), targets, seed, blocks)


def _mixed(known: DataFrame, targets: DataFrame, seed: int = 17, blocks: int = 4096) -> DataFrame:
    """``mix`` of counted documents."""
    spark = known.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = known.withColumn("_order", order).withColumn("_block", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(blocks)))
    wanted = budget_table(spark, _planned(known, targets)).where("tokens > 0").select(
        "source", F.floor(F.col("budget") / F.col("tokens")).alias("_passes"), (F.col("budget") - F.floor(F.col("budget") / F.col("tokens")) * F.col("tokens")).alias("_left"), F.col("max_repeats").alias("_most")
    )
    ahead = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sized = known.groupBy("source", "_block").agg(F.sum("_tokens").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    # Broadcast: at most ``blocks`` rows for each source that the targets list.
    placed = known.join(F.broadcast(sized.join(F.broadcast(wanted), "source")), ["source", "_block"])
    inside = F.col("_before") + F.col("_size") <= F.col("_left")
    ends = (F.col("_before") < F.col("_left")) & ~inside
    within = Window.partitionBy("source", "_block").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where(ends).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_tokens").over(within), F.lit(0)))
    last = last.withColumn("_more", (F.col("_at") + F.col("_tokens") / 2 <= F.col("_left")).cast("long")).drop("_at")
    other = placed.where(~ends).withColumn("_more", inside.cast("long"))
    used = other.unionByName(last).withColumn("uses", F.least(F.col("_passes") + F.col("_more"), F.col("_most")))
    return used.where("uses > 0").select("doc_id", "source", F.col("_tokens").alias("tokens"), "uses")


def report(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """``source, target_share, actual_share, mixture_tokens, documents_used, most_uses, reachable`` of the mixture, one row a listed source."""
    known = cut(counted(documents, targets, vocabulary).where("_tokens > 0"))
    planned = budget_table(documents.sparkSession, _planned(known, targets)).select("source", "reachable")
    mixture = cut(_mixed(known, targets, **options))
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixture_tokens"), F.count("*").alias("documents_used"), F.max("uses").alias("most_uses"))
    listed = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share")).join(F.broadcast(planned), "source")
    total = got.agg(F.sum("mixture_tokens").alias("_total"))
    rows = listed.join(got, "source", "left").join(F.broadcast(total), how="left").na.fill(0, ["mixture_tokens", "documents_used", "most_uses"])
    return rows.select("source", "target_share", F.coalesce(F.col("mixture_tokens") / F.col("_total"), F.lit(0.0)).alias("actual_share"), "mixture_tokens", "documents_used", "most_uses", "reachable")
