"""Mixing sources to target weights, by Pareto order sampling.

Every document of a source first gets the whole copies its source's rate makes certain.
What is left is one more copy for some: each has an inclusion probability, somewhat higher
for shorter documents. Documents are sampled within classes of nearly equal size: a class's
sample size is fixed beforehand, and its documents enter in order of random odds divided by
inclusion odds. Sizes are drawn from the largest class to the smallest, each rounded at random
so that its mean is exact, with the tokens still due spread over the classes to come as far as
their rates can move both ways. So inclusion probabilities hold, and where a source has many
documents the total differs from what was wanted by little more than a short document; what
is left over is reported.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.tokens import TOKENIZER, token_counts
from cueloom.session import written

BUCKETS = 1024
SHORT_BIAS = 0.25
EXACT_SIZES = 64  # documents of fewer tokens form a class for each number
STEPS = 16  # classes for each doubling of the size above
_EDGE = 1e-6


def _uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) that depends on the row's key and the seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def size_class(tokens: Column) -> Column:
    """The class of a size: at most some 560 for any size that an INT holds."""
    return F.when(tokens < EXACT_SIZES, tokens).otherwise(EXACT_SIZES + F.floor(F.log2(tokens / F.lit(float(EXACT_SIZES))) * STEPS)).cast("int")


def plan(sources: list[dict]) -> list[dict]:
    """Whole copies and remaining tokens per source, for the largest mixture all can supply.

    ``sources``: source, target_share, max_repeats and tokens (at most a few rows). Sources without
    tokens or share get nothing; the shares of the others keep their ratio.
    """
    usable = [s for s in sources if s["tokens"] and s["target_share"] and s["max_repeats"]]
    total = min((s["tokens"] * s["max_repeats"] / s["target_share"] for s in usable), default=0.0)
    out = []
    for s in usable:
        wanted = min(total * s["target_share"], s["tokens"] * s["max_repeats"])
        whole = min(math.floor(wanted / s["tokens"] + 1e-9), s["max_repeats"])
        rest = max(0, round(wanted - whole * s["tokens"])) if whole < s["max_repeats"] else 0
        out.append({"source": s["source"], "whole": whole, "rest": rest, "wanted": round(wanted)})
    return out


def scale_for(rest: float, classes: list[tuple[int, int, int]]) -> float:
    """The factor c with which probabilities min(1, c * size ** -SHORT_BIAS) make rest tokens on average.

    ``classes``: class, documents and tokens of each.
    """
    expected = lambda c: sum(min(1.0, c * (t / n) ** -SHORT_BIAS) * t for _, n, t in classes)
    low, high = 0.0, max(((t / n) ** SHORT_BIAS for _, n, t in classes), default=1.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < rest else (low, mid)
    return high


def sample_sizes(rest: int, classes: list[tuple[int, int, int]], scale: float, rng: random.Random) -> dict[int, int]:
    """How many documents of each class enter; see the module's docstring."""
    chance = {k: min(1.0, scale * (t / n) ** -SHORT_BIAS) for k, n, t in classes}
    out = {k: n for k, n, _ in classes if chance[k] >= 1}  # these are certain
    due = float(rest) - sum(t for k, _, t in classes if k in out)
    ahead = sum(chance[k] * t for k, _, t in classes if k not in out)
    for k, n, t in sorted(classes, reverse=True):
        if k not in out:
            room = min(1.0, 1 / chance[k] - 1)  # as far as a rate can move both ways
            mean = chance[k] * n * (1 + max(-room, min(room, due / ahead - 1)))
            take = min(n, math.floor(mean) + (rng.random() < mean - math.floor(mean)))
            out[k] = take
            due -= take * t / n
            ahead -= chance[k] * t
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture and the targets it was made for.

    First: doc_id, source, tokens, copies (1 up to max_repeats) of every document that enters;
    copies are a count and not repeated rows. Second: source, target_share, max_repeats,
    wanted tokens. Rows delivered twice count once; documents without tokens, without a source
    or of a source without target stay out. Of a target given twice the largest share holds.
    What reaches the driver is a row for each target's size classes, however many documents there are.
    """
    spark = documents.sparkSession
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    named = documents.where(F.col("source").isNotNull())
    items = written(token_counts(named, ["doc_id", "source"], path).where(F.col("tokens") > 0).dropDuplicates(["doc_id"])).withColumn("_class", size_class(F.col("tokens")))
    counted = items.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    known: dict[str, dict] = {}
    for r in goals.join(counted, "source", "left").collect():
        one = known.setdefault(r["source"], {"source": r["source"], "target_share": r["target_share"], "max_repeats": r["max_repeats"], "tokens": 0, "classes": []})
        if r["n"]:
            one["tokens"] += r["tokens"]
            one["classes"].append((r["_class"], r["n"], r["tokens"]))
    rows, sizes = [], []
    for p in sorted(plan(list(known.values())), key=lambda p: p["source"]):
        classes = known[p["source"]]["classes"]
        scale = scale_for(p["rest"], classes)
        rows.append((p["source"], p["whole"], p["wanted"], scale))
        sizes += [(p["source"], k, n) for k, n in sample_sizes(p["rest"], classes, scale, random.Random(f"{seed}:{p['source']}")).items()]
    plans = spark.createDataFrame(rows, "source string, whole int, wanted long, _scale double")
    wanted = spark.createDataFrame(sizes, "source string, _class int, _size long")
    drawn = items.join(F.broadcast(plans), "source").join(F.broadcast(wanted), ["source", "_class"])
    chance = F.least(F.greatest(F.col("_scale") * F.pow(F.col("tokens"), F.lit(-SHORT_BIAS)), F.lit(_EDGE)), F.lit(1 - _EDGE))
    u = _uniform(seed, "doc_id")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    # odds / (1 + odds) keeps the order and lies in (0, 1), which makes buckets of it.
    drawn = drawn.withColumn("_key", odds / (1 + odds)).withColumn("_bucket", F.least(F.floor(F.col("_key") * BUCKETS), F.lit(BUCKETS - 1))).drop("_scale", "wanted")
    # The bucket in which a class's sample ends, and how many of it still enter: a row a class.
    order = Window.partitionBy("source", "_class").orderBy("_bucket")
    upto = drawn.groupBy("source", "_class", "_size", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(order))
    cuts = upto.where((F.col("_upto") >= F.col("_size")) & (F.col("_upto") - F.col("_n") < F.col("_size"))).select("source", "_class", F.col("_bucket").alias("_cut"), (F.col("_size") - F.col("_upto") + F.col("_n")).alias("_need"))
    judged = drawn.join(F.broadcast(cuts), ["source", "_class"], "left")
    # Only the documents of that bucket are put in order.
    last = judged.where(F.col("_bucket") == F.col("_cut")).withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_class").orderBy("_key", "doc_id")))
    last = last.withColumn("_enters", F.col("_rank") <= F.col("_need")).drop("_rank")
    rest = judged.where(~F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))).withColumn("_enters", F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    copies = F.col("whole") + F.col("_enters").cast("int")
    out = last.unionByName(rest).withColumn("copies", copies).where(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")
    return out, goals.join(F.broadcast(plans), "source", "left").select("source", "target_share", "max_repeats", F.coalesce("wanted", F.lit(0)).alias("wanted"))


def shares(mixture: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: target_share, max_repeats, wanted and actual tokens and their difference, actual_share, documents, copies, max_copies."""
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("max_copies"))
    full = goals.join(got, "source", "left").fillna(0, ["tokens", "documents", "copies", "max_copies"]).withColumn("off_target", F.col("tokens") - F.col("wanted"))
    total = F.sum("tokens").over(Window.partitionBy())
    return full.withColumn("actual_share", F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(F.lit(0.0)))
