"""Problem 7: records of several sources are combined so that each source has its target share of all tokens.

The total is ``TOTAL_SHARE`` of the tokens of all sources that have a target, unless it is given. A source that cannot
reach its share of it within its cap of uses is used up, and what it lacks goes to the others in proportion to their
targets, again capped, until the total is met or every source is used up; the shares reached are reported. Without any
total it is the largest at which every source that has tokens reaches its share, which the scarcest source decides.
Each source's budget is met by complete epochs first, then by Efraimidis-Spirakis sampling: records in the order of
exponential keys -ln(u) / quality, u from a hash of the record's key and a seed, up to the budget; last, the one record
left whose size is nearest to what is missing is added if that brings the source closer.

The order is never sorted in one task: the logarithms of the keys fall into equal steps, whose sizes are summed first, and
only the step in which the budget ends is sorted. Whatever the qualities, a step holds 0.01 % of a source at most, so hot
sources need no other treatment. Defined results: sources without a target, without tokens, or null give nothing; a null or
empty text has no tokens and is never used; a null cap is 1; copies of a text under other keys are records of their own;
of a source's repeated targets the greatest counts; more than ``MOST_TARGETS`` targets are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import written

#: Steps of the keys in one unit of their natural logarithm.
KEY_STEPS = 4096
#: Tokens of the mixture as a share of the tokens of the sources with a target.
TOTAL_SHARE = 0.5
#: Targets that the table of parameters may hold.
MOST_TARGETS = 10_000


def exponential_key(key: Column, quality: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / quality


def text_quality(text: Column) -> Column:
    """A weight from 0.25 to 1: the share of distinct words among a text's words counts for three quarters."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.lit(0.25) + 0.75 * F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))


def budgets(sources: Sequence[tuple[str, float, int, int]], total: float) -> list[tuple[str, int]]:
    """The tokens that each source (name, target share, most uses, tokens) gives to a mixture of ``total`` tokens: its share
    of what the used-up sources leave over, or all of its uses if these are fewer."""
    left, open_, out = total, sorted((have * uses / share, name, share, have * uses) for name, share, uses, have in sources if share > 0 and have > 0), []
    while open_:
        each = left / sum(x[2] for x in open_)
        ratio, name, share, most = open_[0]
        if ratio > each:
            return out + [(x[1], int(x[2] * each + 1e-6)) for x in open_]
        out.append((name, most))
        left -= most
        open_ = open_[1:]
    return out


def mix(records: DataFrame, targets: DataFrame, key: str, source: str, size: str, quality: str, seed: int = 0, total: int | None = None, total_share: float | None = TOTAL_SHARE) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): selection(source, key, n_tokens, copies) and shares(source, target_share, max_repeats,
    available_tokens, budget_tokens, selected_tokens, actual_share), one row for each target. ``records`` holds keys,
    sources, sizes and qualities; ``targets`` (source, target_share, max_repeats) is a small table of parameters."""
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats"))
    wanted = t.limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    spark = records.sparkSession
    t = F.broadcast(spark.createDataFrame([tuple(r) for r in wanted], "source string, target_share double, max_repeats int"))
    own = records.where(F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(size).cast("long").alias("n"), F.greatest(F.coalesce(F.col(quality), F.lit(1.0)), F.lit(1e-6)).alias("q"))
    own = own.join(t.select("source"), "source").withColumn("e", exponential_key(F.col("key"), F.col("q"), seed)).withColumn("bucket", F.floor(F.log("e") * KEY_STEPS))
    own = written(own.select("source", "key", "n", "e", "bucket"), "keys")
    sums = written(own.groupBy("source", "bucket").agg(F.sum("n").alias("n")), "sums")
    have = {r.source: r.have for r in sums.groupBy("source").agg(F.sum("n").alias("have")).collect()}  # a row a target at most
    known = [(r.source, r.target_share, r.max_repeats, have.get(r.source, 0)) for r in wanted]
    if total is None and total_share is not None:
        total = total_share * sum(have.values())
    elif total is None:
        total = min((have * uses / share for _, share, uses, have in known if have), default=0) * sum(x[1] for x in known if x[3])
    given = budgets(known, total)
    b = F.broadcast(spark.createDataFrame([(s, have[s], n, n // have[s], n % have[s]) for s, n in given], "source string, have long, budget long, epochs int, rest long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).join(b.select("source", "rest"), "source").where("before <= rest and rest < before + n").select("source", F.col("bucket").alias("last"), (F.col("rest") - F.col("before")).alias("room"))
    keyed = own.join(b.select("source", "epochs", "rest"), "source").join(F.broadcast(ends), "source", "left")
    inside = keyed.where(F.col("bucket") == F.col("last")).withColumn("run", F.sum("n").over(Window.partitionBy("source").orderBy("e", "key").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("taken", F.col("run") <= F.col("room")).drop("run")
    outside = keyed.where(F.col("last").isNull() | (F.col("bucket") != F.col("last"))).withColumn("taken", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)))
    chosen = written(inside.unionByName(outside), "chosen")
    got = chosen.groupBy("source").agg(F.sum(F.when(F.col("taken"), F.col("n")).otherwise(0)).alias("got"))
    gap = b.select("source", "rest").join(got, "source").select("source", (F.col("rest") - F.col("got")).alias("gap")).where("gap > 0")
    free = chosen.where("not taken").join(F.broadcast(gap), "source").where(F.abs(F.col("n") - F.col("gap")) < F.col("gap"))
    extra = free.groupBy("source").agg(F.min_by("key", F.struct(F.abs(F.col("n") - F.col("gap")), "e", "key")).alias("extra"))
    final = chosen.join(F.broadcast(extra), "source", "left").withColumn("copies", (F.col("epochs") + (F.col("taken") | F.coalesce(F.col("key") == F.col("extra"), F.lit(False))).cast("int")).cast("int"))
    selection = final.where("copies > 0").select("source", "key", F.col("n").alias("n_tokens"), "copies")
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("selected_tokens"))
    shares = t.join(b.select("source", F.col("have").alias("available_tokens"), F.col("budget").alias("budget_tokens")), "source", "left").join(used, "source", "left").na.fill(0, ["available_tokens", "budget_tokens", "selected_tokens"])
    every = Window.partitionBy(F.lit(1))  # over the targets, a table of parameters
    shares = shares.withColumn("actual_share", F.round(F.col("selected_tokens") / F.greatest(F.sum("selected_tokens").over(every), F.lit(1)), 6))
    return selection, shares.select("source", "target_share", "max_repeats", "available_tokens", "budget_tokens", "selected_tokens", "actual_share")
