"""Problem 6: items of varying length are put into containers of fixed capacity with little space left.

Minimum bin slack on the histogram of lengths: the longest length left is put into a container, a subset-sum over the
lengths left (a bit set of reachable sums, as a Python integer, walked back to the counts) fills the rest as closely as
can be, and the pattern is used for as many containers as the counts allow. The histogram has at most one row for each
length up to the capacity, so the plan's cost and size depend on the capacity, not on the number of items. Items then
find their container by their rank among the items of their length.

Defined results: an item longer than the capacity is split into full pieces and a rest, any other is one piece; an item
without length (null or empty text) is a piece of length 0 in container 1; copies of an item are items of their own;
a capacity that is null or below 1 has no containers; more than ``MOST_KINDS`` kinds are refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.ordering import PART, numbered, partitioned
from orrery.session import written

#: Kinds of containers that the table of parameters may hold.
MOST_KINDS = 1000


def fill(target: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, with the largest sum up to ``target``; long lengths are tried first."""
    steps, bits, mask = [], 1, (1 << (target + 1)) - 1
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, times = min(counts[length], target // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, bits))
            bits |= (bits << (length * times)) & mask
            left, times = left - times, times * 2
        if bits >> target & 1:
            break
    s, used = bits.bit_length() - 1, Counter()
    for length, times, before in reversed(steps):
        if not before >> s & 1:
            used[length] += times
            s -= length * times
    return dict(used)


def plan(capacity: int, histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, per_container, first_rank, first_container, containers) for each length of each pattern; ranks are from 0
    and containers from 1. The ranges of a length follow one another and cover its count."""
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    rank, container, out = Counter(), 1, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        pattern = Counter(fill(capacity - seed, {k: v for k, v in counts.items() if v > 0}))
        counts[seed] += 1
        pattern[seed] += 1
        times = min(counts[k] // m for k, m in pattern.items())
        for k, m in pattern.items():
            out.append((k, m, rank[k], container, times))
            rank[k] += m * times
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
        container += times
    return out


def _plans(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = plan(int(pdf.capacity.iloc[0]), dict(zip(pdf.length, pdf.n)))
    out = pd.DataFrame(rows, columns=["length", "per_container", "first_rank", "first_container", "containers"])
    out.insert(0, "kind", pdf.kind.iloc[0])
    return out


def pack(items: DataFrame, key: str, size: str, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """(kind, container_id, key, piece, offset, n_tokens): the pieces of every item in the containers of every kind.
    ``kinds`` is a small table of names and capacities."""
    k = kinds.select(F.col(kind).alias("kind"), F.col(capacity).cast("long").alias("capacity")).where("kind is not null and capacity >= 1").distinct()
    if k.limit(MOST_KINDS + 1).count() > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    each = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size")).crossJoin(F.broadcast(k))
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity")) - 1, F.lit(0))
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    pieces = pieces.withColumn("offset", F.col("piece") * F.col("capacity")).withColumn("length", F.least("capacity", F.col("size") - F.col("offset"))).drop("size")
    parts = partitioned(pieces, ["kind", "length"], ["key", "piece"])
    histogram = parts.where("length > 0").groupBy("kind", "capacity", "length").agg(F.count("*").alias("n"))
    plans = histogram.groupBy("kind").applyInPandas(_plans, "kind string, length long, per_container long, first_rank long, first_container long, containers long").toPandas()
    table = {g: x.sort_values("first_rank")[["first_rank", "per_container", "first_container"]].to_numpy() for g, x in plans.groupby(["kind", "length"])}
    shared = items.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        for b in batches:
            pdf = b.select(["kind", "length", "rank"]).to_pandas()
            out = np.ones(len(pdf), np.int64)
            for g, at in pdf.groupby(["kind", "length"]).indices.items():
                if (r := ranges.get(g)) is not None:
                    rank = pdf["rank"].to_numpy()[at] - 1
                    i = np.searchsorted(r[:, 0], rank, side="right") - 1
                    out[at] = r[i, 2] + (rank - r[i, 0]) // r[i, 1]
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(out), b.column("key"), b.column("piece"), b.column("offset"), b.column("length")], names=["kind", "container_id", "key", "piece", "offset", "n_tokens"])

    ranked = numbered(parts, ["kind", "length"], ["key", "piece"], "rank").drop(PART)
    return ranked.mapInArrow(place, f"kind string, container_id long, key {items.schema[key].dataType.simpleString()}, piece long, offset long, n_tokens long")


def fill_report(packed: DataFrame, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """(kind, capacity, containers, pieces, tokens, fill): how full the containers of each kind are."""
    per = packed.groupBy("kind").agg(F.max("container_id").alias("containers"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    k = kinds.select(F.col(kind).alias("kind"), F.col(capacity).cast("long").alias("capacity")).distinct()
    return per.join(k, "kind").select("kind", "capacity", "containers", "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))


def sized(df: DataFrame, key: str, size: str) -> DataFrame:
    """The items' keys and sizes, written, so that texts are tokenised once."""
    return written(df.select(key, size), "sizes")
