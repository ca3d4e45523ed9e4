"""Problem 5: groups of records that share most of their content.

A text is the set of its shingles; a shingle weighs its inverse document frequency ln(1 + N / df), counted over all rows in a
table of fixed size, but no less than the greatest weight over ``SPREAD``. The floor bounds how far the weighted similarity
can fall below the plain one that is verified, whatever stands in the other rows: a pair at 0.6 all of whose shared shingles
are common and all others rare still has 0.577. Improved consistent weighted sampling gives each text
``SAMPLES`` values, any of which two texts share with the probability of their weighted similarity; ``BANDS`` bands of
``PER_BAND`` values propose pairs; pairs whose values agree too seldom are left out; the rest are verified on their whole
shingle sets. By simulation 0.992 of the pairs at a weighted similarity of 0.6 are proposed, 0.999 at 0.65, 0.985 at 0.577.
``exact_links`` is the exact way (a join on the rarest shingles), against which recall is measured.

Exact copies of a text are one text until the end, so a text that stands in a third of all rows costs one. Buckets larger
than ``BUCKET`` are paired in blocks by a join, so none is held by one task and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.graph import components
from orrery.llm.lookalikes import Normaliser, normaliser_for
from orrery.llm.shingles import clean, mix, shingle_sets, text_hash
from orrery.operators.history import once
from orrery.session import written

#: Places of the table of document frequencies; rare shingles share places with others that are mostly rare, too.
DF_SIZE = 1 << 17
#: The greatest weight of a shingle over the least.
SPREAD = 1.1
SAMPLES, PER_BAND, BANDS = 150, 6, 150
#: Samples that are compared for a proposed pair, and the least share on which it must agree to be verified; it lies five
#: standard deviations below a weighted similarity of 0.577.
COMPARED, LEAST_AGREEMENT = 64, 0.27
BUCKET = 200
#: Entries of a part of the buckets, and entries held at once where one part has more.
PART_ENTRIES, HELD = 400_000, 4_000_000
#: Copies of a text that are paired in one group.
COPIES = 1000
#: Rows of texts taken at a time.
ROWS = 20_000
#: Bits of the table that tells which rows must be read for verification.
BITS = 1 << 23


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches joined, or parted, to ROWS rows at most, and joined only up to some 64 MB."""
    held, n, size = [], 0, 0
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            if n and (n + b.num_rows > ROWS or size > 64 << 20):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, size = [], 0, 0
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shingle_weights(df: DataFrame, text: str, norm: Normaliser, k: int) -> np.ndarray:
    """ln(1 + N / df), and the greatest of them over SPREAD at least, by place of the frequency table, over all rows; at most
    DF_SIZE numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_SIZE, np.int64), 0
        for b in _rows(batches):
            cleaned = [clean(t, norm) for t in b.column(0).to_pylist()]
            total += np.bincount((shingle_sets(cleaned, k)[1] & np.uint64(DF_SIZE - 1)).astype(np.int64), minlength=DF_SIZE)
            n += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["place", "n"])

    counted = df.select(text).mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    table, rows = np.full(DF_SIZE, np.inf), int(counted.n[counted.place < 0].sum())
    known = counted[counted.place >= 0]
    table[known.place.to_numpy()] = known.n.to_numpy()
    idf = np.log1p(max(rows, 1) / table)
    return np.maximum(idf, max(float(idf.max(initial=0)), 1e-3) / SPREAD).astype(np.float32)


def weighted_samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Improved consistent weighted sampling: SAMPLES values of 8 bits for each of ``docs`` weighted sets, given as sorted
    (doc, shingle, weight). A sample is told by the logarithm of its least ``a``, which depends on shingle and step only."""
    out = np.zeros((docs, SAMPLES), np.uint8)
    if not len(doc):
        return out
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    present = doc[starts]
    key = shingle ^ (weight.view(np.uint32).astype(np.uint64) << np.uint64(32))
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    s, logw, unit = shingle[first], np.log(weight[first]), np.float32(1 / (1 << 21))
    low = np.uint64((1 << 21) - 1)
    part = lambda h, shift: ((h >> np.uint64(shift)) & low).astype(np.float32) * unit + unit / 2
    at = at.astype(np.int32)
    for k in range(SAMPLES):
        h, g = (mix(s + np.uint64(i * 0xA0761D6478BD642F & (1 << 64) - 1)) for i in (2 * k + 1, 2 * k + 2))
        r = -np.log(part(h, 0) * part(h, 21))
        c = -np.log(part(g, 0) * part(g, 21))
        beta = part(h, 42)
        a = np.log(c) - r * (np.floor(logw / r + beta) - beta + 1)
        least = np.minimum.reduceat(a.astype(np.float32)[at], starts)
        out[present, k] = (mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
    return out


def _bands() -> np.ndarray:
    """The samples of each band: every sample serves in BANDS * PER_BAND / SAMPLES bands."""
    g = np.random.default_rng(7)
    return np.concatenate([g.permutation(SAMPLES).reshape(-1, PER_BAND) for _ in range(BANDS * PER_BAND // SAMPLES)])


def signatures(df: DataFrame, key: str, text: str, norm: Normaliser, k: int) -> DataFrame:
    """(key, h, sig) of each row whose text has a shingle: the hash of the text, and its samples if it is new to its task."""

    shared = df.sparkSession.sparkContext.broadcast(shingle_weights(df, text, norm, k))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        seen: dict[int, bool] = {}  # whether a text seen before has a shingle
        for b in _rows(batches):
            cleaned = [clean(t, norm) for t in b.column(1).to_pylist()]
            hashes = [text_hash(t) for t in cleaned]
            fresh = [i for i, h in enumerate(hashes) if h not in seen and seen.setdefault(h, True)]
            doc, shingle, _ = shingle_sets([cleaned[i] for i in fresh], k)
            sig = weighted_samples(doc, shingle, weights[(shingle & np.uint64(DF_SIZE - 1)).astype(np.int64)], len(fresh))
            has = np.zeros(len(fresh), bool)
            has[doc] = True
            sigs: list[bytes | None] = [None] * len(hashes)
            for j, i in enumerate(fresh):
                seen[hashes[i]] = bool(has[j])
                if has[j]:
                    sigs[i] = sig[j].tobytes()
            own = pa.array([seen[h] for h in hashes], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.int64()), pa.array(sigs, pa.binary())], names=["key", "h", "sig"])
            yield out.filter(own)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(sign, f"key {df.schema[key].dataType.simpleString()}, h long, sig binary")


def _band_rows(parts: int):
    bands = _bands()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket entries of texts (id, sig) by part: of each entry 32 bits of the bucket and the last 16 bits of the text's
        id, the rest of which the entries of a row share."""
        for b in _rows(batches):
            sig, ids = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, SAMPLES), b.column(0).to_numpy()
            value = np.zeros((len(ids), len(bands)), np.uint64)
            for i in range(PER_BAND):
                value = value << np.uint64(8) | sig[:, bands[:, i]]
            key = mix(value * np.uint64(len(bands)) + np.arange(len(bands), dtype=np.uint64)).ravel()
            part, base = (key % np.uint64(parts)).astype(np.int64), np.repeat(ids >> 16, len(bands))
            at = np.lexsort((base, part))
            part, base, key, place = part[at], base[at], (key[at] >> np.uint64(32)).astype(np.uint32), (np.repeat(ids, len(bands))[at] & 0xFFFF).astype(np.uint16)
            starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (base[1:] != base[:-1])]))
            ends = np.append(starts[1:], len(at))
            out = [[x[lo:hi].tobytes() for lo, hi in zip(starts, ends)] for x in (key, place)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), *(pa.array(x, pa.binary()) for x in out), pa.array(base[starts] << 16)], names=["part", "bucket", "place", "base"])

    return rows


def _block_pairs(left: list, right: list, members: np.ndarray) -> None:
    i, j = np.triu_indices(len(members), 1)
    left.append(members[i])
    right.append(members[j])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by part: pairs of different texts (block null). Buckets over BUCKET also give their blocks, whose
    pairs with each other are left to a join. Not more than HELD entries are held: beyond that, the members of the
    largest buckets become blocks at once."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    hot: list[tuple[int, int, list[int]]] = []
    part, held, size, blocks = None, [], 0, {}

    def out() -> Iterator[pa.RecordBatch]:
        if left or hot:
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            n, m, none = len(a), len(hot), pa.nulls
            pairs = [pa.concat_arrays([pa.array(np.minimum(a, b)), none(m, pa.int64())]), pa.concat_arrays([pa.array(np.maximum(a, b)), none(m, pa.int64())])]
            of = [pa.concat_arrays([none(n, t), pa.array([x[i] for x in hot], t)]) for i, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*pairs, *of], names=["a", "b", "bucket", "block", "members"])
        left.clear(), right.clear(), hot.clear()

    def as_blocks(key: int, members: np.ndarray) -> None:
        for i in range(0, len(members), BUCKET):
            blocks[key] = n = blocks.get(key, -1) + 1
            hot.append((part << 32 | key, n, members[i : i + BUCKET].tolist()))
            _block_pairs(left, right, members[i : i + BUCKET])

    def close(last: bool) -> None:
        nonlocal held, size
        if not size:
            held = []
            return
        key, text = (np.concatenate(x) for x in zip(*held))
        at = np.lexsort((text, key))
        key, text = key[at], text[at]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
        key, text = key[new], text[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(starts, len(key)))
        large = (n > (BUCKET if last else max(BUCKET, HELD // 16))) | np.isin(key[starts], np.fromiter(blocks, np.uint32, len(blocks)))
        for i in np.flatnonzero(large):
            as_blocks(int(key[starts[i]]), text[starts[i] : starts[i] + n[i]])
        if not last:
            keep = np.repeat(~large, n)
            held, size = [(key[keep], text[keep])], int(keep.sum())
            return
        for m in np.unique(n[(n > 1) & ~large]):
            rows = starts[(n == m) & ~large]
            i, j = np.triu_indices(m, 1)
            left.append(text[rows[:, None] + i].ravel())
            right.append(text[rows[:, None] + j].ravel())
        held, size = [], 0

    for batch in batches:
        for p, bucket, place, base in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                close(True)
                part = p
                blocks.clear()
            held.append((np.frombuffer(bucket, np.uint32), np.frombuffer(place, np.uint16).astype(np.int64) + base))
            size += len(held[-1][0])
            if size > HELD:
                close(False)
        if sum(map(len, left)) > 50_000 or len(hot) > 50:
            yield from out()
    close(True)
    yield from out()


def proposed_pairs(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: the ids of texts (id, sig) that share a bucket of some band, once each."""
    parts = texts.count() * BANDS // PART_ENTRIES + 1
    entries = texts.select("id", "sig").mapInArrow(_band_rows(parts), "part int, bucket binary, place binary, base long")
    found = entries.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_pair_rows, "a long, b long, bucket long, block int, members array<long>")
    found = written(found.distinct(), "proposed")
    hot = found.where("block is not null")
    if hot.isEmpty():
        return found.select("a", "b")
    # every pair of blocks of a bucket is a key of its own, so that no task holds a bucket
    hot = hot.join(hot.groupBy("bucket").agg(F.max("block").alias("last")), "bucket")
    x = hot.where("block < last").select("bucket", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, "last")).alias("j"), F.col("members").alias("m"))
    y = hot.where("block > 0").select("bucket", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.col("members").alias("n"))
    more = x.join(y, ["bucket", "i", "j"]).select(F.explode("m").alias("x"), "n").select("x", F.explode("n").alias("y")).where("x <> y")
    return found.where("block is null").select("a", "b").unionAll(more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _agreement(a: str, b: str):
    @F.pandas_udf("float")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, COMPARED) for v in (x, y))
        return pd.Series((p == q).mean(axis=1, dtype=np.float32))

    return agree(a, b)


def similar_texts(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 5, normaliser: Normaliser | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(key, h) puts each row with at least ``k`` words under its text's hash; links(a, b,
    similarity) are the pairs of different texts whose sets of ``k``-word shingles have a Jaccard similarity of
    ``threshold`` or more. Rows without a key are left out; repeated rows count once; other columns are not read."""
    df = df.where(F.col(key).isNotNull())
    norm = normaliser or normaliser_for(df, [text])
    signed = written(signatures(df, key, text, norm, k).withColumn("id", F.monotonically_increasing_id()), "signed")  # ids are settled by being written
    texts = once(signed.where("sig is not null"), "h", "id")
    pairs, of = proposed_pairs(texts), lambda a: texts.select(F.col("id").alias(a), F.struct("h", "key").alias(f"t{a}"), F.substring("sig", 1, COMPARED).alias(f"s{a}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(_agreement("sa", "sb") >= LEAST_AGREEMENT).select("ta", "tb")
    near = written(near, "near")
    wanted = written(near.select(F.col("ta").alias("t")).unionAll(near.select("tb")).distinct().select("t.h", "t.key"), "wanted")
    near = near.select(F.least("ta.h", "tb.h").alias("a"), F.greatest("ta.h", "tb.h").alias("b"))
    sets = _sets(df, key, text, norm, k, wanted)
    verified = near.join(sets.select(F.col("h").alias("a"), F.col("s").alias("p")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("q")), "b")
    shared = F.size(F.array_intersect("p", "q"))
    links = verified.select("a", "b", (shared / (F.size("p") + F.size("q") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    return signed.select("key", "h").distinct(), links


def exact_links(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 5, normaliser: Normaliser | None = None) -> DataFrame:
    """(a, b, similarity): the links of ``similar_texts``, none left to chance. With shingles in order of their frequency,
    rarest first, two texts with a similarity of ``threshold`` share one of the first n - ceil(threshold n) + 1 of each; texts
    that do, and whose numbers of shingles allow it, are verified. A join on shingles instead of buckets: dear where rare
    shingles are few; the way to measure what sampling loses, or to do without it."""
    df = df.where(F.col(key).isNotNull())
    norm = normaliser or normaliser_for(df, [text])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            cleaned = [clean(t, norm) for t in b.column(0).to_pylist()]
            doc, shingle, _ = shingle_sets(cleaned, k)
            ends = np.searchsorted(doc, np.arange(len(cleaned) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([text_hash(t) for t in cleaned], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64)))], names=["h", "s"])

    sets = written(df.select(F.col(text).alias("text")).mapInArrow(read, "h long, s array<long>").where(F.size("s") > 0).groupBy("h").agg(F.first("s").alias("s")), "sets")
    each = sets.select("h", F.size("s").alias("n"), F.explode("s").alias("x"))
    order = Window.partitionBy("h").orderBy("df", "x")  # the shingles of one text
    first = each.join(each.groupBy("x").agg(F.count("*").alias("df")), "x").withColumn("r", F.row_number().over(order))
    first = written(first.where(F.col("df") > 1).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("h", "n", "x"), "first")
    pairs = first.select("x", F.col("h").alias("a"), F.col("n").alias("m")).join(first.select("x", F.col("h").alias("b"), "n"), "x")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.least("m", "n") >= threshold * F.greatest("m", "n") - 1e-9)).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("p")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("q")), "b")
    shared = F.size(F.array_intersect("p", "q"))
    return both.select("a", "b", (shared / (F.size("p") + F.size("q") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def _sets(df: DataFrame, key: str, text: str, norm: Normaliser, k: int, wanted: DataFrame) -> DataFrame:
    """(h, s): the shingle sets of the wanted texts, read again from one row of each. Which rows to take is told by a bit
    table of fixed size, built in parts, so that most rows are passed over before any work; a row too many does no harm."""
    kind = df.schema[key].dataType.simpleString()
    place = lambda v: xxhash.xxh3_64_intdigest(str(v)) % BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.array([place(v) for b in batches for v in b.column(0).to_pylist()], np.int64))
        byte, start = np.unique(at >> 3, return_index=True)
        value = np.bitwise_or.reduceat(1 << (at & 7), start) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(byte, pa.int32()), pa.array(value, pa.int32())], names=["byte", "value"])

    marked = wanted.select("key").mapInArrow(mark, "byte int, value int").groupBy("byte").agg(F.bit_or("value").alias("value")).toPandas()
    table = np.zeros(BITS // 8, np.uint8)
    table[marked.byte.to_numpy()] = marked.value.to_numpy()
    bits = df.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in _rows(batches):
            at = [i for i, v in enumerate(b.column(0).to_pylist()) if held[(p := place(v)) >> 3] >> (p & 7) & 1]
            keys = b.column(0).take(pa.array(at, pa.int64()))
            cleaned = [clean(t, norm) for t in b.column(1).take(pa.array(at, pa.int64())).to_pylist()]
            doc, shingle, _ = shingle_sets(cleaned, k)
            ends = np.searchsorted(doc, np.arange(len(at) + 1)).astype(np.int32)
            hashes = pa.array([text_hash(t) for t in cleaned], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, hashes, pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64)))], names=["key", "h", "s"])

    found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(read, f"key {kind}, h long, s array<long>")
    return wanted.join(found, ["key", "h"]).groupBy("h").agg(F.first("s").alias("s"))


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 5, normaliser: Normaliser | None = None) -> DataFrame:
    """(key_a, key_b): the pairs of rows with different keys, the smaller first, whose texts' shingle sets are similar;
    rows with the same text are pairs too, if it has a shingle. Each pair comes once."""
    members, links = similar_texts(df, key, text, threshold, k, normaliser)
    members = written(members, "members")
    pair = links.join(members.select(F.col("h").alias("a"), F.col("key").alias("x")), "a").join(members.select(F.col("h").alias("b"), F.col("key").alias("y")), "b").where("x <> y")
    copies = members.groupBy("h").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").select("h", "parts")
    own = members.join(copies, "h").withColumn("part", F.pmod(F.hash("key"), "parts"))
    # every pair of parts of a text's copies is a key of its own, so that no task holds all copies
    left = own.select("h", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.col("key").alias("x"))
    right = own.select("h", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), F.col("key").alias("y"))
    same = left.join(right, ["h", "i", "j"]).where("i < j or x < y")
    both = pair.select("x", "y").unionAll(same.select("x", "y"))  # either may come first
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def similar_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 5, normaliser: Normaliser | None = None) -> DataFrame:
    """(key, group_id, links): one row for each key whose text is similar to another's or stands under several keys: the
    smallest key of its group (transitively) and the number of other texts its own is linked to. Copies share a row's
    links and are not expanded into pairs."""
    members, links = similar_texts(df, key, text, threshold, k, normaliser)
    members, links = written(members, "members"), written(links, "links")
    group = components(links)
    degree = links.select(F.col("a").alias("h")).unionAll(links.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))
    copies = members.groupBy("h").agg(F.count("*").alias("n"))
    text_group = copies.join(group.withColumnRenamed("node", "h"), "h", "left").join(degree, "h", "left").where("n > 1 or component is not null")
    rows = members.join(text_group.select("h", F.coalesce("component", "h").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "h")
    least = rows.groupBy("component").agg(F.min("key").alias("group_id"))
    return rows.join(least, "component").select("key", "group_id", F.col("links").cast("long").alias("links"))
