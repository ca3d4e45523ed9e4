"""Problem 4: lines that stand again and again in the texts of one source.

A line is its letters in the consistent form, regardless of case and of all else; lines without letters never count. For
each source there is a weighted graph: nodes are lines with the number of texts they stand in, edges are pairs of lines
that follow each other (lines without letters between them skipped) with the number of texts they do so in. Nodes and
edges of high support are kept, connected components are the blocks of boilerplate, and the lines of the blocks are deleted
where they stand.

Defined results: null and empty texts have no lines to remove; a text without a source belongs to none and stays whole;
repeated rows of a key count once; a line counts once a text, but every place of it is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.graph import components
from orrery.llm.lookalikes import Normaliser, normaliser_for
from orrery.session import broadcast_if_small, written

LEAST_TEXTS, LEAST_SHARE = 8, 0.04
#: Rows up to which the kept nodes are broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NO_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def line_letters(line: str) -> bytes:
    if line.isascii():
        return line.encode().translate(_LOWER, _NO_LETTER)
    return "".join(c for c in line.casefold() if c.isalpha()).encode("utf-8", "replace")


def hashed_lines(df: DataFrame, key: str, text: str, source: str, norm: Normaliser) -> DataFrame:
    """(key, source, lines): one row for each key; ``lines`` has a hash for each line of the text, null without letters."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(2).to_pylist():
                letters = [line_letters(x) for x in (norm(t) or "").split("\n")]
                rows.append([xxhash.xxh3_64_intdigest(x) - (1 << 63) if x else None for x in letters])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["key", "source", "lines"])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, source)]
    raw = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where("key is not null and source is not null")
    read_rows = raw.mapInArrow(read, f"key {kinds[0]}, source {kinds[1]}, lines array<long>")
    return read_rows.groupBy("key").agg(F.min(F.struct("source", "lines")).alias("r")).select("key", "r.*")


def repeated_lines(lines: DataFrame, least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(nodes, places): nodes(source, line, texts, block), the lines of high support with their block, and places(key,
    source, line, line_no, block), everywhere they stand. ``lines`` comes from ``hashed_lines`` and should be written."""
    size = lines.groupBy("source").agg(F.count("*").alias("n"))
    high = (F.col("texts") >= least_texts) & (F.col("texts") >= F.col("n") * least_share)
    support = lines.select("source", F.explode(F.array_distinct("lines")).alias("line")).where("line is not null").groupBy("source", "line").agg(F.count("*").alias("texts"))
    nodes = written(support.join(size, "source").where(high).select("source", "line", "texts", "n"), "nodes")
    letters = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("line"), (i + 1).alias("line_no"))), lambda s: s["line"].isNotNull())
    each = lines.select("key", "source", F.posexplode(letters)).select("key", "source", "pos", "col.line", "col.line_no")
    places = written(each.join(broadcast_if_small(nodes.select("source", "line"), BROADCAST_ROWS), ["source", "line"]), "places")
    w = Window.partitionBy("key").orderBy("pos")
    follows = places.withColumn("before", F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag("line").over(w))).where("before is not null")
    edges = follows.select("key", "source", "before", "line").distinct().groupBy("source", "before", "line").agg(F.count("*").alias("texts"))
    edges = edges.join(size, "source").where(high).select(F.xxhash64("source", "before").alias("a"), F.xxhash64("source", "line").alias("b"))
    block = components(edges).withColumnRenamed("node", "_id").withColumnRenamed("component", "_block")
    nodes = nodes.withColumn("_id", F.xxhash64("source", "line")).join(block, "_id", "left").select("source", "line", "texts", F.coalesce("_block", "_id").alias("block"))
    nodes = written(nodes, "blocks")
    return nodes, places.join(broadcast_if_small(nodes.drop("texts"), BROADCAST_ROWS), ["source", "line"]).select("key", "source", "line", F.col("line_no").cast("int").alias("line_no"), "block")


def boilerplate(df: DataFrame, key: str, text: str, source: str, normaliser: Normaliser | None = None, least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(nodes, places) of the boilerplate blocks of each source, as in ``repeated_lines``."""
    norm = normaliser or normaliser_for(df, [text])
    return repeated_lines(written(hashed_lines(df, key, text, source, norm), "lines"), least_texts, least_share)


def without_lines(df: DataFrame, key: str, text: str, places: DataFrame, name: str) -> DataFrame:
    """``df`` with the text without its lines at ``places`` in the new column ``name``."""
    if name in df.columns:
        raise ValueError(f"column exists already: {name}")
    gone = places.groupBy(F.col("key").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))  # at most the lines of one text
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i + 1)), "\n")
    return df.join(gone, df[key] == gone["_key"], "left").withColumn(name, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_key", "_gone")
