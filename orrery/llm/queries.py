"""Queries of the training-data problems, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import boilerplate, dialogue, lookalikes, mixing, neardup, packing, replies, subjects, tokens
from orrery.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_KEY = r"lower(regexp_replace({}, '^[\s\p{{Z}}{{}}]+|[\s\p{{Z}}{{}}]+$', '', 'g'))"
_BLANKS = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_ISO = r"^(\d{4})-?(\d\d)-?(\d\d)[Tt _]+(\d\d):?(\d\d)(?::?(\d\d)(?:[.,](\d{1,9}))?)?\s*([Zz]|UTC|GMT|[+-]\d\d(?::?\d\d)?)?$"
_PART = lambda i: f"regexp_extract(s, '{_ISO}', {i})"
_ZONE = f"CASE WHEN upper({_PART(8)}) IN ('', 'Z', 'UTC', 'GMT') THEN '+00:00' ELSE substr({_PART(8)}, 1, 3) || ':' || rpad(replace(substr({_PART(8)}, 4, 3), ':', ''), 2, '0') END"
_INSTANT = f"""CASE WHEN regexp_matches(s, '^\\d{{9,17}}$') THEN CASE WHEN length(s) >= 15 THEN s::BIGINT WHEN length(s) >= 12 THEN s::BIGINT * 1000 ELSE s::BIGINT * 1000000 END
    WHEN regexp_matches(s, '{_ISO}') THEN epoch_us(try_cast({_PART(1)} || '-' || {_PART(2)} || '-' || {_PART(3)} || ' ' || {_PART(4)} || ':' || {_PART(5)} || ':' || coalesce(nullif({_PART(6)}, ''), '00') || '.' || rpad(substr({_PART(7)}, 1, 6), 6, '0') || {_ZONE} AS TIMESTAMPTZ)) END"""
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
ORACLES["p2_found"] = f"""
  WITH known AS (SELECT key, min(id) AS conversation_id FROM (SELECT id, {_KEY.format('id')} AS key FROM conversations) WHERE key <> '' GROUP BY 1),
  m AS (SELECT k.conversation_id, x.id, {_INSTANT} AS instant, trimmed, visible, CASE WHEN role IN ({_QUOTED(dialogue.USER_ROLES)}) THEN 'user' WHEN role IN ({_QUOTED(dialogue.ASSISTANT_ROLES)}) THEN 'assistant' END AS speaker
    FROM (SELECT id, {_KEY.format('conversation_id')} AS key, lower({_BLANKS.format('role')}) AS role, {_BLANKS.format('created_at')} AS s, coalesce({_BLANKS.format('content')}, '') AS trimmed, coalesce(regexp_matches(content, '[^{dialogue.UNSEEN}]'), false) AS visible FROM messages) x JOIN known k ON k.key = x.key),
  d AS (SELECT conversation_id, speaker, instant, trimmed, min(id) AS message_id, bool_or(visible) AS visible FROM m GROUP BY 1, 2, 3, 4),
  o AS (SELECT *, row_number() OVER w AS turn, lag(speaker) OVER w AS before FROM d WINDOW w AS (PARTITION BY conversation_id ORDER BY instant, message_id)),
  kept AS (SELECT conversation_id FROM o GROUP BY 1 HAVING count(*) = count(speaker) AND count(*) = count(instant) AND bool_and(visible AND speaker <> coalesce(before, 'assistant')) AND count(*) % 2 = 0)
  SELECT conversation_id, turn::INT AS turn, message_id FROM o WHERE conversation_id IN (SELECT conversation_id FROM kept)"""


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of chunks that are stored with other characters than their consistent form."""
    return lookalikes.dirty_fields(table(spark, sf_dir, "chunks"), "chunk_id", ["text", "item_section"])


@query
def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk once, with text and section in the consistent form."""
    df = table(spark, sf_dir, "chunks", ["chunk_id", "text", "item_section"])
    return lookalikes.normalise_columns(df, ["text", "item_section"]).dropDuplicates(["chunk_id"])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose sets of three-word runs have a similarity of 0.6 or more."""
    pairs = neardup.similar_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "text", threshold=0.6, k=3)
    return pairs.toDF("chunk_id_a", "chunk_id_b")


@query
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate chunks: one row for each chunk of a group, with its number of links to other texts."""
    return neardup.similar_groups(table(spark, sf_dir, "chunks"), "chunk_id", "text", threshold=0.6, k=3).withColumnRenamed("key", "chunk_id")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every conversation that is whole."""
    t = dialogue.conversations_in_order(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return t.select("conversation_id", "turn", "message_id")


@query
def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with speaker and likeliest parent."""
    return dialogue.conversations_in_order(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))


def _boilerplate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return boilerplate.boilerplate(table(spark, sf_dir, "chunks"), "chunk_id", "text", "ticker")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the lines that are repeated within a ticker."""
    return _boilerplate(spark, sf_dir)[1].select(F.col("key").alias("chunk_id"), "line_no").distinct()


@query
def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines of each ticker with the texts they stand in and their block."""
    return _boilerplate(spark, sf_dir)[0].withColumnRenamed("source", "ticker")


@query
def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk once, with its text without repeated lines."""
    places = _boilerplate(spark, sf_dir)[1]
    chunks = table(spark, sf_dir, "chunks", ["chunk_id", "text"])
    return boilerplate.without_lines(chunks, "chunk_id", "text", places, "clean_text").groupBy("chunk_id").agg(F.first("clean_text").alias("clean_text"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kinds = table(spark, sf_dir, "pack_sizes")
    sizes = packing.sized(tokens.with_tokens(table(spark, sf_dir, "documents", ["doc_id", "text"]), "text"), "doc_id", "n_tokens")
    return packing.pack(sizes, "doc_id", "n_tokens", kinds, "container_kind", "capacity_tokens"), kinds


@query
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in the containers of each kind."""
    return _packed(spark, sf_dir)[0].withColumnsRenamed({"kind": "container_kind", "key": "doc_id"})


@query
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.fill_report(*_packed(spark, sf_dir), "container_kind", "capacity_tokens").withColumnRenamed("kind", "container_kind")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    targets = table(spark, sf_dir, "source_targets")
    sized = tokens.with_tokens(docs, "text").withColumn("quality", mixing.text_quality(F.col("text"))).drop("text")
    return mixing.mix(sized, targets, "doc_id", "source", "n_tokens", "quality")


@query
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents selected to the sources' target shares, with the number of times each is used."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the selection reaches."""
    return _mixed(spark, sf_dir)[1]


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with their defect, of the pairs whose reply has one."""
    pairs = replies.question_reply_pairs(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return replies.defects(written(pairs, "pairs")).where("defect is not null").select("message_id", "defect")


@query
def p3_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply to a question with its content, role and citations, and its defect, if it has one."""
    messages = table(spark, sf_dir, "messages")
    pairs = replies.question_reply_pairs(messages, table(spark, sf_dir, "conversations"))
    found = replies.defects(written(pairs, "pairs")).select("message_id", "defect")
    return messages.withColumnRenamed("id", "message_id").join(found, "message_id").select("message_id", "content", "role", "citations", "defect")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = table(spark, sf_dir, "subject_examples", ["subject", "text"]).limit(subjects.MOST_EXAMPLES + 1).collect()
    if len(examples) > subjects.MOST_EXAMPLES:
        raise ValueError(f"more than {subjects.MOST_EXAMPLES} labelled passages")
    return subjects.subjects_of(table(spark, sf_dir, "documents"), "doc_id", "text", [(r.subject, r.text) for r in examples])


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, sf_dir).select(F.col("key").alias("doc_id"), "subject")


@query
def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents that have it, and their characters."""
    chars = table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.length("text").alias("chars"))
    found = _subjects(spark, sf_dir).join(chars, F.col("key") == F.col("doc_id"))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("characters"))
