"""Chat history: lists, buckets and an append-only log with its latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import broadcast_if_small, written


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key: the one with the greatest ``by`` (null last), ties by the other columns in order."""
    rest = [c for c in rows.columns if c not in (key, by)]
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), *rest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Keys that come more than once up to which they are broadcast (some 50 bytes each).
BROADCAST_KEYS = 1_000_000


def once(rows: DataFrame, key: str, by: str) -> DataFrame:
    """``latest`` for wide rows few of which are repeated: only keys and instants are shuffled, and the keys that come more
    than once are looked up where the rows are read (broadcast up to BROADCAST_KEYS, else a join). Rows without a key stay."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key, by).agg(F.count("*").alias("_n"))
    n = n.groupBy(key).agg(F.max(F.struct(by, "_n")).alias("_l"), F.sum("_n").alias("_s")).where("_s > 1")
    again = written(n.select(key, F.col(f"_l.{by}").alias("_last"), (F.col("_l._n") > 1).alias("_tied"), F.lit(True).alias("_again")), "again")
    marked = rows.join(broadcast_if_small(again, BROADCAST_KEYS), key, "left")
    single = marked.where(F.col("_again").isNull() | (~F.col("_tied") & F.col(by).eqNullSafe(F.col("_last")))).select(*rows.columns)
    tied = again.where("_tied").select(key)
    return single if tied.isEmpty() else single.unionByName(latest(rows.join(tied, key, "left_semi"), key, by))


def owned(conversations: DataFrame, conversation: str, user: str) -> DataFrame:
    """The conversation of an id, if it belongs to the user; else no row."""
    return conversations.where((F.col("id") == conversation) & (F.col("user_id") == user))


def messages_of(messages: DataFrame, conversations: DataFrame, conversation: str, user: str) -> DataFrame:
    """The messages of a user's conversation by id, with citations and meta data where they can be read."""
    own = messages.join(owned(conversations, conversation, user).select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    return own.orderBy("id")


def appended(conversations: DataFrame, messages: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) after new messages (id, conversation_id, user_id, role, content): only those of a user to
    a conversation of theirs, by a known role and with content are taken, and their conversations are updated ``now``."""
    own = new.where(F.col("role").isin("user", "assistant") & (F.trim("content") != "")).join(conversations.select(F.col("id").alias("conversation_id"), "user_id").distinct(), ["conversation_id", "user_id"], "left_semi")
    grown = messages.unionByName(own.drop("user_id").withColumn("created_at", now.cast("string")), allowMissingColumns=True)
    touched = own.select(F.col("conversation_id").alias("id"), F.lit(True).alias("_t")).distinct()
    return conversations.join(touched, "id", "left").withColumn("updated_at", F.when(F.col("_t"), now.cast("string")).otherwise(F.col("updated_at"))).drop("_t"), grown


def recency(at: Column, now: Column) -> Column:
    """The bucket of a date as seen from ``now``; unreadable dates are older."""
    days = F.datediff(now, at)
    return F.when(at.isNull(), "Older").when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "Previous 7 days").when(days <= 30, "Previous 30 days").otherwise("Older")


def renamed(title: Column) -> Column:
    """A new title: spaces collapsed, at most 200 characters; null (refused) if blank."""
    t = F.substring(F.trim(F.regexp_replace(title, r"\s+", " ")), 1, 200)
    return F.when(t != "", t)


def replayed(conversations: DataFrame, log: DataFrame) -> DataFrame:
    """The conversations after a log of renames and deletes (id, user_id, seq, op, title), each of which only acts on a
    conversation of its user: the last rename wins, a delete removes."""
    own = log.join(conversations.select("id", "user_id"), ["id", "user_id"], "left_semi")
    gone = own.where("op = 'delete'").select("id").distinct()
    named = own.where("op = 'rename'").withColumn("t", renamed(F.col("title"))).where("t is not null").groupBy("id").agg(F.max_by("t", "seq").alias("t"))
    return conversations.join(gone, "id", "left_anti").join(named, "id", "left").withColumn("title", F.coalesce("t", "title")).drop("t")


def cascade(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The messages whose conversation is left."""
    return messages.join(conversations.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")


def owner_key(email: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(email)), F.lit("")), F.concat(F.lit("anon:"), F.coalesce(name, F.lit("unknown"))))
