"""Problem 2: conversations rebuilt from message rows.

Rows are read into one form (id, speaker, instant), repeated rows are dropped, and every message is linked to its likeliest
parent among the messages before it in its channel, by time, shared names and shared words. Links form trees: a message
without a candidate, or whose best link scores under ``LEAST_LINK``, is a root. Trees are what a channel in which several
conversations run at once falls apart into (``threads``). Where the channel is a conversation's id, the trees of a channel are
one conversation; each message belongs to the conversation of its tree's root, and turns are in order of instants and ids.

Defined results: a row without a readable id belongs to no conversation; null content is empty content; a conversation with
an unreadable role or time is broken; repeated rows count once under the smallest id; ties in time go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.ordering import PART, numbered, partitioned, with_border_rows
from orrery.session import written

# The names under which the two speakers are stored.
USER_ROLES = ("user", "human", "customer", "client", "person", "asker", "prompter")
ASSISTANT_ROLES = ("assistant", "model", "bot", "ai", "chatbot", "gpt", "machine")
#: Blank and invisible characters, for character sets of Java's regular expressions.
UNSEEN = r"\s\p{Z}\p{Cf}\p{Cc}͏ᅟᅠ឴឵⠀ㅤﾠ︀-️᠋-᠏"
#: What a link's score gains at most by another speaker, by shared names and by shared words, and what it loses for each
#: message between.
OTHER_SPEAKER, NAMES, WORDS, STEP = 2.0, 2.0, 1.0, 0.5
#: Messages before one that can be its parent. No other can: the one directly before it scores 0 less its time at least, one
#: that is n back scores the greatest gain less n - 1 steps and no less time.
LOOKBACK = int((OTHER_SPEAKER + NAMES + WORDS) / STEP)
#: Score of its best link from which on a message belongs to the tree of its parent: an answer soon after, or much in common.
LEAST_LINK = 1.0
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def conversation_key(c: Column) -> Column:
    """An id without surrounding blanks and braces, in lower case; null if nothing is left."""
    key = F.lower(F.regexp_replace(c, r"^[\s\p{Z}{}]+|[\s\p{Z}{}]+$", ""))
    return F.when(key != "", key)


def speaker(role: Column) -> Column:
    r = F.lower(F.regexp_replace(role, _BLANKS, ""))
    return F.when(r.isin(*USER_ROLES), "user").when(r.isin(*ASSISTANT_ROLES), "assistant")


def instant(c: Column) -> Column:
    """The instant of a written time: ISO 8601, extended or basic, with any zone (UTC where none is written), or seconds,
    milliseconds or microseconds since 1970; null if it is none of these."""
    s = F.regexp_replace(c, _BLANKS, "")
    iso = r"^(\d{4})-?(\d\d)-?(\d\d)[Tt _]+(\d\d):?(\d\d)(?::?(\d\d)(?:[.,](\d{1,9}))?)?\s*([Zz]|UTC|GMT|[+-]\d\d(?::?\d\d)?)?$"
    part = lambda i: F.regexp_extract(s, iso, i)
    zone = F.upper(part(8))
    offset = F.when(zone.isin("", "Z", "UTC", "GMT"), "Z").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(zone, 4, 3), ":", ""), 2, "0")))
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00")), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"), offset)
    n = s.try_cast("decimal(20,0)").try_cast("long")
    epoch = F.when(F.length(s) >= 15, F.timestamp_micros(n)).when(F.length(s) >= 12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
    return F.when(s.rlike(r"^\d{9,17}$"), epoch).when(s.rlike(iso), text.try_cast("timestamp"))


def visible(content: Column) -> Column:
    return F.coalesce(content.rlike(f"[^{UNSEEN}]"), F.lit(False))


def turns(messages: DataFrame, conversations: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """The distinct messages of known conversations: (conversation_id, message_id, speaker, instant, visible, broken, and
    the columns ``extra`` of the message); ``broken``: some role or time of the conversation can't be read. Contents stay
    behind: they are told apart by a hash and their length."""
    extra = extra or {}
    known = conversations.select(F.col("id").alias("conversation_id"), conversation_key(F.col("id")).alias("_key")).where("_key is not null").groupBy("_key").agg(F.min("conversation_id").alias("conversation_id"))
    content = F.coalesce(F.regexp_replace("content", _BLANKS, ""), F.lit(""))
    m = messages.select(
        conversation_key(F.col("conversation_id")).alias("_key"), F.col("id").alias("message_id"), speaker(F.col("role")).alias("speaker"), instant(F.col("created_at")).alias("instant"),
        visible(F.col("content")).alias("visible"), F.xxhash64(content, F.length(content)).alias("_same"), *(c.alias(k) for k, c in extra.items()),
    ).where("_key is not null and message_id is not null")
    m = m.join(known, "_key").drop("_key")
    bad = (F.col("speaker").isNull() | F.col("instant").isNull()).cast("int")
    first = m.groupBy("conversation_id", "speaker", "instant", "_same").agg(F.min_by(F.struct("visible", *extra), "message_id").alias("_row"), F.min("message_id").alias("message_id"))
    broken = m.groupBy("conversation_id").agg(F.max(bad).alias("_broken")).where("_broken = 1")
    first = first.select("conversation_id", "message_id", "speaker", "instant", "_row.*")
    return first.join(broken.select("conversation_id", F.lit(True).alias("broken")), "conversation_id", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))


def words(content: Column) -> Column:
    """Hashes of the distinct words of four or more letters, in lower case: what two messages can share."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(content), F.lit(r"\p{L}{4,}"), F.lit(0)), lambda w: F.hash(w)))


def names(content: Column) -> Column:
    """Hashes of the distinct capitalised words: what a message mentions."""
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(r"\p{Lu}\p{L}{3,}"), F.lit(0)), lambda w: F.hash(w)))


def linked(t: DataFrame, channel: str = "conversation_id") -> DataFrame:
    """``t`` (message_id, speaker, instant, ``_words``, ``_names`` and others) in order of its channel: with ``turn`` from 1,
    ``parent_id``, the likeliest parent (null for a root), ``link_score``, the score of the best candidate, and
    ``previous_speaker``, of the message before. Words and names don't come out."""
    group, order = [channel], ["instant", "message_id"]
    parts = partitioned(t, group, order)
    seen = with_border_rows(parts, group, order, LOOKBACK)
    w = Window.partitionBy(PART).orderBy(*group, *order)
    row = F.struct(channel, "message_id", "speaker", "instant", "_words", "_names")
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    seen = seen.withColumn("_before", F.collect_list(row).over(w.rowsBetween(-LOOKBACK, -1)))  # LOOKBACK rows at most, nearest last

    def score(c: Column, i: Column) -> Column:
        back = F.size("_before") - i
        minutes = (F.unix_micros("instant") - F.unix_micros(c["instant"])) / 6e7
        gain = F.when(c["speaker"] != F.col("speaker"), OTHER_SPEAKER).otherwise(0.0) + NAMES * share(c["_names"], F.col("_names")) + WORDS * share(c["_words"], F.col("_words"))
        value = gain - F.log1p(F.greatest(minutes, F.lit(0.0))) / 2 - STEP * (back - 1)
        return F.when(c[channel] == F.col(channel), F.struct(value.alias("score"), (-back).alias("near"), c["message_id"].alias("id")))

    best = F.array_max(F.transform("_before", score))
    last = F.try_element_at("_before", F.lit(-1))
    before = F.when(last[channel] == F.col(channel), last["speaker"])
    out = seen.withColumn("_best", best).withColumn("previous_speaker", before).where("not _ghost").drop("_before", "_ghost", "_words", "_names")
    out = out.withColumn("parent_id", F.when(F.col("_best.score") >= LEAST_LINK, F.col("_best.id"))).withColumn("link_score", F.col("_best.score")).drop("_best")
    return numbered(out, group, order, "turn").drop(PART)


def roots(links: DataFrame) -> DataFrame:
    """(message_id, tree_id): the root of each message's tree, from (message_id, parent_id), null for roots. Every message that
    is not at its root yet jumps to where its ancestor stands, so the distance halves each round; only ids are shuffled."""
    now = written(links.select("message_id", F.coalesce("parent_id", "message_id").alias("tree_id")), "trees")
    while True:
        up = now.select(F.col("message_id").alias("tree_id"), F.col("tree_id").alias("_up"))
        new = written(now.join(up, "tree_id").select("message_id", F.col("_up").alias("tree_id"), (F.col("tree_id") != F.col("_up")).alias("_moved")), "trees")
        now = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return now


def threads(messages: DataFrame, channel: str) -> DataFrame:
    """(channel, tree_id, position, message_id, parent_id): the conversations that a channel of interleaved messages (channel,
    message_id, speaker, instant, content) falls apart into, each a tree of links, its messages in order of time."""
    t = messages.select(channel, "message_id", "speaker", "instant", words(F.coalesce("content", F.lit(""))).alias("_words"), names(F.coalesce("content", F.lit(""))).alias("_names"))
    t = written(linked(t.where(F.col(channel).isNotNull()), channel), "linked")
    out = t.join(roots(t), "message_id")
    group, order = [channel, "tree_id"], ["instant", "message_id"]
    return numbered(partitioned(out, group, order), group, order, "position").select(channel, "tree_id", "position", "message_id", "parent_id")


def conversations_in_order(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, turn, message_id, speaker, parent_id, link_score, tree_id): the turns of the conversations that are
    whole: known, readable, with something to see in every content, and user and assistant in turn, from a user's message
    to an assistant's."""
    told = {"_words": words(F.coalesce("content", F.lit(""))), "_names": names(F.coalesce("content", F.lit("")))}
    t = written(linked(turns(messages, conversations, told).where("not broken")), "linked")
    tree = roots(t)
    of_root = t.where("parent_id is null").select(F.col("message_id").alias("tree_id"), "conversation_id")  # roots alone tell of a conversation
    t = t.drop("conversation_id").join(tree.join(of_root, "tree_id"), "message_id")
    wrong = ~F.col("visible") | (F.col("speaker") == F.coalesce("previous_speaker", F.lit("assistant")))
    fit = t.groupBy("conversation_id").agg(F.max(wrong.cast("int")).alias("_wrong"), F.count("*").alias("_n")).where("_wrong = 0 and _n % 2 = 0")
    return t.join(fit.select("conversation_id"), "conversation_id").select("conversation_id", F.col("turn").cast("int").alias("turn"), "message_id", "speaker", "parent_id", "link_score", "tree_id")
