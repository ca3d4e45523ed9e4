"""Names and scopes of questions."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import capitalised_runs, form_hint, normalised_name, year_window
from orrery.session import broadcast_if_small, written

#: Shortest full alias that is not a ticker as written, least ratio and greatest difference of lengths of a near miss, and
#: the shortest alias that can be one.
SHORT, CUTOFF, SLACK, FUZZY = 2, 0.85, 1, 5
# Words of names that identify no company by themselves.
DESCRIPTORS = (
    "advanced america american bank business com communications devices electric express general global group holdings home "
    "industries international machines micro motors national of parcel platforms scientific service services stores systems "
    "technologies united wholesale"
).split()
# Names in use that no rule derives from the legal name; those of companies not held are dropped.
COLLOQUIAL = {
    "coke": "KO", "amex": "AXP", "p g": "PG", "j j": "JNJ", "raytheon": "RTX", "google": "GOOG", "facebook": "META", "exxonmobil": "XOM", "jp morgan": "JPM", "unitedhealthcare": "UNH",
}
#: Aliases up to which the table is broadcast (some 60 bytes each).
BROADCAST_ALIASES = 200_000
# Capitalised words of filings and of questions that are no names.
VOCABULARY = (
    "risk risks factors item items part form annual quarterly report reports filing filings management discussion analysis "
    "legal proceedings business financial statements compare compared china india japan korea taiwan vietnam europe america "
    "american united states federal reserve congress sec gaap act section chips basel cecl covid ai esg january february march "
    "april may june july august september october november december what how which why when where who whose whom comparing "
    "summarise summarize describe explain list tell does do did is are was were has have had please give show over since about "
    "their they them this that these those recent primary major each both"
).split()


def ticker_names(filings: DataFrame) -> DataFrame:
    """(ticker, company, first_file): the first name of each ticker by file."""
    own = filings.where("coalesce(ticker, '') <> '' and coalesce(company, '') <> ''")
    return own.groupBy("ticker").agg(F.min_by("company", "source_file").alias("company"), F.min("source_file").alias("first_file"))


def distinctive_words(names: DataFrame) -> DataFrame:
    """(word, ticker): words of three letters or more of names of several words that stand in the names of exactly one ticker
    and are no descriptors."""
    each = names.select("ticker", F.array_distinct(F.filter(F.split(normalised_name(F.col("company")), " +"), lambda w: w != "")).alias("w"), F.size(F.filter(F.split(normalised_name(F.col("company")), " +"), lambda w: w != "")).alias("n"))
    each = each.where("n > 1").select("ticker", F.explode("w").alias("word")).where((F.length("word") > SHORT) & ~F.col("word").isin(DESCRIPTORS))
    return each.groupBy("word").agg(F.countDistinct("ticker").alias("n"), F.min("ticker").alias("ticker")).where("n = 1").select("word", "ticker")


def alias_dictionary(names: DataFrame, colloquial: dict[str, str] | None = None) -> DataFrame:
    """(alias, ticker, kind): tickers before full names (of companies in order of their files) before distinctive words before
    colloquial names of companies that are held."""
    spark = names.sparkSession
    t = names.select(normalised_name(F.col("ticker")).alias("alias"), "ticker", F.lit("ticker").alias("kind"), F.lit(0).alias("p"), "first_file")
    full = names.select(normalised_name(F.col("company")).alias("alias"), "ticker", F.lit("name").alias("kind"), F.lit(1).alias("p"), "first_file")
    word = distinctive_words(names).select(F.col("word").alias("alias"), "ticker", F.lit("word").alias("kind"), F.lit(2).alias("p"), F.lit("").alias("first_file"))
    own = spark.createDataFrame(list((COLLOQUIAL if colloquial is None else colloquial).items()) or [("", "")], "alias string, ticker string")
    own = own.join(names.select("ticker"), "ticker", "left_semi").select("alias", "ticker", F.lit("colloquial").alias("kind"), F.lit(3).alias("p"), F.lit("").alias("first_file"))
    every = t.unionAll(full).unionAll(word).unionAll(own).where("alias <> ''")
    w = Window.partitionBy("alias").orderBy("p", "first_file", "ticker")
    return every.withColumn("n", F.row_number().over(w)).where("n = 1").select("alias", "ticker", "kind")


def _matched_spans(runs: DataFrame, aliases: DataFrame, fuzzy: bool) -> DataFrame:
    """(run_id, i, end, ticker): for each word of each run the longest span from it that is an alias, of spans of any length;
    where there is none, and with ``fuzzy``, the longest that nearly is one. Spans of two characters count as tickers only,
    as written."""
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(i, F.size("w")), lambda e: F.struct(i.alias("i"), e.alias("end"), F.array_join(F.slice("w", i, e - i + 1), " ").alias("span")))))
    s = runs.select("run_id", F.explode(spans).alias("s")).select("run_id", "s.*").withColumn("alias", normalised_name(F.col("span")))
    tickers = broadcast_if_small(aliases.where("kind = 'ticker'").select(F.col("ticker").alias("span"), "ticker"), BROADCAST_ALIASES)
    known = broadcast_if_small(aliases.select("alias", "ticker"), BROADCAST_ALIASES)
    hit = s.where(F.length("span") > SHORT).join(known, "alias").select("run_id", "i", "end", "ticker", F.lit(1).alias("exact"))
    hit = hit.unionByName(s.where(F.length("span") <= SHORT).join(tickers, "span").select("run_id", "i", "end", "ticker", F.lit(1).alias("exact")))
    if fuzzy:
        open_ = s.where((F.length("span") > SHORT) & (F.length("alias") >= FUZZY) & ~F.col("alias").isin(VOCABULARY))
        near = written(near_miss(open_, "alias", aliases).select(F.col("word").alias("alias"), "ticker"), "near")
        hit = hit.unionByName(open_.join(broadcast_if_small(near, BROADCAST_ALIASES), "alias").select("run_id", "i", "end", "ticker", F.lit(0).alias("exact")))
    return hit.groupBy("run_id", "i").agg(F.max(F.struct("exact", "end", "ticker")).alias("m")).select("run_id", "i", "m.end", "m.ticker")


def plans(questions: DataFrame, question: str, text: str, aliases: DataFrame, latest: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(question, tickers, unresolved, lo, hi, form_type): what each question asks for. Each run of capitalised words is read
    from left to right by the longest span that names a company; ``tickers`` are distinct, in order of mention, and
    ``unresolved`` are the other names: words in a row that are no vocabulary, single descriptors left out. ``latest`` is a
    table of one row and column, the latest fiscal year of the corpus. Runs are told apart by question and place, so neither
    a question nor a run is ever split, and all is built-in expressions but the ratio of near misses."""
    q = questions.select(F.col(question).alias("question"), F.col(text).alias("text"))
    words = lambda r: F.filter(F.split(r, r"\s+"), lambda w: w != "")
    runs = q.select("question", F.posexplode(capitalised_runs(F.col("text"))).alias("at", "run")).select("question", "at", words(F.col("run")).alias("w")).withColumn("run_id", F.struct("question", "at"))
    runs = written(runs.where(F.size("w") > 0), "runs")
    spans = _matched_spans(runs, written(aliases, "aliases"), fuzzy).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("end", "ticker").alias("m")))).alias("m"))
    runs = runs.join(spans, "run_id", "left")
    # The fold over the words of a run: the word read next, the tickers, the names, and the words of a name being read.
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("t"), F.array().cast("array<string>").alias("u"), F.array().cast("array<string>").alias("p"))
    closed = lambda s: F.when((F.size(s["p"]) == 0) | ((F.size(s["p"]) == 1) & normalised_name(s["p"][0]).isin(DESCRIPTORS)), s["u"]).otherwise(F.concat(s["u"], F.array(F.array_join(s["p"], " "))))
    state = lambda n, t, u, p: F.struct(n.alias("next"), t.alias("t"), u.alias("u"), p.alias("p"))
    none = F.array().cast("array<string>")

    def read(s: Column, x: Column) -> Column:
        m, w = x["m"], x["w"]
        ordinary = normalised_name(w).isin(VOCABULARY) | F.lower(w).isin("and", "the") | (F.length(w) <= SHORT)
        return (
            F.when(x["i"] < s["next"], s)
            .when(m.isNotNull(), state(m["end"] + 1, F.concat(s["t"], F.array(m["ticker"])), closed(s), none))
            .when(ordinary, state(x["i"] + 1, s["t"], closed(s), none))
            .otherwise(state(x["i"] + 1, s["t"], s["u"], F.concat(s["p"], F.array(w))))
        )

    at = F.transform("w", lambda w, i: F.struct((i + 1).alias("i"), w.alias("w"), F.try_element_at("m", i + 1).alias("m")))
    runs = runs.withColumn("r", F.aggregate(at, start, read, lambda s: F.struct(s["t"].alias("t"), closed(s).alias("u"))))
    both = runs.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("all"))  # the runs of one question
    each = lambda f: F.array_distinct(F.flatten(F.transform("all", lambda x: x["r"][f])))
    found = both.select("question", each("t").alias("tickers"), each("u").alias("unresolved"))
    plan = q.join(F.broadcast(latest.toDF("_latest"))).select("question", year_window(F.col("text"), F.col("_latest")).alias("y"), form_hint(F.col("text")).alias("form_type"))
    empty = F.array().cast("array<string>")
    return plan.join(found, "question", "left").select("question", F.coalesce("tickers", empty).alias("tickers"), F.coalesce("unresolved", empty).alias("unresolved"), "y.lo", "y.hi", "form_type")


def mentioned(plan: DataFrame) -> DataFrame:
    """(question, ticker, mention) of plans: a row for each company, in order of mention."""
    return plan.select("question", F.posexplode("tickers").alias("at", "ticker")).select("question", "ticker", (F.col("at") + 1).alias("mention"))


def resolved(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """(name, ticker): the company of each distinct name: by its exact alias, else by the nearest; null if there is none."""
    n = names.select(F.col(name).alias("name")).distinct().withColumn("alias", normalised_name(F.col("name")))
    exact = n.join(aliases.select("alias", "ticker"), "alias", "left")
    near = near_miss(exact.where("ticker is null"), "alias", aliases).select(F.col("word").alias("alias"), F.col("ticker").alias("near"))
    return exact.join(near, "alias", "left").select("name", F.coalesce("ticker", "near").alias("ticker"))


def near_miss(words: DataFrame, word: str, aliases: DataFrame) -> DataFrame:
    """(word, alias, ticker): the most similar alias (ratio of matching blocks of 0.85 or more) of each word of five letters
    or more, of lengths at most one apart, ties to the greater alias. Only pairs that share a run of two letters are
    compared; words so similar, of five letters or more, always do."""

    def grams(c: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2))))

    a = aliases.where(F.length("alias") >= FUZZY).select("alias", "ticker", F.explode(grams("alias")).alias("g"))
    w = words.select(F.col(word).alias("word")).distinct().where(F.length("word") >= FUZZY).select("word", F.explode(grams("word")).alias("g"))
    pairs = w.join(broadcast_if_small(a, 10 * BROADCAST_ALIASES), "g").where(F.abs(F.length("word") - F.length("alias")) <= SLACK).select("word", "alias", "ticker").distinct()

    @F.pandas_udf("double")
    def ratio(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in it:
            yield pd.Series([difflib.SequenceMatcher(None, q, p).ratio() for p, q in zip(x, y)])

    best = pairs.withColumn("ratio", ratio("word", "alias")).where(F.col("ratio") >= CUTOFF)
    return best.groupBy("word").agg(F.max_by(F.struct("alias", "ticker"), F.struct("ratio", "alias")).alias("b")).select("word", "b.*")
