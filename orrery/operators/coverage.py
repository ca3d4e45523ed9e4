"""What a ranked list covers of a corpus of filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def census(filings: DataFrame) -> DataFrame:
    """(ticker, filings_in_corpus), blank tickers left out."""
    return filings.where("coalesce(ticker, '') <> ''").groupBy("ticker").agg(F.count("*").alias("filings_in_corpus"))


def by_company(ranked: DataFrame, filings: DataFrame) -> DataFrame:
    """For each question and ticker: passages, distinct filings retrieved, periods, first company name, filings in the corpus
    (as many as retrieved where the corpus has none) and whether the answer rests on one filing."""
    r = ranked.withColumn("ticker", F.when(F.coalesce("ticker", F.lit("")) == "", "?").otherwise(F.col("ticker")))
    per = r.groupBy("question", "ticker").agg(
        F.min_by("company", "rank").alias("company"), F.count("*").alias("passages"), F.countDistinct("source_file").alias("filings_retrieved"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("period_end") != "", F.col("period_end")))), ",").alias("periods"),
    )
    per = per.join(census(filings), "ticker", "left").withColumn("filings_in_corpus", F.coalesce("filings_in_corpus", "filings_retrieved"))
    return per.withColumn("thin", F.col("filings_in_corpus") <= 1)


def absent(named: DataFrame, covered: DataFrame, filings: DataFrame) -> DataFrame:
    """(question, ticker): named tickers of the corpus of which nothing was retrieved."""
    return named.join(covered.select("question", "ticker").distinct(), ["question", "ticker"], "left_anti").join(census(filings).select("ticker"), "ticker", "left_semi").select("question", "ticker").distinct()


def _listed(names: Column) -> Column:
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def sentence(covered: DataFrame, missing: DataFrame) -> DataFrame:
    """(question, sentence): the coverage in words, most filings first."""
    order = F.struct((-F.col("filings_retrieved")).alias("a"), (-F.col("passages")).alias("b"), "ticker")
    item = F.concat(F.col("ticker"), F.lit(" ("), F.col("filings_retrieved"), F.lit(" of "), F.col("filings_in_corpus"), F.lit(" filings)"))
    per = covered.groupBy("question").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("s")))), lambda x: x["s"]).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("thin"), F.col("ticker")))).alias("thin"),
    )
    gone = missing.groupBy("question").agg(F.array_sort(F.collect_list("ticker")).alias("gone"))
    out = per.join(gone, "question", "left")
    thin = F.when(F.size("thin") > 0, F.concat(F.lit(" Only one filing is held for "), _listed(F.col("thin")), F.lit("."))).otherwise("")
    miss = F.when(F.size("gone") > 0, F.concat(F.lit(" Nothing was retrieved for "), _listed(F.col("gone")), F.lit("."))).otherwise("")
    return out.select("question", F.concat(F.lit("Evidence comes from "), _listed(F.col("all")), F.lit("."), thin, miss).alias("sentence"))
