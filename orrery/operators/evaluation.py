"""Scores of ranked lists against labelled sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import written


def scores(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20), rank_k: int = 10) -> DataFrame:
    """One row for each labelled question: recall and attainable recall at each of ``ks``, reciprocal rank and nDCG at
    ``rank_k``, over the distinct files of the first k rows. ``ranked`` (question, file, rank), ``relevant`` (question,
    file). The ideal gain counts min(relevant files, files retrieved) places."""
    rel = relevant.select("question", "file").distinct()
    n = rel.groupBy("question").agg(F.count("*").alias("n_relevant"))
    most = max(*ks, rank_k)
    files = ranked.where(F.col("rank") <= most).groupBy("question", "file").agg(F.min("rank").alias("first"))
    hit = files.join(rel.withColumn("hit", F.lit(1)), ["question", "file"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    hit = hit.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("first")))
    inside = F.col("first") <= rank_k
    gain = F.when(inside, F.col("hit") / F.log2(F.col("place") + 1)).otherwise(0.0)
    found = [F.sum(F.when(F.col("first") <= k, F.col("hit")).otherwise(0)).alias(f"hits_{k}") for k in ks]
    per = hit.groupBy("question").agg(*found, F.sum(gain).alias("dcg"), F.min(F.when(inside & (F.col("hit") == 1), F.col("place"))).alias("first_hit"), F.sum(inside.cast("int")).alias("n_files"))
    out = n.join(per, "question", "left").na.fill(0, [f"hits_{k}" for k in ks] + ["n_files"]).na.fill(0.0, ["dcg"])
    places = F.least("n_relevant", F.greatest("n_files", F.lit(1)))
    ideal = F.aggregate(F.sequence(F.lit(1), places.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    cols = [F.round(F.col(f"hits_{k}") / F.col("n_relevant"), 6).alias(f"recall_{k}") for k in ks] + [F.round(F.col(f"hits_{k}") / F.least(F.lit(k), F.col("n_relevant")), 6).alias(f"attainable_recall_{k}") for k in ks]
    return out.select("question", "n_relevant", *cols, F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def entity_coverage(ranked: DataFrame, named: DataFrame, k: int = 10) -> DataFrame:
    """(question, coverage): the share of a question's named entities met in the first ``k`` rows; null if none is named.
    ``named`` (question, entities ARRAY), ``ranked`` (question, entity, rank)."""
    met = ranked.where(F.col("rank") <= k).groupBy("question").agg(F.collect_set("entity").alias("met"))  # k values at most
    c = F.size(F.array_intersect(F.array_distinct("entities"), F.coalesce("met", F.array().cast("array<string>")))) / F.size(F.array_distinct("entities"))
    return named.join(met, "question", "left").select("question", F.when(F.size("entities") > 0, F.round(c, 6)).alias("coverage"))


def means(per_question: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Means, to four places, overall (category null; a row even of nothing) and by category, with the number of questions that
    have a value. The questions' rows, a few numbers each, are written and read for either grouping."""
    per = written(per_question.select(category, *metrics), "scores")
    cols = [c for m in metrics for c in (F.round(F.avg(m), 4).alias(m), F.count(m).alias(f"n_{m}"))]
    overall = per.agg(*cols).withColumn(category, F.lit(None).cast(per.schema[category].dataType))
    return per.groupBy(category).agg(*cols).unionByName(overall)


def suspect(recall: Column, relevant: Column, files: Column, k: int = 10) -> Column:
    """What looks wrong about a question of which nothing labelled was found: a label much broader than the list, or the
    search itself; empty where something was found."""
    broad = F.concat(F.lit("the label names "), relevant, F.lit(" files, but "), files, F.lit(f" distinct files stand in the first {k}: its breadth is suspect"))
    return F.when(recall > 0, "").when((files > 0) & (relevant > 2 * files), broad).otherwise("no labelled file was found: the search or the probe is suspect")


def config_label(base: str, was_reranked: bool) -> str:
    return f"{base}+rerank" if was_reranked else base


def answerable(questions: DataFrame) -> DataFrame:
    return questions.where("category <> 'unanswerable'")


def by_category(questions: DataFrame, category: str) -> DataFrame:
    return questions.where(F.col("category") == category)


COVERAGE_KS = (10, 20)


def run(questions: DataFrame, ranked: DataFrame, config: str, at: Column, k: int = 20, derived: DataFrame | None = None) -> DataFrame:
    """One row, the document of an evaluation: config, k, generated_at, n_scored, n_unanswerable, unanswerable_ids, overall,
    by_category and per_question. ``questions`` (id, category, tickers, source_files, expect_fiscal_years) is a golden set,
    ``ranked`` (question, file, ticker, rank) what was retrieved; ``derived`` (question, lo, hi), the years that a planner
    reads, tells whether they are the years expected. A golden set is a table written by hand; its rows are one document."""
    q = answerable(questions).select(F.col("id").alias("question"), "category", "tickers", "source_files", "expect_fiscal_years")
    r = ranked.where(F.col("rank") <= k)
    per = q.join(scores(r, q.select("question", F.explode("source_files").alias("file"))), "question", "left")
    per = per.join(r.groupBy("question").agg(F.countDistinct("file").alias("n_files_retrieved")), "question", "left")
    entities = q.select("question", F.col("tickers").alias("entities"))
    for c in COVERAGE_KS:
        per = per.join(entity_coverage(r.withColumnRenamed("ticker", "entity"), entities, c).withColumnRenamed("coverage", f"entity_coverage_{c}"), "question", "left")
    if derived is not None:
        per = per.join(derived.select("question", F.array("lo", "hi").alias("_years")), "question", "left")
        per = per.withColumn("parser_window_agrees", F.when(F.size("expect_fiscal_years") > 0, F.coalesce(F.col("_years") == F.col("expect_fiscal_years"), F.lit(False))))
    else:
        per = per.withColumn("parser_window_agrees", F.lit(None).cast("boolean"))
    ranks = [f"{m}_{c}" for m in ("recall", "attainable_recall") for c in (5, 10, 20)] + ["mrr", "ndcg"]
    per = per.na.fill(0, ["n_relevant", "n_files_retrieved"]).na.fill(0.0, ranks)
    metrics = [*ranks, *(f"entity_coverage_{c}" for c in COVERAGE_KS)]
    per = per.withColumn("suspect", suspect(F.col("recall_10"), F.col("n_relevant"), F.col("n_files_retrieved")))
    groups = means(per, "category", metrics).select("category", F.struct(*metrics, *(f"n_{m}" for m in metrics)).alias("m"))  # of values that are not rounded to four places yet
    per = per.select("question", "category", *(F.round(m, 4).alias(m) for m in metrics), "n_relevant", "n_files_retrieved", "parser_window_agrees", "suspect")
    doc = groups.agg(F.max(F.when(F.col("category").isNull(), F.col("m"))).alias("overall"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "m"))))).alias("by_category"))
    rows = per.agg(F.count("*").cast("int").alias("n_scored"), F.array_sort(F.collect_list(F.struct(*per.columns))).alias("per_question"))
    left = questions.where("category = 'unanswerable'").agg(F.count("*").cast("int").alias("n_unanswerable"), F.array_sort(F.collect_list("id")).alias("unanswerable_ids"))
    head = F.lit(config).alias("config"), F.lit(k).alias("k"), at.alias("generated_at")
    return rows.join(F.broadcast(doc)).join(F.broadcast(left)).select(*head, "n_scored", "n_unanswerable", "unanswerable_ids", "overall", "by_category", "per_question")


def labels(files: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, source_file): the files (source_file, ticker, fiscal_year, text) that the probe of a question (id, probe, tickers,
    lo, hi) labels: those that hold it, whatever the case, and are of its tickers and years where these are given. The
    table of probes is written by hand, and is broadcast; more than 10,000 are refused."""
    if probes.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 probes")
    p = F.broadcast(probes.select("id", F.lower("probe").alias("probe"), "tickers", "lo", "hi"))
    fits = F.contains(F.lower("text"), F.col("probe")) & (F.coalesce(F.size("tickers"), F.lit(0)).isin(0, -1) | F.array_contains("tickers", F.col("ticker"))) & (F.col("lo").isNull() | F.col("fiscal_year").between(F.col("lo"), F.col("hi")))
    return files.join(p, fits).select("id", "source_file").distinct()


def labelled(questions: DataFrame, found: DataFrame) -> DataFrame:
    """A golden set with the files that its probes found; a question with a probe that found none is refused."""
    own = found.groupBy("id").agg(F.array_sort(F.collect_set("source_file")).alias("source_files"))  # the label of one question
    out = questions.drop("source_files").join(own, "id", "left")
    if gone := [r.id for r in out.where("coalesce(probe, '') <> '' and source_files is null").select("id").limit(20).collect()]:
        raise ValueError(f"probes that match nothing: {', '.join(sorted(gone))}")
    return out.withColumn("source_files", F.coalesce("source_files", F.array().cast("array<string>")))
