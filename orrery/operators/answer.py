"""From ranked passages to a prompt, and from an answer back to its passages.

Everything a question's answer rests on is put together by columns: handles, labels, notes, the branch that refuses, and the
answer that is written without a model. The one call of a model is a function that the driver calls with the prompts of the
questions it is asked, never from a task, so that a task that runs again calls nothing again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import citation_handles, incremental_risk, passage_label

EXCERPT = 300
#: Prompts that are fetched for a call at a time.
MOST_PROMPTS = 1000
#: The headings of an answer, in order.
SECTIONS = ("Bottom line", "Findings", "Comparison", "Gaps and confidence", "Sources")

FORMAT = "Answer under the headings " + ", ".join(SECTIONS) + ". Cite each statement by the handle of its passage, as in [C1], and use the passages only."
Model = Callable[[str], str]


class NotConfigured(RuntimeError):
    """There is no model to call."""


def _listed(names: Column) -> Column:
    return F.array_join(names, ", ")


def handled(ranked: DataFrame) -> DataFrame:
    """Ranked passages (question, rank, ...) with ``handle``: C and their place in the question's list."""
    place = F.row_number().over(Window.partitionBy("question").orderBy("rank"))
    return ranked.withColumn("place", place).withColumn("handle", F.concat(F.lit("C"), F.col("place")))


def citations(ranked: DataFrame) -> DataFrame:
    """The passages as an answer cites them: handle, company, form, year, period, section, file, and an excerpt."""
    return handled(ranked).select("question", "handle", "company", "form_type", "fiscal_year", "period_end", F.col("item_section").alias("section"), "source_file", F.substring("text", 1, EXCERPT).alias("excerpt"))


def labelled(ranked: DataFrame) -> DataFrame:
    label = passage_label(*(F.col(c) for c in ("company", "ticker", "form_type", "fiscal_year", "period_end", "item_section")))
    return handled(ranked).withColumn("label", label).withColumn("incremental", incremental_risk(F.col("form_type"), F.col("item_section")))


def companies_present(ranked: DataFrame) -> DataFrame:
    """(question, companies): the distinct companies of each list, sorted."""
    return ranked.groupBy("question").agg(F.array_sort(F.collect_set("company")).alias("companies"))


def prompts(questions: DataFrame, ranked: DataFrame, plan: DataFrame, coverage: DataFrame | None = None, form: str = FORMAT) -> DataFrame:
    """(question, prompt, refuses): the passages under their handles and labels, the companies present, notes on companies
    that are not held, on coverage and on risk sections that state changes only, the question, and last how to answer. Where
    the question names companies of which none is held, it is told to say so and nothing else. ``ranked`` holds lists cut by
    rank, ``plan`` comes from the planner, ``coverage`` (question, sentence) from ``coverage.sentence``."""
    each = F.struct("place", F.concat(F.lit("["), "handle", F.lit("] "), "label", F.lit("\n"), "text").alias("t"), "handle", "incremental", F.col("company"))
    lists = labelled(ranked).groupBy("question").agg(F.array_sort(F.collect_list(each)).alias("all"))  # lists cut by rank before
    p = questions.join(lists, "question", "left").join(plan.select("question", F.col("unresolved").alias("absent"), "tickers"), "question", "left")
    if coverage is not None:
        p = p.join(coverage.select("question", "sentence"), "question", "left")
    else:
        p = p.withColumn("sentence", F.lit(None).cast("string"))
    every = F.coalesce("all", F.array().cast(lists.schema["all"].dataType))
    absent, tickers = (F.coalesce(c, F.array().cast("array<string>")) for c in ("absent", "tickers"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: x["company"]), lambda c: c.isNotNull())))
    changes = F.transform(F.filter(every, lambda x: x["incremental"]), lambda x: x["handle"])
    refuses = (F.size(absent) > 0) & (F.size(tickers) == 0)
    note = lambda when, *parts: F.when(when, F.concat(F.lit("\n\n"), *parts)).otherwise("")
    notes = F.concat(
        note(F.size(absent) > 0, F.lit("No filings are held for "), _listed(absent), F.lit("; say so, and answer for the companies that are.")),
        note(F.coalesce("sentence", F.lit("")) != "", F.lit("Coverage of these passages, not of the corpus: "), F.col("sentence")),
        note(F.size(changes) > 0, _listed(changes), F.lit(" are quarterly risk sections: they state changes since the annual report, and are not the whole of the risks.")),
    )
    present = note(F.size(names) > 0, F.lit("Companies in the passages: "), _listed(names))
    refusal = F.concat(F.lit("None of the passages is about "), _listed(absent), F.lit(f", for which no filings are held. Write {SECTIONS[0]} and {SECTIONS[3]} only: that the question cannot be answered, and what is missing. Cite nothing."))
    ask = F.concat(F.lit("\n\nQuestion: "), F.col("text"), F.lit("\n\n"))
    head = F.concat(F.lit("Passages:\n\n"), F.array_join(F.transform(every, lambda x: x["t"]), "\n\n"), present)
    return p.select("question", F.when(refuses, F.concat(head, ask, refusal)).otherwise(F.concat(head, notes, ask, F.lit(form))).alias("prompt"), refuses.alias("refuses"))


def scope_phrase(tickers: Column, lo: Column, hi: Column, form: Column) -> Column:
    """What a question narrowed its search to, in words; empty if to nothing."""
    years = F.when(lo == hi, F.concat(F.lit("fiscal year "), lo)).when(lo.isNotNull(), F.concat(F.lit("fiscal years "), lo, F.lit("–"), hi))
    return F.array_join(F.array_compact(F.array(F.nullif(F.array_join(tickers, ", "), F.lit("")), years, F.concat(form, F.lit(" filings")))), ", ")


def unmatched(plan: DataFrame, ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """(question, status, answer) of the questions of which nothing was retrieved: ``empty_index`` (to be refused as not
    ready, without an answer) where the corpus holds nothing, else ``empty_scope`` with an answer written without a model,
    that names the scope and the years that the corpus covers. ``corpus`` is a table of one row (n, first_year, last_year)."""
    p = plan.join(ranked.select("question").distinct(), "question", "left_anti").join(F.broadcast(corpus))
    scope = scope_phrase(F.col("tickers"), F.col("lo"), F.col("hi"), F.col("form_type"))
    years = F.when(F.col("first_year") == F.col("last_year"), F.concat(F.lit("fiscal year "), F.col("first_year"))).otherwise(F.concat(F.lit("fiscal years "), F.col("first_year"), F.lit("–"), F.col("last_year")))
    text = F.concat(
        F.lit(f"{SECTIONS[0]}\nNo passage matches "), F.when(scope == "", "this question").otherwise(F.concat(F.lit("what the question is limited to ("), scope, F.lit(")"))), F.lit(", so it cannot be answered here.\n\n"),
        F.lit(f"{SECTIONS[3]}\nThe corpus covers "), years, F.lit(". Nothing of another scope was put in the place of what was asked.\n\n"), F.lit(f"{SECTIONS[4]}\nNone."),
    )
    return p.select("question", F.when(F.col("n") == 0, "empty_index").otherwise("empty_scope").alias("status"), F.when(F.col("n") > 0, text).alias("answer"))


def answers(prompted: DataFrame, model: Model | None) -> DataFrame:
    """(question, answer): one call of the model for each prompt, on the driver, in order of the questions; more than
    MOST_PROMPTS questions are refused, and so is a missing model."""
    if model is None:
        raise NotConfigured("no model is configured")
    rows = prompted.select("question", "prompt").orderBy("question").limit(MOST_PROMPTS + 1).collect()
    if len(rows) > MOST_PROMPTS:
        raise ValueError(f"more than {MOST_PROMPTS} prompts")
    return prompted.sparkSession.createDataFrame([(r.question, model(r.prompt)) for r in rows], f"question {prompted.schema['question'].dataType.simpleString()}, answer string")


def checked(answered: DataFrame, cited: DataFrame) -> DataFrame:
    """(question, cited, fabricated, uncited, shown): the handles of an answer that stand for a passage, in order of first
    use, those that do not, the passages that it does not cite, and those to show: the cited ones, or all if none is. The
    answer's text is never changed. ``cited`` comes from ``citations``."""
    have = cited.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.substring("handle", 2, 9).cast("int").alias("n"), "handle"))), lambda x: x["handle"]).alias("have"))  # lists cut by rank
    a = answered.select("question", citation_handles(F.col("answer")).alias("used")).join(have, "question", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    good = F.filter("used", lambda h: F.array_contains("have", h))
    return a.select("question", good.alias("cited"), F.array_except("used", "have").alias("fabricated"), F.array_except("have", "used").alias("uncited"), F.when(F.size(good) > 0, good).otherwise(F.col("have")).alias("shown"))


def meta(ranked: DataFrame, plan: DataFrame, generated_by: DataFrame | None = None) -> DataFrame:
    """(question, meta): how a question was answered, as a record of fixed shape: the plan, the number of passages, the score
    of the first and the greatest, rounded to four places, whether they were reranked, and the model, left out where none
    was called (``generated_by``: question, model)."""
    per = ranked.groupBy("question").agg(F.count("*").alias("passages"), F.round(F.min_by("score", "rank"), 4).alias("top_score"), F.round(F.max("score"), 4).alias("max_score"), F.bool_or("reranked").alias("reranked"))
    m = plan.join(per, "question", "left")
    m = m.join(generated_by, "question", "left") if generated_by is not None else m.withColumn("model", F.lit(None).cast("string"))
    return m.select("question", F.struct("tickers", "unresolved", "lo", "hi", "form_type", F.coalesce("passages", F.lit(0)).alias("passages"), "top_score", "max_score", F.coalesce("reranked", F.lit(False)).alias("reranked"), "model").alias("meta"))


def template(system: str, sample: str) -> str:
    """A page that shows the instructions and a sample prompt, for readers."""
    return f"# Prompt\n\n## Instructions\n\n{system}\n\n## A prompt\n\n```text\n{sample}\n```\n"
