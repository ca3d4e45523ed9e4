"""Evaluation runs compared, and the figures of a written summary checked against them.

Runs are rows (config, file, generated_at, metrics MAP<STRING, DOUBLE>, by_category MAP<STRING, MAP<STRING, DOUBLE>>,
n_scored, n_unanswerable, per_question ARRAY<STRUCT<id, suspect>>), a few for each experiment. Figures are compared as they
are written, so their forms are those of Python's formatting, made in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import figures

FIGURE = r"\d+(?:\.\d+)?%?"


def newest_per_config(runs: DataFrame) -> DataFrame:
    """The latest run of each config, with ``first_seen``, the time of its first; in order of that, as ``place``."""
    w = Window.partitionBy("config").orderBy(F.desc("generated_at"), F.desc("file"))
    last = runs.withColumn("_n", F.row_number().over(w)).withColumn("first_seen", F.min("generated_at").over(Window.partitionBy("config"))).where("_n = 1").drop("_n")
    return last.withColumn("place", F.row_number().over(Window.orderBy("first_seen", "config")))  # a row a config


def flagged(questions: DataFrame) -> DataFrame:
    """The questions whose score looks wrong."""
    return questions.where("coalesce(suspect, '') <> ''")


def counts(runs: DataFrame) -> DataFrame:
    """One row: files of results, distinct configs, and questions flagged in the latest run of each."""
    last = newest_per_config(runs).agg(F.coalesce(F.sum(F.size(F.filter("per_question", lambda q: F.coalesce(q["suspect"], F.lit("")) != ""))), F.lit(0)).alias("n_flagged"))
    return runs.agg(F.countDistinct("file").alias("n_result_files"), F.countDistinct("config").alias("n_configurations")).join(F.broadcast(last))


def deltas(newest: DataFrame) -> DataFrame:
    """(metric, baseline_config, latest_config, baseline, latest, delta): the metrics of the config tried last less those of the
    one tried first, to four places; null where either lacks one. Nothing comes of a single config."""
    ends = newest.agg(F.min_by(F.struct("config", "metrics"), "place").alias("a"), F.max_by(F.struct("config", "metrics"), "place").alias("b"), F.count("*").alias("n")).where("n > 1")
    keys = ends.select("a", "b", F.explode(F.array_distinct(F.concat(F.map_keys("a.metrics"), F.map_keys("b.metrics")))).alias("metric"))
    get = lambda side: F.try_element_at(F.col(f"{side}.metrics"), F.col("metric"))
    return keys.select("metric", F.col("a.config").alias("baseline_config"), F.col("b.config").alias("latest_config"), get("a").alias("baseline"), get("b").alias("latest"), F.round(get("b") - get("a"), 4).alias("delta"))


def payload(runs: DataFrame) -> dict:
    """What a summary may draw on: counts, the newest run of each config, the comparison of the last with the first. A few
    rows, one a config."""
    newest = newest_per_config(runs)
    rows, n = newest.orderBy("place").collect(), counts(runs).first()
    configs = [
        {
            "config": r.config, "file": r.file, "first_run_at": r.first_seen, "latest_run_at": r.generated_at, "n_questions_scored": r.n_scored, "n_unanswerable_excluded": r.n_unanswerable, "metrics": r.metrics, "by_category": r.by_category,
            "n_flagged_questions": sum(bool(q.suspect) for q in r.per_question or []), "flagged_questions": [{"id": q.id, "suspect": q.suspect} for q in r.per_question or [] if q.suspect],
        } for r in rows
    ]
    out = {"n_result_files": n.n_result_files, "n_configurations": n.n_configurations, "configurations": configs}
    if len(configs) > 1:
        d = deltas(newest).collect()
        out["comparison"] = {"baseline_config": configs[0]["config"], "latest_config": configs[-1]["config"], "deltas": {r.metric: r.delta for r in d}}
    return out


def numeral_forms(value: float | int) -> set[str]:
    """The ways a number may be written: as it is and with no to four places; of a negative one also its size; of a fraction
    of one also its percentage, with no to two places, with and without the sign."""
    out = set()
    for v in {value, abs(value)}:
        out |= {str(v), *(f"{v:.{n}f}" for n in range(5))}
        if isinstance(v, float) and abs(v) <= 1:
            out |= {f"{v * 100:.{n}f}{sign}" for n in range(3) for sign in ("", "%")}
    return out


def allowed_figures(numbers: Column) -> Column:
    """The forms of each number of an array, distinct and sorted."""

    @F.pandas_udf("array<string>")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda xs: sorted(set().union(*(numeral_forms(float(x)) for x in xs if x is not None))) if xs is not None else None)

    return forms(numbers)


def figures_of(document: object) -> set[str]:
    """The figures that a document (nested records, lists, texts, numbers) allows: forms of its numbers, and the figures in its
    texts and keys."""
    if isinstance(document, bool) or document is None:
        return set()
    if isinstance(document, (int, float)):
        return numeral_forms(document)
    if isinstance(document, str):
        return set(re.findall(FIGURE, document))
    if isinstance(document, dict):
        return set().union(*(figures_of(str(k)) | figures_of(v) for k, v in document.items()), set())
    return set().union(*map(figures_of, document), set())


def verified(texts: DataFrame, text: str, allowed: Column, findings: Column | None = None, known: Column | None = None) -> DataFrame:
    """``texts`` with ``figures``, the distinct figures in order, and ``unverified``, those that ``allowed`` (an array) holds
    neither as they are nor without their per cent sign; with ``findings`` (an array of (point, metrics)) also ``untraced``, the
    points that state a figure and name no metric, and ``unknown``, the metrics that ``known`` lacks."""
    own = figures(F.coalesce(F.col(text), F.lit("")))
    out = texts.withColumn("figures", own).withColumn("unverified", F.filter("figures", lambda f: ~F.array_contains(allowed, f) & ~F.array_contains(allowed, F.rtrim(f, F.lit("%")))))
    if findings is not None:
        bare = F.filter(findings, lambda x: x["point"].rlike(FIGURE) & (F.coalesce(F.size(x["metrics"]), F.lit(0)) < 1))
        out = out.withColumn("untraced", F.transform(bare, lambda x: x["point"]))
        named = F.array_distinct(F.flatten(F.transform(findings, lambda x: F.coalesce(x["metrics"], F.array().cast("array<string>")))))
        out = out.withColumn("unknown", F.array_except(named, known))
    return out


def metric_keys(document: dict) -> list[str]:
    """The metrics that a finding may name: those that the payload holds."""
    keys = {"n_questions_scored", "n_unanswerable_excluded", "n_flagged_questions", "flagged_questions", "by_category"} if document.get("configurations") else set()
    for c in document.get("configurations", []):
        keys |= set(c.get("metrics") or {}) | {k for v in (c.get("by_category") or {}).values() for k in v}
    return sorted(keys | set(document.get("comparison", {}).get("deltas", {})))


SUMMARY = "headline string, findings array<struct<point:string,metrics:array<string>>>, caveat string"


def parsed(reply: Column) -> Column:
    """A summary as a record, from a reply that may be fenced: an object with headline, findings and caveat; a finding that is
    a bare text has no metrics. Null if it is no such object, or headline or findings are empty."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    v = F.try_parse_json(bare)
    items = F.try_variant_get(v, "$.findings", "array<variant>")
    point = lambda x: F.coalesce(F.try_variant_get(x, "$.point", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    metrics = lambda x: F.coalesce(F.try_variant_get(x, "$.metrics", "array<string>"), F.array().cast("array<string>"))
    findings = F.filter(F.transform(items, lambda x: F.struct(F.trim(point(x)).alias("point"), metrics(x).alias("metrics"))), lambda x: F.coalesce(x["point"], F.lit("")) != "")
    head = F.trim(F.try_variant_get(v, "$.headline", "string"))
    return F.when((F.coalesce(head, F.lit("")) != "") & (F.size(findings) > 0), F.struct(head.alias("headline"), findings.alias("findings"), F.coalesce(F.try_variant_get(v, "$.caveat", "string"), F.lit("")).alias("caveat")))


def is_current(version: Column, model: Column, files: Column, want_version: str, want_model: str, want_files: Column) -> Column:
    """Whether a cached summary was written by the same prompt and model over the same set of runs."""
    same = (F.size(F.array_except(files, want_files)) == 0) & (F.size(F.array_except(want_files, files)) == 0)
    return F.coalesce((version == want_version) & (model == want_model) & same, F.lit(False))


def document(reply: dict, data: dict, version: str, model: str, files: list[str], at: str) -> dict:
    """The summary that is kept: what was written, of what, and how its figures were checked. One small document, on the driver."""
    points = [f if isinstance(f, dict) else {"point": f, "metrics": []} for f in reply["findings"]]
    stated = list(dict.fromkeys(re.findall(FIGURE, "\n".join([reply["headline"], *(p["point"] for p in points), reply.get("caveat", "")]))))
    allowed, known = figures_of(data), metric_keys(data)
    wrong = [f for f in stated if f not in allowed and f.rstrip("%") not in allowed]
    untraced = [p["point"] for p in points if re.search(FIGURE, p["point"]) and not p.get("metrics")]
    unknown = list(dict.fromkeys(m for p in points for m in p.get("metrics", []) if m not in known))
    check = {"verified": not (wrong or untraced or unknown), "n_figures": len(stated), "figures": stated, "unverified_figures": wrong, "untraced_findings": untraced, "unknown_metrics": unknown}
    return {"prompt_version": version, "model": model, "generated_at": at, "run_files": sorted(files), "n_configurations": data["n_configurations"], "summary": {**reply, "findings": points}, "verification": check}


def as_json(doc: dict) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False, default=str)
