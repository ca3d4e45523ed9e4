"""Queries over the filings, passages, questions and chat tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import answer, coverage, evaluation, history, ingest, planning, search, summary
from orrery.plans.registry import query
from orrery.session import spread, table, written

_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
_QUESTIONS = "(SELECT id AS question, content AS text FROM messages WHERE id % 100 = 0 AND content IS NOT NULL AND lower(trim(role, ' ')) IN ('user', 'human', 'customer'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))"
_NAME = r"trim(regexp_replace(regexp_replace(lower({0}), '[\s,]*\b(?:" + "|".join(T.NAME_SUFFIXES) + r")\b\.?', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'))"


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Every passage once, as delivered last; where texts are read, without shuffling them."""
    if "text" in columns:
        return history.once(spread(table(spark, sf_dir, "chunks", ["chunk_id", *columns, "ingested_at"])), "chunk_id", "ingested_at").drop("ingested_at")
    return history.latest(table(spark, sf_dir, "chunks", ["chunk_id", *columns, "ingested_at"]), "chunk_id", "ingested_at").drop("ingested_at")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users asked, of every message whose id is divisible by 100."""
    m = table(spark, sf_dir, "messages", ["id", "content", "role"]).where("id % 100 = 0 and content is not null and lower(trim(role)) in ('user', 'human', 'customer')")
    return m.select(F.col("id").alias("question"), F.col("content").alias("text"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users asked, of every message."""
    m = table(spark, sf_dir, "messages", ["id", "content", "role"]).where("content is not null and lower(trim(role)) in ('user', 'human', 'customer')")
    return m.select(F.col("id").alias("question"), F.col("content").alias("text"))


def _ranked_sql(k: int, idf: bool) -> str:
    weight = "d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.length / 256))"
    more = " * ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5))" if idf else ""
    return f"""
      SELECT question, key, score, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS INT) AS rank FROM (
          SELECT q.question, d.key, round(sum({weight}{more}), 6) AS score
          FROM d JOIN q ON q.term = d.term {'JOIN f ON f.term = d.term CROSS JOIN n' if idf else ''}
          GROUP BY 1, 2)) WHERE rank <= {k}"""


_BASE = f"""
  WITH c AS MATERIALIZED {_CHUNKS},
  q AS (SELECT DISTINCT question, unnest({_TERMS}) AS term FROM {_QUESTIONS}),
  t AS (SELECT chunk_id AS key, {_TERMS} AS t FROM c),
  d AS MATERIALIZED (SELECT key, term, count(*) AS tf, any_value(length) AS length FROM (SELECT key, len(t) AS length, unnest(t) AS term FROM t) GROUP BY 1, 2),
  f AS (SELECT term, count(*) AS df FROM d GROUP BY 1), n AS (SELECT count(*) AS n FROM c)"""


def _bm25(spark: SparkSession, sf_dir: str, k: int, idf: bool = False, questions: DataFrame | None = None) -> DataFrame:
    return search.bm25(_chunks(spark, sf_dir, "text"), "chunk_id", "text", _questions(spark, sf_dir) if questions is None else questions, "question", "text", k, idf)


@query(_BASE + _ranked_sql(20, False))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 20)


@query(_BASE + _ranked_sql(20, True))
def bm25_idf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 20, True)


def _dense_sql(where: str) -> str:
    return f"""
      SELECT question, key, score, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS INT) AS rank FROM (
          SELECT q.vec_id AS question, e.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
          FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 {where})) WHERE rank <= 10"""


@query(_dense_sql(""))
def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.dense(e, "vec_id", "embedding", e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector")), 10)


@query(_dense_sql("AND e.label IN (1, 3, 5)"))
def dense_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    return search.dense(e.where(F.col("label").isin(1, 3, 5)), "vec_id", "embedding", q, 10)


_VECTOR = f"list_transform(range(0, {search.DIMENSIONS}), lambda d: len(list_filter(list_transform({_TERMS}, lambda w: (ascii(w) * 31 + ascii(right(w, 1)) * 7 + length(w)) % {search.DIMENSIONS}), lambda x: x = d))::DOUBLE)"
_ENCODED = f""", qv AS MATERIALIZED (SELECT question, {_VECTOR} AS v FROM {_QUESTIONS}), cv AS MATERIALIZED (SELECT chunk_id AS key, {_VECTOR} AS v FROM c)"""
_NEAR = """SELECT question, key, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS INT) AS rank FROM (
    SELECT question, key, round(coalesce(CASE WHEN isnan(s) THEN 0 ELSE s END, 0), 6) AS score FROM (SELECT qv.question, cv.key, list_cosine_similarity(qv.v, cv.v) AS s FROM qv, cv))) WHERE rank <= {}"""


@query(_BASE + _ENCODED + " " + _NEAR.format(20))
def encoded_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by the built-in encoder: the dense leg over texts."""
    return _near(spark, sf_dir, 20)


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = _chunks(spark, sf_dir, "text").select("chunk_id", search.hashed_vector(F.col("text")).alias("vector"))
    return search.dense(written(rows, "vectors"), "chunk_id", "vector", _questions(spark, sf_dir).select("question", search.hashed_vector(F.col("text")).alias("vector")), k)


_FUSED = """SELECT question, key, score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS INT) AS rank FROM (
      SELECT question, key, round(sum(1.0 / (rank - 1 + 60)), 9) AS score FROM (SELECT question, key, rank FROM a UNION ALL SELECT question, key, rank FROM b) GROUP BY 1, 2)) WHERE rank <= """


@query(_BASE + _ENCODED + f", a AS ({_ranked_sql(80, False)}), b AS ({_NEAR.format(80)}) " + _FUSED + "20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical and the dense leg over the same passages, fused by rank."""
    return search.fuse([_bm25(spark, sf_dir, 80), _near(spark, sf_dir, 80)], 20)


@query(_BASE + f""", a AS ({_ranked_sql(80, False)}), b AS ({_ranked_sql(80, True)}) """ + _FUSED + "20")
def rrf_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse([_bm25(spark, sf_dir, 80), _bm25(spark, sf_dir, 80, True)], 20)


_DIVERSE = """
  SELECT question, key, source_file, CAST(turn AS INT) AS turn, CAST(position AS INT) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY turn, rank) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY question, source_file ORDER BY rank) AS turn FROM r) WHERE turn <= 2) WHERE position <= 20"""


@query(_BASE + f", r AS (SELECT x.*, c.source_file FROM ({_ranked_sql(60, False)}) x JOIN c ON c.chunk_id = x.key)" + _DIVERSE)
def file_diverse_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _chunks(spark, sf_dir, "source_file").withColumnRenamed("chunk_id", "key")
    return search.diverse(_bm25(spark, sf_dir, 60).join(files, "key"), "source_file", 20).select("question", "key", "source_file", "turn", "position")


_SUPPRESSED = _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", r AS MATERIALIZED ({_ranked_sql(200, False)}),
  sw AS (SELECT r.question, r.key, r.rank, regexp_extract_all(lower(c.text), '[a-z0-9]+') AS w FROM r JOIN c ON c.chunk_id = r.key),
  sh AS MATERIALIZED (SELECT question, key, rank, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS s FROM sw),
  sn AS MATERIALIZED (SELECT question, rank, any_value(key) AS key, count(*) AS n FROM sh GROUP BY 1, 2),
  alike AS MATERIALIZED (SELECT p.question, p.b, list(p.a) AS before FROM (SELECT x.question, x.rank AS a, y.rank AS b, count(*) AS m FROM sh x JOIN sh y ON x.question = y.question AND x.s = y.s AND x.rank < y.rank GROUP BY 1, 2, 3) p
    JOIN sn x ON x.question = p.question AND x.rank = p.a JOIN sn y ON y.question = p.question AND y.rank = p.b WHERE p.m >= 0.8 * (x.n + y.n - p.m) GROUP BY 1, 2),
  kept AS (SELECT question, 0 AS step_no, []::INT[] AS k FROM (SELECT DISTINCT question FROM sn)
    UNION ALL SELECT k.question, k.step_no + 1, CASE WHEN a.before IS NULL OR NOT list_has_any(k.k, a.before) THEN list_append(k.k, k.step_no + 1) ELSE k.k END FROM kept k JOIN sn ON sn.question = k.question AND sn.rank = k.step_no + 1 LEFT JOIN alike a ON a.question = k.question AND a.b = k.step_no + 1)
  SELECT e.question, sn.rank, sn.key FROM (SELECT question, unnest(arg_max(k, step_no)) AS rank FROM kept GROUP BY 1) e JOIN sn ON sn.question = e.question AND sn.rank = e.rank"""


@query(_SUPPRESSED)
def near_dup_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _chunks(spark, sf_dir, "text").withColumnRenamed("chunk_id", "key")
    return search.distinct_content(_bm25(spark, sf_dir, 200).join(texts, "key"), "text")


_OVERLAP = "round(len(list_intersect(list_distinct({q}), {t})) / greatest(len(list_distinct({q})), 1), 6)".format(q=_TERMS.replace("lower(text)", "lower(q.text)"), t=_TERMS.replace("lower(text)", "lower(c.text)"))


@query(_BASE + f""", r AS ({_ranked_sql(20, False)}) SELECT r.question, r.key, CAST(row_number() OVER (PARTITION BY r.question ORDER BY CASE WHEN n > 1 THEN {_OVERLAP} END DESC NULLS LAST, r.rank) AS INT) AS rank, n > 1 AS reranked
  FROM (SELECT *, count(*) OVER (PARTITION BY question) AS n FROM r) r JOIN c ON c.chunk_id = r.key JOIN {_QUESTIONS} q ON q.question = r.question""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best passages in the order of the built-in reranker."""
    r = _bm25(spark, sf_dir, 20).join(_chunks(spark, sf_dir, "text").withColumnRenamed("chunk_id", "key"), "key").join(_questions(spark, sf_dir).withColumnRenamed("text", "asked"), "question")
    return search.reranked(r, "asked", "text", search.overlap_score).select("question", "key", "rank", "reranked")


@query(_BASE.replace(f"c AS MATERIALIZED {_CHUNKS}", f"c AS MATERIALIZED (SELECT * FROM {_CHUNKS} WHERE fiscal_year BETWEEN 2019 AND 2022 AND (form_type = '10-Q' OR (form_type = '10-K' AND item_section IN ('Item 1A — Risk Factors', 'Part II Item 1A — Risk Factors'))))") + _ranked_sql(20, False))
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search under a filter of the caller's, which is applied before passages are scored."""
    own = F.struct(F.lit(None).cast("string").alias("ticker"), F.lit(2019).alias("lo"), F.lit(2022).alias("hi"), F.lit("10-Q").alias("form_type"))
    c = _chunks(spark, sf_dir, "text", "fiscal_year", "form_type", "item_section")
    c = c.where(search.in_scope(F.lit(None), F.col("fiscal_year"), F.col("form_type"), F.col("item_section"), own))
    return search.bm25(c, "chunk_id", "text", _questions(spark, sf_dir), "question", "text", 20)


@query()
def evidence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best passages without copies, spread over files to 60 and then to 20."""
    c = _chunks(spark, sf_dir, "text", "source_file").withColumnRenamed("chunk_id", "key")
    ranked = written(_bm25(spark, sf_dir, 200).join(c, "key"), "ranked")
    return search.evidence(ranked, "text", "source_file", 20).select("question", "key", "source_file", "turn", "position")


@query("SELECT md5(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", F.md5("text").alias("text_hash"))
    return d.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"SELECT chunk_id, ticker, fiscal_year, form_type FROM {_CHUNKS} WHERE fiscal_year BETWEEN 2015 AND 2018 AND form_type = '10-K' AND ticker < 'M'")
def scope_filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope of years and form by the operator, and a bound on tickers."""
    plan = F.struct(F.lit(None).cast("string").alias("ticker"), F.lit(2015).alias("lo"), F.lit(2018).alias("hi"), F.lit("10-K").alias("form_type"))
    c = _chunks(spark, sf_dir, "ticker", "fiscal_year", "form_type")
    return c.where(search.in_scope(F.lit(None), F.col("fiscal_year"), F.col("form_type"), F.lit(""), plan) & (F.col("ticker") < "M"))


@query(f"SELECT chunk_id, form_type, item_section FROM {_CHUNKS} WHERE form_type = '10-Q' OR (form_type = '10-K' AND item_section IN ('Item 1A — Risk Factors', 'Part II Item 1A — Risk Factors'))")
def form_scope_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir, "form_type", "item_section")
    plan = F.struct(F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit("10-Q").alias("form_type"))
    return c.where(search.in_scope(F.lit(None), F.lit(None), F.col("form_type"), F.col("item_section"), plan))


_NAMES = "(SELECT ticker, arg_min(company, source_file) AS company, min(source_file) AS first_file FROM filings WHERE coalesce(ticker, '') <> '' AND coalesce(company, '') <> '' GROUP BY 1)"
_SQL_WORDS = lambda words: ", ".join(f"'{w}'" for w in words)
_WORDS = f"""(SELECT word, min(ticker) AS ticker FROM (SELECT DISTINCT ticker, unnest(w) AS word FROM (SELECT ticker, list_filter(regexp_split_to_array({_NAME.format('company')}, ' +'), lambda x: x <> '') AS w FROM {_NAMES}) WHERE len(w) > 1)
  WHERE length(word) > 2 AND word NOT IN ({_SQL_WORDS(planning.DESCRIPTORS)}) GROUP BY word HAVING count(DISTINCT ticker) = 1)"""
_ALIASES = f"""(SELECT alias, ticker, kind FROM (
    SELECT {_NAME.format('ticker')} AS alias, ticker, 'ticker' AS kind, 0 AS p, first_file FROM {_NAMES}
    UNION ALL SELECT {_NAME.format('company')}, ticker, 'name', 1, first_file FROM {_NAMES}
    UNION ALL SELECT word, ticker, 'word', 2, '' FROM {_WORDS}
    UNION ALL SELECT a, t, 'colloquial', 3, '' FROM (VALUES {', '.join(f"('{a}', '{t}')" for a, t in planning.COLLOQUIAL.items())}) AS v(a, t) WHERE t IN (SELECT ticker FROM {_NAMES})) WHERE alias <> ''
  QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p, first_file, ticker) = 1)"""
_ASKED = "(SELECT id AS question, content AS text FROM messages WHERE content IS NOT NULL AND lower(trim(role, ' ')) IN ('user', 'human', 'customer'))"
_whole = lambda sql: sql.replace(_QUESTIONS, _ASKED)  # noqa: E731  what users asked in every message
# DuckDB's word boundary knows ASCII only: other letters are shown to it as an underscore, which no run holds.
_RUNS_OF = "regexp_extract_all(regexp_replace(text, '[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}\\x{370}-\\x{1FFF}\\x{3040}-\\x{D7FF}]', '_', 'g'), '" + T.RUN + "', 1)"
_NO_NAME = f"({_SQL_WORDS(planning.VOCABULARY)})"
# How a question is read, step by step: from the word after what was read last, the longest span that is an alias.
_PLAN = f"""
  aliases AS MATERIALIZED {_ALIASES},
  runs AS MATERIALIZED (SELECT question, run_no, list_filter(regexp_split_to_array(regexp_replace(run, '[''’]s\\b', '', 'g'), '\\s+'), lambda w: w <> '') AS w FROM (
    SELECT question, unnest(r) AS run, generate_subscripts(r, 1) AS run_no FROM (SELECT question, {_RUNS_OF.replace('{', '{{').replace('}', '}}')} AS r FROM {{asked}}))),
  places AS (SELECT question, run_no, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
  spans AS (SELECT question, run_no, i, e, array_to_string(list_slice(w, i, e), ' ') AS span FROM (SELECT *, unnest(range(i, len(w) + 1)) AS e FROM places)),
  hits AS (SELECT question, run_no, i, e, ticker FROM (
      SELECT s.question, s.run_no, s.i, s.e, a.ticker FROM spans s JOIN aliases a ON a.alias = {_NAME.format('s.span')} WHERE length(s.span) > 2
      UNION ALL SELECT s.question, s.run_no, s.i, s.e, a.ticker FROM spans s JOIN aliases a ON a.kind = 'ticker' AND a.ticker = s.span WHERE length(s.span) <= 2)
    QUALIFY row_number() OVER (PARTITION BY question, run_no, i ORDER BY e DESC) = 1),
  steps AS MATERIALIZED (SELECT p.question, p.run_no, p.i, coalesce(h.e, p.i) + 1 AS next, h.ticker, p.w[p.i] AS word, len(p.w) AS n,
    CASE WHEN h.ticker IS NOT NULL THEN 0 WHEN {_NAME.format('p.w[p.i]')} IN {_NO_NAME} OR lower(p.w[p.i]) IN ('and', 'the') OR length(p.w[p.i]) <= 2 THEN 0 ELSE 1 END AS open
    FROM places p LEFT JOIN hits h ON h.question = p.question AND h.run_no = p.run_no AND h.i = p.i),
  walk AS (SELECT question, run_no, i, next, ticker, word, open FROM steps WHERE i = 1
    UNION ALL SELECT s.question, s.run_no, s.i, s.next, s.ticker, s.word, s.open FROM walk w JOIN steps s ON s.question = w.question AND s.run_no = w.run_no AND s.i = w.next),
  named AS MATERIALIZED (SELECT question, ticker, CAST(row_number() OVER (PARTITION BY question ORDER BY first) AS INT) AS mention FROM (
    SELECT question, ticker, min(run_no * 10000 + i) AS first FROM walk WHERE ticker IS NOT NULL GROUP BY 1, 2)),
  loose AS (SELECT question, run_no, min(i) AS i, string_agg(word, ' ' ORDER BY i) AS name, count(*) AS n FROM (
    SELECT *, sum(1 - open) OVER (PARTITION BY question, run_no ORDER BY i) AS block FROM walk) WHERE open = 1 GROUP BY question, run_no, block)"""
_NAMED = "(SELECT question, ticker, mention FROM named)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.ticker_names(table(spark, sf_dir, "filings", ["ticker", "company", "source_file"]))


def _base_named() -> str:
    return _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _PLAN.format(asked=_QUESTIONS)


@query(f"SELECT ticker, company FROM {_NAMES}")
def ticker_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("ticker", "company")


@query(f"SELECT source_file, {_NAME.format('company')} AS name FROM filings")
def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "filings", ["source_file", "company"]).select("source_file", T.normalised_name(F.col("company")).alias("name"))


@query(f"SELECT word, ticker FROM {_WORDS}")
def distinctive_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.distinctive_words(_names(spark, sf_dir))


@query(f"SELECT alias, ticker, kind FROM {_ALIASES}")
def alias_priority_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.alias_dictionary(_names(spark, sf_dir))


def _latest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fiscal year of the corpus: a table of one row."""
    return table(spark, sf_dir, "chunks", ["fiscal_year"]).agg(F.max("fiscal_year").alias("latest"))


def _plans(spark: SparkSession, sf_dir: str, questions: DataFrame, fuzzy: bool = True) -> DataFrame:
    return planning.plans(questions, "question", "text", planning.alias_dictionary(_names(spark, sf_dir)), _latest_year(spark, sf_dir), fuzzy)


def _named(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None) -> DataFrame:
    """The companies of the questions of the searches, as spelt."""
    return planning.mentioned(_plans(spark, sf_dir, _questions(spark, sf_dir) if questions is None else questions, False))


@query("WITH RECURSIVE " + _PLAN.format(asked=_ASKED) + " SELECT question, ticker, mention FROM named")
def named_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies that every user message names as they are spelt."""
    return planning.mentioned(_plans(spark, sf_dir, _asked(spark, sf_dir), False))


_YEARS = f"""CASE WHEN regexp_extract(q, '{T.SINCE_YEAR}', 1) <> '' THEN [regexp_extract(q, '{T.SINCE_YEAR}', 1)::INT, latest]
    WHEN regexp_extract(q, '{T.LAST_YEARS}', 1) <> '' THEN [latest - (CASE WHEN regexp_extract(q, '{T.LAST_YEARS}', 1) IN ('few', 'several', 'three', '3') THEN 3 WHEN regexp_extract(q, '{T.LAST_YEARS}', 1) IN ('four', '4') THEN 4 WHEN regexp_extract(q, '{T.LAST_YEARS}', 1) IN ('five', '5') THEN 5 ELSE 2 END) + 1, latest]
    WHEN len(y) > 0 THEN [list_min(y), list_max(y)] END"""
_WINDOW = r"(SELECT *, lower(text) AS q, list_transform(regexp_extract_all(lower(text), '\b((?:19|20)\d{{2}})\b', 1), lambda x: x::INT) AS y, (SELECT max(fiscal_year) FROM chunks) AS latest FROM {})"
_FORM = f"CASE WHEN regexp_matches(q, '{T.QUARTERLY_WORDS}') AND NOT regexp_matches(q, '{T.ANNUAL_WORDS}') THEN '10-Q' WHEN regexp_matches(q, '{T.ANNUAL_WORDS}') AND NOT regexp_matches(q, '{T.QUARTERLY_WORDS}') THEN '10-K' END"


@query("WITH RECURSIVE " + _PLAN.format(asked=_ASKED) + f""",
  found AS (SELECT question, string_agg(ticker, ',' ORDER BY mention) AS tickers FROM named GROUP BY 1),
  lost AS (SELECT question, string_agg(name, ';' ORDER BY first) AS unresolved FROM (SELECT question, name, min(run_no * 10000 + i) AS first FROM loose WHERE NOT (n = 1 AND {_NAME.format('name')} IN ({_SQL_WORDS(planning.DESCRIPTORS)})) GROUP BY 1, 2) GROUP BY 1)
  SELECT p.question, coalesce(f.tickers, '') AS tickers, coalesce(l.unresolved, '') AS unresolved, coalesce(years[1], 0) AS lo, coalesce(years[2], 0) AS hi, form_type FROM (SELECT question, {_YEARS} AS years, {_FORM} AS form_type FROM {_WINDOW.format(_ASKED)}) p
  LEFT JOIN found f ON f.question = p.question LEFT JOIN lost l ON l.question = p.question""")
def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user message asks for: companies as they are spelt, names that are not held, years, form."""
    return _plan_columns(_plans(spark, sf_dir, _asked(spark, sf_dir), False))


def _plan_columns(p: DataFrame) -> DataFrame:
    return p.select("question", F.array_join("tickers", ",").alias("tickers"), F.array_join("unresolved", ";").alias("unresolved"), *(F.coalesce(y, F.lit(0)).alias(y) for y in ("lo", "hi")), "form_type")


@query()
def plan_with_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``plan`` with misspelt names, whose likeness SQL cannot tell."""
    return _plan_columns(_plans(spark, sf_dir, _asked(spark, sf_dir)))


@query()
def near_miss_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _asked(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    return planning.near_miss(words, "word", planning.alias_dictionary(_names(spark, sf_dir)))


_QUOTA = _base_named() + f""", m AS (SELECT *, count(*) OVER (PARTITION BY question) AS n_companies FROM {_NAMED}),
  s AS (SELECT q.question, d.key, round(sum(d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.length / 256))), 6) AS score FROM d JOIN q ON q.term = d.term GROUP BY 1, 2),
  x AS (SELECT s.question, m.ticker, m.mention, greatest(20 // m.n_companies, 6) AS budget, s.key, c.source_file, c.item_section, c.fiscal_year,
      row_number() OVER (PARTITION BY s.question, m.ticker ORDER BY s.score DESC, s.key) AS rank
    FROM s JOIN c ON c.chunk_id = s.key JOIN m ON m.question = s.question AND m.ticker = c.ticker),
  y AS (SELECT *, row_number() OVER (PARTITION BY question, ticker, source_file ORDER BY rank) AS turn FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY question, ticker ORDER BY turn, rank) AS position FROM y WHERE turn <= 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY mention, item_section, fiscal_year NULLS FIRST, position) AS INT) AS place FROM z WHERE position <= budget)
  """


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages for each named company within its budget, merged in order of mention, section and year."""
    named = _named(spark, sf_dir)
    named = named.withColumn("n_companies", F.count("*").over(Window.partitionBy("question"))).withColumn("budget", search.budget(20, F.col("n_companies")))
    c = _chunks(spark, sf_dir, "text", "ticker", "source_file", "item_section", "fiscal_year")
    scoped = _questions(spark, sf_dir).join(named.select("question", "ticker"), "question")
    scored = search.bm25(c, "chunk_id", "text", scoped, "question", "text", None, scope="ticker")
    own = scored.join(c.drop("text", "ticker").withColumnRenamed("chunk_id", "key"), "key").join(named, ["question", "ticker"])
    by = ("question", "ticker")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key")))
    kept = search.diverse(ranked, "source_file", F.col("budget"), by=by)
    place = F.row_number().over(Window.partitionBy("question").orderBy("mention", "item_section", F.asc_nulls_first("fiscal_year"), "position"))
    return kept.withColumn("place", place)


@query(_QUOTA + "SELECT question, ticker, key, place FROM r WHERE place <= 20")
def quota_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).where("place <= 20").select("question", "ticker", "key", "place")


@query(_QUOTA + "SELECT question, count(*) AS wanted, sum(CASE WHEN place > 20 THEN 1 ELSE 0 END)::BIGINT AS cut FROM r GROUP BY 1")
def quota_retrieve_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).groupBy("question").agg(F.count("*").alias("wanted"), F.sum(F.when(F.col("place") > 20, 1).otherwise(0)).alias("cut"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = written(_questions(spark, sf_dir), "questions")
    c = _chunks(spark, sf_dir, "text", "ticker", "source_file", "item_section", "fiscal_year", "form_type")
    return search.retrieve_for(c, questions, written(_plans(spark, sf_dir, questions), "plans"))


@query()
def planned_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a search: plan with misspelt names, years and forms, both legs, fusion, no copies, reranking, quotas, merge."""
    return _retrieved(spark, sf_dir).where("place <= 20")


@query()
def planned_retrieve_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).groupBy("question").agg(F.count("*").alias("wanted"), F.sum(F.when(F.col("place") > 20, 1).otherwise(0)).alias("cut"))


_RANKED_COVER = _base_named() + f", r AS (SELECT x.question, x.rank, c.* FROM ({_ranked_sql(20, False)}) x JOIN c ON c.chunk_id = x.key), census AS (SELECT ticker, count(*) AS n FROM filings WHERE coalesce(ticker, '') <> '' GROUP BY 1)"
_COVERED = """(SELECT r.question, r.ticker, arg_min(r.company, r.rank) FILTER (WHERE r.company IS NOT NULL) AS company, count(*) AS passages, count(DISTINCT source_file) AS filings_retrieved,
    coalesce(array_to_string(list_sort(list(DISTINCT period_end) FILTER (WHERE period_end <> '')), ','), '') AS periods, coalesce(any_value(census.n), count(DISTINCT source_file)) AS filings_in_corpus
  FROM r LEFT JOIN census ON census.ticker = r.ticker GROUP BY 1, 2)"""


def _covered(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None) -> DataFrame:
    c = _chunks(spark, sf_dir, "company", "ticker", "source_file", "period_end").withColumnRenamed("chunk_id", "key")
    return coverage.by_company(_bm25(spark, sf_dir, 20, questions=questions).join(c, "key"), table(spark, sf_dir, "filings", ["ticker"]))


@query(_RANKED_COVER + f" SELECT question, ticker, passages, filings_retrieved, periods, filings_in_corpus FROM {_COVERED}")
def coverage_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("question", "ticker", "passages", "filings_retrieved", "periods", "filings_in_corpus")


@query(_whole(_RANKED_COVER) + f" SELECT question, ticker FROM {_COVERED} WHERE filings_in_corpus <= 1")
def coverage_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir, _asked(spark, sf_dir)).where("thin").select("question", "ticker")


@query(_RANKED_COVER + f" SELECT DISTINCT m.question, m.ticker FROM {_NAMED} m JOIN census ON census.ticker = m.ticker WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.question = m.question AND r.ticker = m.ticker)")
def coverage_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.absent(_named(spark, sf_dir), _covered(spark, sf_dir), table(spark, sf_dir, "filings", ["ticker"]))


@query()
def coverage_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    covered = written(_covered(spark, sf_dir, asked), "covered")
    return coverage.sentence(covered, coverage.absent(_named(spark, sf_dir, asked), covered, table(spark, sf_dir, "filings", ["ticker"])))


_METRICS = _base_named() + f""", r AS (SELECT x.question, x.rank, c.source_file AS file, c.ticker FROM ({_ranked_sql(20, False)}) x JOIN c ON c.chunk_id = x.key),
  rel AS (SELECT DISTINCT n.question, f.source_file AS file FROM named n JOIN filings f ON f.ticker = n.ticker),
  nrel AS (SELECT question, count(*) AS n FROM rel GROUP BY 1),
  h AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY first) AS place FROM (
    SELECT r.question, r.file, min(r.rank) AS first, max(CASE WHEN rel.file IS NULL THEN 0 ELSE 1 END) AS hit FROM r LEFT JOIN rel ON rel.question = r.question AND rel.file = r.file GROUP BY 1, 2)),
  p AS (SELECT question, sum(CASE WHEN first <= 5 THEN hit ELSE 0 END) AS h5, sum(CASE WHEN first <= 10 THEN hit ELSE 0 END) AS h10, sum(hit) AS h20,
    sum(CASE WHEN first <= 10 THEN hit / log2(place + 1) ELSE 0 END) AS dcg, min(CASE WHEN first <= 10 AND hit = 1 THEN place END) AS fh, sum(CASE WHEN first <= 10 THEN 1 ELSE 0 END) AS nf FROM h GROUP BY 1),
  m AS (SELECT nrel.question, nrel.n AS n_relevant, round(coalesce(h5, 0) / n, 6) AS recall_5, round(coalesce(h10, 0) / n, 6) AS recall_10, round(coalesce(h20, 0) / n, 6) AS recall_20,
    round(coalesce(h5, 0) / least(5, n), 6) AS attainable_recall_5, round(coalesce(h10, 0) / least(10, n), 6) AS attainable_recall_10, round(coalesce(h20, 0) / least(20, n), 6) AS attainable_recall_20,
    round(coalesce(1.0 / fh, 0), 6)::DOUBLE AS mrr,
    round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, greatest(coalesce(nf, 0), 1))::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
    FROM nrel LEFT JOIN p ON p.question = nrel.question)"""


def _scored(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _chunks(spark, sf_dir, "source_file", "ticker").withColumnRenamed("chunk_id", "key")
    ranked = _bm25(spark, sf_dir, 20, questions=questions).join(c, "key").select("question", F.col("source_file").alias("file"), F.col("ticker").alias("entity"), "rank")
    named = _named(spark, sf_dir, questions)
    relevant = named.join(table(spark, sf_dir, "filings", ["ticker", "source_file"]), "ticker").select("question", F.col("source_file").alias("file"))
    return ranked, named, evaluation.scores(ranked, relevant)


@query(_METRICS + " SELECT * FROM m")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[2]


@query(_whole(_METRICS) + ", e AS (SELECT question, list(DISTINCT ticker) AS t FROM named GROUP BY 1) SELECT e.question, round(len(list_intersect(e.t, coalesce((SELECT list(DISTINCT ticker) FROM r WHERE r.question = e.question AND r.rank <= 10), []))) / len(e.t), 6) AS coverage FROM e")
def entity_coverage_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, named, _ = _scored(spark, sf_dir, _asked(spark, sf_dir))
    return evaluation.entity_coverage(ranked, named.groupBy("question").agg(F.collect_set("ticker").alias("entities")))


@query(_METRICS + """, k AS (SELECT m.*, CASE WHEN (SELECT count(*) FROM named WHERE named.question = m.question) = 1 THEN 'single_company' ELSE 'cross_company' END AS category FROM m)
  SELECT category, round(avg(recall_10), 4) AS recall_10, count(recall_10) AS n_recall_10, round(avg(mrr), 4) AS mrr, count(mrr) AS n_mrr, round(avg(ndcg), 4) AS ndcg, count(ndcg) AS n_ndcg FROM k GROUP BY GROUPING SETS ((category), ())""")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, per = _scored(spark, sf_dir)
    kind = named.groupBy("question").agg(F.when(F.count("*") == 1, "single_company").otherwise("cross_company").alias("category"))
    return evaluation.means(per.join(kind, "question"), "category", ["recall_10", "mrr", "ndcg"])


@query(r"SELECT id AS message_id, handle FROM (SELECT id, unnest(list_distinct(regexp_extract_all(content, '\[(C\d+)\]', 1))) AS handle FROM messages WHERE content IS NOT NULL)")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages", ["id", "content"]).where("content is not null")
    return m.select(F.col("id").alias("message_id"), F.explode(T.citation_handles(F.col("content"))).alias("handle"))


@query(r"""
  SELECT id AS message_id, len(h)::INT AS cited, len(list_filter(h, lambda x: NOT list_contains(a, x)))::INT AS fabricated, len(list_filter(a, lambda x: NOT list_contains(h, x)))::INT AS unused FROM (
    SELECT id, list_distinct(regexp_extract_all(content, '\[(C\d+)\]', 1)) AS h, list_distinct(regexp_extract_all(citations, '"id": ?"(C\d+)"', 1)) AS a FROM messages WHERE content IS NOT NULL AND citations IS NOT NULL)""")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages", ["id", "content", "citations"]).where("content is not null and citations is not null")
    m = m.select("id", T.citation_handles(F.col("content")).alias("h"), F.array_distinct(F.regexp_extract_all("citations", F.lit(r'"id": ?"(C\d+)"'), F.lit(1))).alias("a"))
    return m.select(F.col("id").alias("message_id"), F.size("h").alias("cited"), F.size(F.array_except("h", "a")).alias("fabricated"), F.size(F.array_except("a", "h")).alias("unused"))


_PROBES = ("supply chain", "labour contract", "withholding levy", "jury verdict", "mobile client", "freight contract")


@query(f"SELECT p.probe, c.ticker, count(DISTINCT c.source_file) AS files FROM {_CHUNKS} c JOIN (SELECT unnest([{', '.join(repr(p) for p in _PROBES)}]) AS probe) p ON contains(lower(c.text), p.probe) GROUP BY 1, 2")
def probe_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a literal probe labels, by ticker; probes are a list of parameters, looked for in one pass."""
    hits = F.filter(F.array(*map(F.lit, _PROBES)), lambda p: F.contains(F.lower("text"), p))
    c = _chunks(spark, sf_dir, "text", "ticker", "source_file").select("ticker", "source_file", F.explode(hits).alias("probe"))
    return c.groupBy("probe", "ticker").agg(F.countDistinct("source_file").alias("files"))


@query(r"""
  SELECT source_file, period_end, CASE WHEN period_end <> '' THEN left(period_end, 4)::INT ELSE left(filing_date, 4)::INT - CASE WHEN starts_with(upper(filing_type), '10-K') AND substr(filing_date, 6, 2) IN ('01', '02', '03', '04') THEN 1 ELSE 0 END END AS fiscal_year FROM (
    SELECT *, CASE WHEN coalesce(report_period, '') <> '' THEN report_period WHEN s <> '' THEN substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2) ELSE '' END AS period_end FROM (
      SELECT *, regexp_extract(coalesce(url, ''), '-(\d{8})[^/]*\.html?', 1) AS s FROM filings))""")
def fiscal_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "filings")
    return f.select("source_file", T.fiscal_period(F.col("report_period"), F.col("url"), F.col("filing_date"), F.col("filing_type")).alias("p")).select("source_file", "p.*")


@query("SELECT ticker, count(*) AS filings_in_corpus FROM filings WHERE coalesce(ticker, '') <> '' GROUP BY 1")
def filings_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.census(table(spark, sf_dir, "filings", ["ticker"]))


@query(f"SELECT coalesce(min(fiscal_year), 0) AS first_year, coalesce(max(fiscal_year), 0) AS last_year FROM {_CHUNKS}")
def fiscal_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "fiscal_year").agg(F.coalesce(F.min("fiscal_year"), F.lit(0)).alias("first_year"), F.coalesce(F.max("fiscal_year"), F.lit(0)).alias("last_year"))


_ALL = "(SELECT id AS message_id, content AS text FROM messages WHERE content IS NOT NULL)"


@query(f"SELECT message_id, years[1] AS lo, years[2] AS hi FROM (SELECT message_id, {_YEARS} AS years FROM {_WINDOW.format(_ALL)}) WHERE years IS NOT NULL")
def year_window_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages", ["id", "content"]).where("content is not null").join(F.broadcast(_latest_year(spark, sf_dir)))
    return m.select(F.col("id").alias("message_id"), T.year_window(F.col("content"), F.col("latest")).alias("w")).where("w is not null").select("message_id", "w.*")


@query(f"SELECT message_id, form_type FROM (SELECT message_id, {_FORM} AS form_type FROM {_WINDOW.format(_ALL)}) WHERE form_type IS NOT NULL")
def form_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages", ["id", "content"]).where("content is not null")
    return m.select(F.col("id").alias("message_id"), T.form_hint(F.col("content")).alias("form_type")).where("form_type is not null")


@query(f"SELECT question, run FROM (SELECT question, unnest(list_distinct(list_transform({_RUNS_OF}, lambda r: regexp_replace(r, '[''’]s\\b', '', 'g')))) AS run FROM {_ASKED})")
def capitalised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of capitalised words of every user message."""
    return _asked(spark, sf_dir).select("question", F.explode(F.array_distinct(T.capitalised_runs(F.col("text")))).alias("run"))


@query(r"SELECT id AS message_id, figure FROM (SELECT id, unnest(list_distinct(regexp_extract_all(content, '\d+(?:\.\d+)?%?'))) AS figure FROM messages WHERE content IS NOT NULL)")
def figures_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages", ["id", "content"]).where("content is not null")
    return m.select(F.col("id").alias("message_id"), F.explode(T.figures(F.col("content"))).alias("figure"))


_CONV = "(SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, user_id, title, model, created_at) = 1)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(table(spark, sf_dir, "conversations"), "id", "updated_at")


@query(f"SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS INT) AS position FROM {_CONV}")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")
    return _conversations(spark, sf_dir).select("user_id", "id", F.row_number().over(w).alias("position"))


@query(r"""
  SELECT id AS message_id, CASE WHEN o = '' THEN 'New chat' WHEN length(o) <= 60 THEN o ELSE rtrim(CASE WHEN instr(h, ' ') > 0 AND length(h) - instr(reverse(h), ' ') > 36 THEN substr(h, 1, length(h) - instr(reverse(h), ' ')) ELSE h END, ' ') || '…' END AS title FROM (
    SELECT id, o, substr(o, 1, 60) AS h FROM (SELECT id, trim(regexp_replace(coalesce(content, ''), '[ \t\n\r]+', ' ', 'g'), ' ') AS o FROM messages))""")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages", ["id", "content"]).select(F.col("id").alias("message_id"), T.title(F.col("content")).alias("title"))


@query(f"""
  SELECT user_id, bucket, count(*) AS n FROM (SELECT user_id, CASE WHEN d IS NULL THEN 'Older' WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN 'Previous 7 days' WHEN d <= 30 THEN 'Previous 30 days' ELSE 'Older' END AS bucket
    FROM (SELECT user_id, date_diff('day', try_cast(left(updated_at, 10) AS DATE), DATE '2026-09-15') AS d FROM {_CONV})) GROUP BY 1, 2""")
def recency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.substring("updated_at", 1, 10).try_cast("date")
    return _conversations(spark, sf_dir).select("user_id", history.recency(at, F.lit("2026-09-15").cast("date")).alias("bucket")).groupBy("user_id", "bucket").agg(F.count("*").alias("n"))


@query(f"SELECT m.id, m.conversation_id FROM messages m WHERE m.conversation_id IN (SELECT id FROM {_CONV})")
def messages_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cascade(table(spark, sf_dir, "messages", ["id", "conversation_id"]), _conversations(spark, sf_dir)).select("id", "conversation_id")


@query(f"""
  SELECT source_file, item_section, CAST(start AS INT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY source_file ORDER BY start), n) AS INT) AS end_ FROM (
    SELECT source_file, item_section, min(chunk_index) AS start, any_value(n) AS n FROM (SELECT *, max(chunk_index) OVER (PARTITION BY source_file) + 1 AS n FROM {_CHUNKS}) GROUP BY 1, 2)""")
def section_span_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir, "source_file", "item_section", "chunk_index")
    ends = c.groupBy("source_file").agg((F.max("chunk_index") + 1).alias("n"))
    s = c.groupBy("source_file", "item_section").agg(F.min("chunk_index").alias("start")).join(ends, "source_file")
    return s.select("source_file", "item_section", "start", F.coalesce(F.lead("start").over(Window.partitionBy("source_file").orderBy("start")), "n").alias("end_"))


@query("SELECT event_type, round(arg_max(value, ts * 0 + event_id) - arg_min(value, event_id), 4) AS delta, min(ts) AS first_seen FROM events GROUP BY 1".replace("ts * 0 + ", ""))
def newest_per_key_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", ["event_id", "event_type", "value", "ts"])
    return e.groupBy("event_type").agg(F.round(F.max_by("value", "event_id") - F.min_by("value", "event_id"), 4).alias("delta"), F.min("ts").alias("first_seen"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_type", "value"]).groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


@query(f"""
  SELECT chunk_id, coalesce(company, '') || ' (' || ticker || ') — ' || form_type || ', FY' || coalesce(fiscal_year::VARCHAR, '') || CASE WHEN coalesce(period_end, '') <> '' THEN ' (period ending ' || period_end || ')' ELSE '' END || ' — ' || item_section || ':' AS prefix FROM {_CHUNKS}""")
def contextual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir, "company", "ticker", "form_type", "fiscal_year", "period_end", "item_section")
    return c.select("chunk_id", T.contextual_prefix(*(F.col(x) for x in ("company", "ticker", "form_type", "fiscal_year", "period_end", "item_section"))).alias("prefix"))


@query(f"""
  SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
  FROM (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source_file || '#' || chunk_index)) AS h FROM {_CHUNKS})""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "source_file", "chunk_index").select("chunk_id", ingest.point_id(F.col("source_file"), F.col("chunk_index")).alias("point_id"))


@query("SELECT source_file, company, ticker, filing_type AS form, filing_date FROM filings")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written as text and parsed again."""
    f = table(spark, sf_dir, "filings")
    line = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(k + ": "), F.col(c), F.lit("\n"))).otherwise("")
    raw = F.concat(line("Company", "company"), line("Ticker", "ticker"), line("Filing Type", "filing_type"), line("Filing Date", "filing_date"), line("CIK", "cik"), line("URL", "url"), line("Report Period", "report_period"), F.lit("=" * 40 + "\nBody."))
    h = f.select("source_file", ingest.header(raw).alias("h"))
    return h.select("source_file", *(F.col("h")[k].alias(a) for k, a in (("company", "company"), ("ticker", "ticker"), ("filing type", "form"), ("filing date", "filing_date"))))


def _raw_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, raw): filings put together from their headers and passages as the files they were."""
    c = _chunks(spark, sf_dir, "text", "item_section", "chunk_index", "source_file")
    part = F.struct("chunk_index", F.concat(F.replace("item_section", F.lit(" — "), F.lit(". ")), F.lit("\n\n"), F.col("text")).alias("t"))  # headings as filings write them
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n")  # one file is one row
    line = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(k + ": "), F.col(c), F.lit("\n"))).otherwise("")
    keys = (("Company", "company"), ("Ticker", "ticker"), ("Filing Type", "filing_type"), ("Filing Date", "filing_date"), ("CIK", "cik"), ("URL", "url"), ("Report Period", "report_period"))
    head = F.concat(*(line(k, c) for k, c in keys), F.lit("=" * 40 + "\n"))
    return table(spark, sf_dir, "filings").select("source_file", head.alias("head")).join(c.groupBy("source_file").agg(whole.alias("body")), "source_file").select("source_file", F.concat("head", "body").alias("raw"))


@query()
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings from their raw text: header, period, residue, sections, lost boundaries, passages, captions."""
    return ingest.chunk_filings(ingest.parsed(_raw_filings(spark, sf_dir)))


@query()
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.section_coverage(ingest.parsed(_raw_filings(spark, sf_dir)))


_KINDS = {"scale_caption": f"regexp_matches(line, '(?i){ingest.SCALE_CAPTION}')", "scaled_figure": f"regexp_matches(line, '{ingest.SCALED_FIGURE}')", "contents_row": f"regexp_full_match(line, '{ingest.CONTENTS_ROW.pattern}')"}
_KINDS["period_header"] = f"(length(line) - length(replace(line, '|', '')) >= 2 AND NOT {_KINDS['scaled_figure']} AND regexp_matches(line, '(?i){ingest.PERIOD_LABEL}'))"


@query("SELECT scale_caption, scaled_figure, period_header, contents_row, count(*) AS n FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _KINDS.items()) + f" FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {_CHUNKS})) GROUP BY ALL")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _chunks(spark, sf_dir, "text").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select(*(v.alias(k) for k, v in ingest.line_kinds(F.col("line")).items())).groupBy("scale_caption", "scaled_figure", "period_header", "contents_row").agg(F.count("*").alias("n"))


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace('us-gaap:Revenue http://fasb.org/x ' || text || chr(10) || 'abcd-1false2024FY000012 rest' || chr(10) || 'end', '{ingest.TAG}', ' ', 'g'), '{ingest.TAG_LINE}', '', 'g')) AS bare FROM documents WHERE text IS NOT NULL""")
def residue_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts into which tag residue was put, without it."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"]).where("text is not null")
    raw = F.concat(F.lit("us-gaap:Revenue http://fasb.org/x "), F.col("text"), F.lit("\nabcd-1false2024FY000012 rest\nend"))
    return d.select("doc_id", F.md5(ingest.without_residue(raw)).alias("bare"))


@query(f"SELECT source_file, count(*) AS sent, count(*) FILTER (WHERE token_count IS NOT NULL) AS landed FROM {_CHUNKS} GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE token_count IS NOT NULL)")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.sources.corpus import reconciled

    c = _chunks(spark, sf_dir, "source_file", "token_count")
    return reconciled(c.select("source_file"), c.where("token_count is not null").select("source_file"))


@query(r"""
  SELECT message_id, 'C' || n AS handle, company, excerpt FROM (
    SELECT id AS message_id, row_number() OVER (PARTITION BY id ORDER BY i) AS n, json_extract_string(x, '$.company') AS company, left(json_extract_string(x, '$.excerpt'), 300) AS excerpt
    FROM (SELECT id, unnest(range(json_array_length(citations)::BIGINT)) AS i, citations FROM messages WHERE citations IS NOT NULL AND json_valid(citations)), LATERAL (SELECT json_extract(citations, '$[' || i || ']') AS x))""")
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages", ["id", "citations"]).select("id", F.from_json("citations", "array<struct<company:string,excerpt:string>>").alias("c"))
    rows = m.where("c is not null").select("id", F.posexplode("c"))
    return rows.select(F.col("id").alias("message_id"), F.concat(F.lit("C"), F.col("pos") + 1).alias("handle"), F.col("col.company").alias("company"), F.substring("col.excerpt", 1, 300).alias("excerpt"))


_PREFIX = """coalesce(company, '') || ' (' || ticker || ') — ' || form_type || ', FY' || coalesce(fiscal_year::VARCHAR, '') || CASE WHEN coalesce(period_end, '') <> '' THEN ' (period ending ' || period_end || ')' ELSE '' END || ' — ' || item_section || ':'"""
_LABEL = """coalesce(company, '') || ' (' || ticker || ') | ' || form_type || ', ' || CASE WHEN coalesce(period_end, '') <> '' THEN 'period ending ' || period_end ELSE 'FY' || coalesce(fiscal_year::VARCHAR, '') END || ' | ' || item_section"""
_INCREMENTAL = "coalesce(form_type = '10-Q' AND contains(lower(item_section), 'risk factors'), false)"
_FACTS = ("company", "ticker", "form_type", "fiscal_year", "period_end", "item_section")


@query(f"SELECT chunk_id, {_LABEL} AS label, {_INCREMENTAL} AS incremental FROM {_CHUNKS}")
def passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir, *_FACTS)
    return c.select("chunk_id", T.passage_label(*map(F.col, _FACTS)).alias("label"), T.incremental_risk(F.col("form_type"), F.col("item_section")).alias("incremental"))


@query(f"SELECT chunk_id, md5({_PREFIX} || chr(10) || text) AS encoded FROM {_CHUNKS}")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir, "text", *_FACTS)
    return c.select("chunk_id", F.md5(T.embedding_text(T.contextual_prefix(*map(F.col, _FACTS)), F.col("text"))).alias("encoded"))


@query(r"SELECT id AS message_id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS question FROM messages WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> ''".replace("\\\\", "\\"))
def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without the blanks around them; blank ones are refused."""
    return table(spark, sf_dir, "messages", ["id", "content"]).select(F.col("id").alias("message_id"), T.asked(F.col("content")).alias("question")).where("question is not null")


def _listed(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None, excerpts: bool = False) -> DataFrame:
    """The 20 best passages of each question with what an answer needs of them; of texts, excerpts only where these do."""
    c = _chunks(spark, sf_dir, "text", *_FACTS, "source_file").withColumnRenamed("chunk_id", "key")
    c = c.withColumn("text", F.substring("text", 1, answer.EXCERPT)) if excerpts else c
    return _bm25(spark, sf_dir, 20, questions=questions).join(c, "key")


_LISTED = _base_named() + f", r AS (SELECT x.question, x.key, x.score, x.rank, c.* FROM ({_ranked_sql(20, False)}) x JOIN c ON c.chunk_id = x.key)"


@query(_whole(_LISTED) + " SELECT question, 'C' || rank AS handle, company, form_type, fiscal_year, period_end, item_section AS section, source_file, left(text, 300) AS excerpt FROM r")
def list_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.citations(_listed(spark, sf_dir, _asked(spark, sf_dir), True))


@query(_LISTED + " SELECT question, array_to_string(list_sort(list(DISTINCT company)), ';') AS companies FROM r GROUP BY 1")
def companies_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.companies_present(_listed(spark, sf_dir)).select("question", F.array_join("companies", ";").alias("companies"))


@query(_LISTED + f""", lost AS (SELECT question, list(name ORDER BY first) AS absent FROM (SELECT question, name, min(run_no * 10000 + i) AS first FROM loose WHERE NOT (n = 1 AND {_NAME.format('name')} IN ({_SQL_WORDS(planning.DESCRIPTORS)})) GROUP BY 1, 2) GROUP BY 1),
  parts AS (SELECT question, string_agg('[C' || rank || '] ' || {_LABEL} || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t, array_to_string(list_sort(list(DISTINCT company)), ', ') AS companies, coalesce(string_agg('C' || rank, ', ' ORDER BY rank) FILTER (WHERE {_INCREMENTAL}), '') AS changes FROM r GROUP BY 1),
  put AS (SELECT q.question, q.text, coalesce(p.t, '') AS t, coalesce(p.companies, '') AS companies, coalesce(p.changes, '') AS changes, coalesce(array_to_string(l.absent, ', '), '') AS absent, EXISTS (SELECT 1 FROM named n WHERE n.question = q.question) AS held
    FROM {_QUESTIONS} q LEFT JOIN parts p ON p.question = q.question LEFT JOIN lost l ON l.question = q.question)
  SELECT question, absent <> '' AND NOT held AS refuses, md5('Passages:' || chr(10) || chr(10) || t || CASE WHEN companies <> '' THEN chr(10) || chr(10) || 'Companies in the passages: ' || companies ELSE '' END ||
    CASE WHEN absent <> '' AND NOT held THEN chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'None of the passages is about ' || absent || ', for which no filings are held. Write {answer.SECTIONS[0]} and {answer.SECTIONS[3]} only: that the question cannot be answered, and what is missing. Cite nothing.'
    ELSE CASE WHEN absent <> '' THEN chr(10) || chr(10) || 'No filings are held for ' || absent || '; say so, and answer for the companies that are.' ELSE '' END ||
      CASE WHEN changes <> '' THEN chr(10) || chr(10) || changes || ' are quarterly risk sections: they state changes since the annual report, and are not the whole of the risks.' ELSE '' END || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || '{answer.FORMAT}' END) AS prompt FROM put""")
def context_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question, told by its hash, and whether it asks to refuse."""
    questions = _questions(spark, sf_dir)
    p = answer.prompts(questions, _listed(spark, sf_dir), _plans(spark, sf_dir, questions, False))
    return p.select("question", "refuses", F.md5("prompt").alias("prompt"))


_SCOPED = "SELECT DISTINCT ticker, fiscal_year, form_type, item_section IN ('Item 1A — Risk Factors', 'Part II Item 1A — Risk Factors') AS risk FROM chunks"


@query("WITH RECURSIVE " + _PLAN.format(asked=_ASKED) + f""", held AS MATERIALIZED ({_SCOPED}), years AS (SELECT min(fiscal_year) AS a, max(fiscal_year) AS b FROM chunks),
  p AS MATERIALIZED (SELECT w.question, w.years[1] AS lo, w.years[2] AS hi, w.form_type, coalesce(f.t, []) AS t FROM (SELECT question, {_YEARS} AS years, {_FORM} AS form_type FROM {_WINDOW.format(_ASKED)}) w LEFT JOIN (SELECT question, list(ticker ORDER BY mention) AS t FROM named GROUP BY 1) f ON f.question = w.question)
  SELECT question, 'empty_scope' AS status, md5('{answer.SECTIONS[0]}' || chr(10) || 'No passage matches ' || CASE WHEN s = '' THEN 'this question' ELSE 'what the question is limited to (' || s || ')' END || ', so it cannot be answered here.' || chr(10) || chr(10) || '{answer.SECTIONS[3]}' || chr(10) || 'The corpus covers ' ||
    CASE WHEN a = b THEN 'fiscal year ' || a ELSE 'fiscal years ' || a || '–' || b END || '. Nothing of another scope was put in the place of what was asked.' || chr(10) || chr(10) || '{answer.SECTIONS[4]}' || chr(10) || 'None.') AS answer FROM (
    SELECT question, array_to_string(list_filter([nullif(array_to_string(t, ', '), ''), CASE WHEN lo = hi THEN 'fiscal year ' || lo WHEN lo IS NOT NULL THEN 'fiscal years ' || lo || '–' || hi END, form_type || ' filings'], lambda x: x IS NOT NULL), ', ') AS s FROM p
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE (len(p.t) = 0 OR list_contains(p.t, h.ticker)) AND (p.lo IS NULL OR h.fiscal_year BETWEEN p.lo AND p.hi) AND (p.form_type IS NULL OR h.form_type = p.form_type OR (p.form_type = '10-Q' AND h.form_type = '10-K' AND h.risk)))), years""")
def no_match_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers, told by their hash, of the messages whose scope holds no passage at all."""
    p = written(_plans(spark, sf_dir, _asked(spark, sf_dir), False), "plans")
    c = table(spark, sf_dir, "chunks", ["ticker", "fiscal_year", "form_type", "item_section"])
    held = c.select("ticker", F.col("fiscal_year").alias("year"), F.col("form_type").alias("form"), F.col("item_section").isin(*search.RISK_SECTIONS).alias("risk")).distinct()
    forms = F.col("form_type").isNull() | (F.col("form") == F.col("form_type")) | ((F.col("form_type") == "10-Q") & (F.col("form") == "10-K") & F.col("risk"))
    inside = (F.col("lo").isNull() | F.col("year").between(F.col("lo"), F.col("hi"))) & forms
    scopes = p.select("lo", "hi", "form_type", F.explode_outer("tickers").alias("wanted")).distinct()  # few: a scope is asked for many times
    some = written(held, "held")
    met = scopes.where("wanted is not null").join(some, F.col("wanted") == F.col("ticker")).where(inside).select("lo", "hi", "form_type", "wanted").distinct()
    free = scopes.where("wanted is null").join(F.broadcast(some.drop("ticker").distinct()), inside, "left_semi")  # years, forms, risk: a few rows
    met = met.unionByName(free)
    each = p.select("question", F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("form_type").alias("f"), F.explode_outer("tickers").alias("w"))
    found = each.join(met, F.col("l").eqNullSafe(F.col("lo")) & F.col("h").eqNullSafe(F.col("hi")) & F.col("f").eqNullSafe(F.col("form_type")) & F.col("w").eqNullSafe(F.col("wanted"))).select("question")
    corpus = c.agg(F.count("*").alias("n"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))
    return answer.unmatched(p, found, corpus).select("question", "status", F.md5("answer").alias("answer"))


_USED = r"""(SELECT id, list_filter(regexp_extract_all(content, '\[(C\d+)\]', 1), lambda x, i: list_position(regexp_extract_all(content, '\[(C\d+)\]', 1), x) = i) AS used, list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(citations, '"id": ?"C(\d+)"', 1), lambda x: x::INT))), lambda x: 'C' || x) AS have, content
    FROM messages WHERE content IS NOT NULL AND citations IS NOT NULL AND regexp_matches(citations, '"id": ?"C\d+"'))"""


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "messages", ["id", "content", "citations"]).where("content is not null").select(F.col("id").alias("question"), F.col("content").alias("answer"), F.array_distinct(F.regexp_extract_all("citations", F.lit(r'"id": ?"(C\d+)"'), F.lit(1))).alias("have")).where("size(have) > 0")
    return m, m.select("question", F.explode("have").alias("handle"))


@query(f"""SELECT id AS question, array_to_string(good, ',') AS cited, array_to_string(list_filter(used, lambda h: NOT list_contains(have, h)), ',') AS fabricated, array_to_string(list_filter(have, lambda h: NOT list_contains(used, h)), ',') AS uncited, array_to_string(CASE WHEN len(good) > 0 THEN good ELSE have END, ',') AS shown
  FROM (SELECT *, list_filter(used, lambda h: list_contains(have, h)) AS good FROM {_USED})""")
def citation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of an answer that stand for passages, those that do not, passages that are not cited, and those to show."""
    return answer.checked(*_cited(spark, sf_dir)).select("question", *(F.array_join(c, ",").alias(c) for c in ("cited", "fabricated", "uncited", "shown")))


@query(f"""SELECT id AS question, md5(array_to_string(list_transform(regexp_extract_all(content, '(`[^`]*`|\\[[^\\]]*\\]\\([^)]*\\)|\\[C\\d+\\]|[^\\[`]+|.)', 1), lambda p: CASE WHEN regexp_full_match(p, '\\[C\\d+\\]') AND list_contains(have, regexp_extract(p, 'C\\d+')) THEN p || '(#m-cite-' || regexp_extract(p, 'C\\d+') || ')' ELSE p END), '')) AS linked FROM {_USED}""")
def linked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose handles are links to their passages, told by their hash."""
    m, _ = _cited(spark, sf_dir)
    return m.select("question", F.md5(T.linked_handles(F.col("answer"), F.col("have"), "m")).alias("linked"))


_RUNS = "(SELECT event_type AS config, lpad(event_id::VARCHAR, 12, '0') AS file, ts AS generated_at, round(value, 4) AS value FROM events)"
_NEWEST = f"(SELECT *, CAST(row_number() OVER (ORDER BY first_seen, config) AS INT) AS place FROM (SELECT *, min(generated_at) OVER (PARTITION BY config) AS first_seen FROM {_RUNS} QUALIFY row_number() OVER (PARTITION BY config ORDER BY generated_at DESC, file DESC) = 1))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of experiments, one metric each."""
    e = table(spark, sf_dir, "events", ["event_id", "event_type", "ts", "value"])
    none = F.array().cast("array<struct<id:string,suspect:string>>").alias("per_question")
    return e.select(F.col("event_type").alias("config"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file"), F.col("ts").alias("generated_at"), F.create_map(F.lit("value"), F.round("value", 4)).alias("metrics"), none)


@query(f"SELECT config, file, first_seen, place, value FROM {_NEWEST}")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.newest_per_config(_runs(spark, sf_dir)).select("config", "file", "first_seen", "place", F.col("metrics.value").alias("value"))


@query(f"SELECT 'value' AS metric, a.config AS baseline_config, b.config AS latest_config, a.value AS baseline, b.value AS latest, round(b.value - a.value, 4) AS delta FROM {_NEWEST} a, {_NEWEST} b WHERE a.place = 1 AND b.place = (SELECT max(place) FROM {_NEWEST}) AND b.place > 1")
def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.deltas(summary.newest_per_config(_runs(spark, sf_dir)))


@query(f"SELECT count(DISTINCT file) AS n_result_files, count(DISTINCT config) AS n_configurations, 0::BIGINT AS n_flagged FROM {_RUNS}")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.counts(_runs(spark, sf_dir)).select("n_result_files", "n_configurations", F.col("n_flagged").cast("long").alias("n_flagged"))


_FORMS = "list_concat([v::VARCHAR], list_transform([0, 1, 2, 3, 4], lambda p: format('{:.' || p || 'f}', v)), CASE WHEN abs(v) <= 1 THEN list_concat(list_transform([0, 1, 2], lambda p: format('{:.' || p || 'f}', v * 100)), list_transform([0, 1, 2], lambda p: format('{:.' || p || 'f}', v * 100) || '%')) ELSE [] END)"


@query(f"SELECT event_id, array_to_string(list_sort(list_distinct(list_concat({_FORMS}, {_FORMS.replace('v::VARCHAR', 'abs(v)::VARCHAR').replace(', v)', ', abs(v))').replace(', v * 100)', ', abs(v) * 100)')}))), ' ') AS forms FROM (SELECT event_id, round(value, 4) AS v FROM events WHERE value IS NOT NULL)")
def allowed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways in which each event's value may be written."""
    e = table(spark, sf_dir, "events", ["event_id", "value"]).where("value is not null")
    return e.select("event_id", F.array_join(summary.allowed_figures(F.array(F.round("value", 4))), " ").alias("forms"))


@query(r"""SELECT id AS message_id, array_to_string(f, ' ') AS figures, array_to_string(list_filter(f, lambda x: NOT list_contains(a, x) AND NOT list_contains(a, rtrim(x, '%'))), ' ') AS unverified FROM (
  SELECT id, list_filter(regexp_extract_all(content, '\d+(?:\.\d+)?%?'), lambda x, i: list_position(regexp_extract_all(content, '\d+(?:\.\d+)?%?'), x) = i) AS f, regexp_extract_all(citations, '\d+(?:\.\d+)?%?') AS a FROM messages WHERE content IS NOT NULL AND citations IS NOT NULL)""")
def figure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of each answer that none of its citations states."""
    m = table(spark, sf_dir, "messages", ["id", "content", "citations"]).where("content is not null and citations is not null")
    checked = summary.verified(m, "content", T.figures(F.col("citations")))
    return checked.select(F.col("id").alias("message_id"), F.array_join("figures", " ").alias("figures"), F.array_join("unverified", " ").alias("unverified"))


@query(_METRICS + """ SELECT m.question, CASE WHEN coalesce(h10, 0) > 0 THEN '' WHEN nf20 > 0 AND m.n_relevant > 2 * nf20 THEN 'the label names ' || m.n_relevant || ' files, but ' || nf20 || ' distinct files stand in the first 10: its breadth is suspect' ELSE 'no labelled file was found: the search or the probe is suspect' END AS suspect
  FROM m LEFT JOIN p ON p.question = m.question LEFT JOIN (SELECT question, count(DISTINCT file) AS nf20 FROM r GROUP BY 1) x ON x.question = m.question""")
def suspect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _, per = _scored(spark, sf_dir)
    files = ranked.groupBy("question").agg(F.countDistinct("file").alias("n_files"))
    return per.join(files, "question", "left").select("question", evaluation.suspect(F.col("recall_10"), F.col("n_relevant"), F.coalesce("n_files", F.lit(0))).alias("suspect"))


@query(_METRICS + f" SELECT 'bm25' AS config, 20 AS k, count(*)::INT AS n_scored, (SELECT count(*) FROM {_QUESTIONS} q WHERE q.question NOT IN (SELECT question FROM nrel))::INT AS n_unanswerable, round(avg(round(recall_10, 6)), 4) AS recall_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM m")
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of an evaluation over the questions, labelled by the companies that they name; those that name none count
    as unanswerable."""
    ranked, named, _ = _scored(spark, sf_dir)
    files = named.join(table(spark, sf_dir, "filings", ["ticker", "source_file"]), "ticker").groupBy("question").agg(F.collect_set("source_file").alias("source_files"), F.collect_set("ticker").alias("tickers"))
    q = _questions(spark, sf_dir).select("question").join(files, "question", "left").select(F.col("question").alias("id"), F.when(F.col("tickers").isNull(), "unanswerable").otherwise("named").alias("category"), "tickers", "source_files", F.array().cast("array<int>").alias("expect_fiscal_years"))
    doc = evaluation.run(q, ranked.withColumnRenamed("entity", "ticker"), evaluation.config_label("bm25", False), F.lit("2026-01-01T00:00:00"))
    return doc.select("config", "k", "n_scored", "n_unanswerable", *(F.col(f"overall.{c}").alias(c) for c in ("recall_10", "mrr", "ndcg")))


_GOLDEN = (("g1", "Supply Chain", None, None, None), ("g2", "jury verdict", None, 2016, 2020), ("g3", "freight contract", ["HAA", "KRAF", "DOOF"], None, None))


@query(f"""SELECT DISTINCT p.id, c.source_file FROM {_CHUNKS} c JOIN (VALUES {', '.join(f"('{i}', '{t.lower()}', {k or 'NULL'}::VARCHAR[], {a or 'NULL'}, {b or 'NULL'})" for i, t, k, a, b in _GOLDEN)}) AS p(id, probe, tickers, lo, hi)
  ON contains(lower(c.text), p.probe) AND (p.tickers IS NULL OR list_contains(p.tickers, c.ticker)) AND (p.lo IS NULL OR c.fiscal_year BETWEEN p.lo AND p.hi)""")
def golden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the probes of a golden set label, within their tickers and years."""
    probes = spark.createDataFrame(list(_GOLDEN), "id string, probe string, tickers array<string>, lo int, hi int")
    return evaluation.labels(_chunks(spark, sf_dir, "text", "ticker", "source_file", "fiscal_year"), probes)


@query(f"SELECT m.id, m.role FROM messages m JOIN (SELECT id, user_id FROM {_CONV} ORDER BY id LIMIT 1) c ON m.conversation_id = c.id")
def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of one user's conversation, the first by id."""
    conversations = _conversations(spark, sf_dir)
    one = conversations.orderBy("id").select("id", "user_id").first()
    return history.messages_of(table(spark, sf_dir, "messages", ["id", "conversation_id", "role"]), conversations, one.id, one.user_id).select("id", "role")
