"""Hand-worked cases and brute-force versions of the core operators."""

import difflib
import json
import math
import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import answer, coverage, evaluation, history, ingest, planning, search, summary
from orrery.sources import corpus


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


# ---- text rules


def test_names(spark):
    f = lambda s: " ".join(one(spark, T.normalised_name(F.col("n")), n=s).split())
    assert f("Harbour & Quill Co.") == "harbour quill" and f("Tide.io Holdings, LP") == "tide io" and f("The Ash and Elm Group") == "ash elm" and f(None or "") == ""


def test_titles(spark):
    f = lambda s: one(spark, T.title(F.col("n")), n=s)
    assert f("  \n ") == "New chat" and f("a  b") == "a b"
    long = f("word " * 30)
    assert len(long) <= 61 and long.endswith("word…")
    assert f("x" * 80) == "x" * 60 + "…"


def test_handles_and_figures(spark):
    assert one(spark, T.citation_handles(F.col("n")), n="[C1][C2] adjacent [C1] [c3] C4 [C1, C3]") == ["C1", "C2"]
    assert one(spark, T.figures(F.col("n")), n="5% of 5.25 and 5%") == ["5%", "5.25"]


@pytest.mark.parametrize("q, want", [("growth in 2023", (2023, 2023)), ("since 2023", (2023, 2025)), ("between 2019 and 2021", (2019, 2021)), ("the last three years", (2023, 2025)), ("the past couple of years", (2024, 2025)), ("last couple years", (2024, 2025)), ("recent 5 fiscal years", (2021, 2025)), ("in 1998 or 2030", (1998, 2030)), ("in 12019", None), ("no year", None), ("", None)])
def test_year_windows(spark, q, want):
    w = one(spark, T.year_window(F.col("n"), F.lit(2025)), n=q)
    assert (w and tuple(w)) == want


@pytest.mark.parametrize("q, want", [("the quarterly report", "10-Q"), ("annual 10-K", "10-K"), ("annual and quarterly", None), ("neither", None), ("10Q of Q3", "10-Q"), ("full-year", "10-K"), ("fiscal year end 10-q", None)])
def test_form_hints(spark, q, want):
    assert one(spark, T.form_hint(F.col("n")), n=q) == want


@pytest.mark.parametrize(
    "period, url, filed, form, want",
    [("2025-10-26", None, "2025-11-01", "10-Q", ("2025-10-26", 2025)), (None, "http://x/ab-20251231.htm", "2026-02-06", "10-K", ("2025-12-31", 2025)), (None, "http://x/de-20251102x10k.htm", "2025-12-01", "10-K", ("2025-11-02", 2025)), (None, "http://x/gecc10k2014.htm", "2015-02-27", "10-K", ("", 2014)), (None, None, "2015-07-27", "10-Q", ("", 2015))],
)
def test_fiscal_periods(spark, period, url, filed, form, want):
    assert tuple(one(spark, T.fiscal_period(*(F.col(c) for c in "abcd")), a=period, b=url, c=filed, d=form)) == want


def test_point_ids(spark):
    got = one(spark, ingest.point_id(F.col("f"), F.col("i")), f="A_10K.txt", i="7")
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "A_10K.txt#7"))


# ---- ranking


def ranked(spark, groups):
    return spark.createDataFrame([(1, g, i + 1) for i, g in enumerate(groups)], "question int, file string, rank int")


@pytest.mark.parametrize("groups, limit, cap, want", [("aaaaabbbcc", 3, 9, "abc"), ("aab", 3, 2, "aba"), ("aaa", 5, 2, "aa")])
def test_diverse(spark, groups, limit, cap, want):
    got = search.diverse(ranked(spark, groups), "file", limit, cap).orderBy("position").collect()
    assert "".join(r.file for r in got) == want


def test_diverse_equals_a_loop(spark):
    rng = random.Random(1)
    for _ in range(5):
        groups = [rng.choice("abcd") for _ in range(12)]
        want, used = [], [0] * 12
        for turn in range(1, 3):
            seen: dict[str, int] = {}
            for i, g in enumerate(groups):
                seen[g] = seen.get(g, 0) + 1
                if seen[g] == turn:
                    want.append(i + 1)
        got = [r["rank"] for r in search.diverse(ranked(spark, groups), "file", 6, 2).orderBy("position").collect()]
        assert got == want[:6] and used


def test_fusion_does_not_depend_on_the_order_of_legs(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "question int, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "question int, key string, rank int")
    x, y = (sorted(map(tuple, search.fuse(legs, 5).collect())) for legs in ([a, b], [b, a]))
    assert x == y and max(x, key=lambda r: r[2])[1] == "y"


def test_distinct_content(spark):
    texts = ["one risk factor of the year two thousand twenty two " * 3, "one risk factor of the year two thousand twenty two " * 3, "entirely other words stand in this passage about ships and ports"]
    df = spark.createDataFrame([(1, f"k{i}", i + 1, t) for i, t in enumerate(texts)], "question int, key string, rank int, text string")
    assert [r.key for r in search.distinct_content(df, "text").orderBy("rank").collect()] == ["k0", "k2"]


def test_dense_against_numpy(spark):
    rng = random.Random(2)
    v = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, e array<double>")
    got = search.dense(df, "id", "e", df.where("id in (3, 5)").selectExpr("id as question", "e as vector"), 4).collect()
    cos = lambda a, b: sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))
    for q in (3, 5):
        want = sorted(range(40), key=lambda i: (-round(cos(v[q], v[i]), 6), i))[:4]
        assert [r.key for r in sorted(got, key=lambda r: r["rank"]) if r.question == q] == want
    assert search.dense(df, "id", "e", df.where("false").selectExpr("id as question", "e as vector"), 4).count() == 0


def test_scope(spark):
    risk = "Item 1A — Risk Factors"
    c = spark.createDataFrame([("A", 2020, "10-K", risk), ("A", 2020, "10-K", "Item 7 — x"), ("A", 2021, "10-Q", "Item 2 — x"), ("B", 2020, "10-Q", "x"), ("A", None, "10-Q", "x")], "t string, y int, f string, s string")
    plan = F.struct(F.lit("A").alias("ticker"), F.lit(2020).alias("lo"), F.lit(2021).alias("hi"), F.lit("10-Q").alias("form_type"))
    got = c.where(search.in_scope(F.col("t"), F.col("y"), F.col("f"), F.col("s"), plan)).collect()
    assert sorted((r.y, r.s) for r in got) == [(2020, risk), (2021, "Item 2 — x")]


def test_budgets(spark):
    got = spark.range(1, 6).select(search.budget(20, F.col("id")).alias("b")).collect()
    assert [r.b for r in got] == [20, 10, 6, 6, 6]


# ---- evaluation


def scored(spark, files, relevant, **kw):
    r = spark.createDataFrame([("q", f, i + 1) for i, f in enumerate(files)], "question string, file string, rank int")
    rel = spark.createDataFrame([("q", f) for f in relevant], "question string, file string")
    return evaluation.scores(r, rel, **kw).first()


def test_metrics_by_hand(spark):
    r = scored(spark, "axcy", "abcd", ks=(2, 4), rank_k=10)
    assert (r.recall_4, r.recall_2) == (0.5, 0.25)
    assert scored(spark, ["a"] * 20, "ab").recall_20 == 0.5
    assert scored(spark, "abc", "c").mrr == pytest.approx(1 / 3, abs=1e-6) and scored(spark, "ab", "c", rank_k=2).mrr == 0
    assert scored(spark, "xab", "ab", rank_k=3).ndcg == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)), abs=1e-6)
    r = scored(spark, [f"f{i}" for i in range(5)], [f"f{i}" for i in range(36)])
    assert r.attainable_recall_5 == 1.0 and r.recall_5 == pytest.approx(5 / 36, abs=1e-6)


def test_entity_coverage(spark):
    r = spark.createDataFrame([("q", "AAPL", 1), ("q", "AAPL", 2), ("q", "TSLA", 3)], "question string, entity string, rank int")
    n = spark.createDataFrame([("q", ["AAPL", "TSLA", "JPM"]), ("none", [])], "question string, entities array<string>")
    assert {x.question: x.coverage for x in evaluation.entity_coverage(r, n).collect()} == {"q": pytest.approx(2 / 3, abs=1e-6), "none": None}


def test_coverage(spark):
    rows = [("q", i + 1, "OAK", "Oakline", "o1", "2020") for i in range(7)] + [("q", 8 + i, "FIR", "Firth", f"f{i}", "2021") for i in range(2)] + [("q", 20, None, "x", "z", "")]
    r = spark.createDataFrame(rows, "question string, rank int, ticker string, company string, source_file string, period_end string")
    filings = spark.createDataFrame([("OAK",), ("FIR",), ("FIR",), ("ELM",), ("",)], "ticker string")
    c = coverage.by_company(r, filings)
    assert {x.ticker: (x.passages, x.filings_retrieved, x.filings_in_corpus, x.thin) for x in c.collect()} == {"OAK": (7, 1, 1, True), "FIR": (2, 2, 2, False), "?": (1, 1, 1, True)}
    gone = coverage.absent(spark.createDataFrame([("q", "ELM"), ("q", "OAK"), ("q", "XXX")], "question string, ticker string"), c, filings)
    assert [x.ticker for x in gone.collect()] == ["ELM"]
    assert coverage.sentence(c.where("ticker <> '?'"), gone).first().sentence == "Evidence comes from FIR (2 of 2 filings) and OAK (1 of 1 filings). Only one filing is held for OAK. Nothing was retrieved for ELM."


# ---- planning


NAMES = [("HQ", "Harbour & Quill Co.", "f1"), ("V", "Vantor Inc", "f2"), ("QLLM", "Quill Mills Ltd", "f3"), ("COST", "Costa Verde Foods Corp", "f4"), ("NIM", "Nimbus Bank Holdings", "f5"), ("BRD", "Bank of Redmoor", "f6")]


def names_table(spark):
    return spark.createDataFrame(NAMES, "ticker string, company string, first_file string")


def test_aliases(spark):
    got = {r.alias: (r.ticker, r.kind) for r in planning.alias_dictionary(names_table(spark), {"reddy": "BRD", "gone": "XXX"}).collect()}
    assert got["hq"] == ("HQ", "ticker") and got["harbour   quill"] == ("HQ", "name") and got["harbour"] == ("HQ", "word") and got["reddy"] == ("BRD", "colloquial")
    assert not {"quill", "bank", "of", "gone"} & set(got) and got["vantor"] == ("V", "name")  # two owners, descriptors, not held


def test_near_misses_equal_difflib(spark):
    alias = {"vantor": "V", "nimbus": "NIM", "redmoor": "BRD", "harbour quill": "HQ", "costa": "COST"}
    a = spark.createDataFrame([(k, v, "name") for k, v in alias.items()], "alias string, ticker string, kind string")
    rng = random.Random(4)
    words = {"vantr", "nimbuss", "redmor", "redmooor", "costas", "harbor quill", "vandal", "nimble", "cost", *alias}
    words |= {"".join(rng.choice("vantorimbsue") for _ in range(rng.randint(4, 8))) for _ in range(60)}
    got = {r.word: r.alias for r in planning.near_miss(spark.createDataFrame([(w,) for w in words], "w string"), "w", a).collect()}
    want = {}
    for w in words:
        near = difflib.get_close_matches(w, [k for k in alias if abs(len(k) - len(w)) <= 1], 1, 0.85) if len(w) >= 5 else []
        want |= {w: near[0]} if near else {}
    assert got == want and len(want) > 6
    solved = {r.name: r.ticker for r in planning.resolved(spark.createDataFrame([("Vantor, Inc.",), ("Redmor",), ("Zenith",)], "n string"), "n", a).collect()}
    assert solved == {"Vantor, Inc.": "V", "Redmor": "BRD", "Zenith": None}


def plan_by_hand(question, aliases, tickers, fuzzy):
    """The rule, word by word."""
    name = lambda s: re.sub(r"[^a-z0-9 ]+", " ", re.sub(rf"[\s,]*\b(?:{'|'.join(T.NAME_SUFFIXES)})\b\.?", " ", s.lower())).strip(" ")
    found, lost = [], []
    for m in re.finditer(T.RUN, question):
        words, i, open_ = re.sub(T.POSSESSIVE, "", m[1]).split(), 0, []

        def close(open_=open_):
            if open_ and not (len(open_) == 1 and name(open_[0]) in planning.DESCRIPTORS):
                lost.append(" ".join(open_))
            open_.clear()

        while i < len(words):
            spans = [(e, " ".join(words[i:e])) for e in range(len(words), i, -1)]
            hit = next(((e, s if len(s) <= 2 else aliases[name(s)]) for e, s in spans if (s in tickers if len(s) <= 2 else name(s) in aliases)), None)
            for e, s in spans if fuzzy and hit is None else ():
                n = name(s)
                near = difflib.get_close_matches(n, [k for k in aliases if len(k) >= 5 and abs(len(k) - len(n)) <= 1], 1, 0.85) if len(s) > 2 and len(n) >= 5 and n not in planning.VOCABULARY else []
                if near:
                    hit = (e, aliases[near[0]])
                    break
            if hit:
                close()
                i = hit[0]
                found.append(hit[1])
                continue
            w = words[i]
            if name(w) in planning.VOCABULARY or w.lower() in ("and", "the") or len(w) <= 2:
                close()
            else:
                open_.append(w)
            i += 1
        close()
    return list(dict.fromkeys(found)), list(dict.fromkeys(lost))


QUESTIONS = [
    "Compare Harbour and Quill's risks with Bank of Redmoor", "How did the cost of sales change?", "Did V or v grow since 2019?", "What does Costa Verde Foods say", "Vantr and Nimbuss in the last two years",
    "Spotter and Zenith Motors annual filings", "What about Technologies?", "HQ, COST and NIM", "Harbour Quill Zenith Vantor", "", "nothing", "Is Quill Mills or Quill older?", "Bank of America Bank of Redmoor", "The Item 7 of NIMBUS", "Qué dice Redmoor",
]


@pytest.mark.parametrize("fuzzy", [False, True])
def test_plans_equal_the_rule(spark, fuzzy):
    a = planning.alias_dictionary(names_table(spark))
    aliases, tickers = {r.alias: r.ticker for r in a.collect()}, {t for t, *_ in NAMES}
    rng = random.Random(7)
    pool = ["Harbour", "Quill", "Mills", "Bank", "of", "Redmoor", "V", "and", "Vantor", "Risk", "Zenith", "Motors", "Technologies", "COST", "costs", "the", "Nimbus", "Compare", "&"]
    questions = QUESTIONS + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    q = spark.createDataFrame(list(enumerate(questions)), "id int, text string")
    got = {r.question: (r.tickers, r.unresolved) for r in planning.plans(q, "id", "text", a, spark.createDataFrame([(2024,)], "y int"), fuzzy).collect()}
    assert got == {i: plan_by_hand(t, aliases, tickers, fuzzy) for i, t in enumerate(questions)}


def test_plans_by_hand(spark):
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, text string")
    p = {r.question: r for r in planning.plans(q, "id", "text", planning.alias_dictionary(names_table(spark)), spark.createDataFrame([(2024,)], "y int")).collect()}
    assert p[0].tickers == ["HQ", "BRD"] and p[1].tickers == [] and p[2].tickers == ["V"] and (p[2].lo, p[2].hi) == (2019, 2024)
    assert p[3].tickers == ["COST"] and p[4].tickers == ["V", "NIM"] and (p[4].lo, p[4].hi) == (2023, 2024)
    assert p[5].unresolved == ["Spotter", "Zenith Motors"] and p[5].form_type == "10-K" and p[6].unresolved == []
    assert [(r.ticker, r.mention) for r in planning.mentioned(spark.createDataFrame([(7, p[7].tickers)], "question int, tickers array<string>")).collect()] == [("HQ", 1), ("COST", 2), ("NIM", 3)]


def chunk_rows(spark, rows):
    return spark.createDataFrame([(k, t, f, y, form, "Item 1", x) for k, t, f, y, form, x in rows], "chunk_id string, ticker string, source_file string, fiscal_year int, form_type string, item_section string, text string")


def test_retrieval_follows_the_whole_plan(spark):
    q = spark.createDataFrame([(1, "Where is lithium scarce in 2020?"), (2, "Lithium at Vantr"), (3, "Annual lithium of Nimbus and Vantor"), (4, "Lithium in 1950")], "question int, text string")
    p = planning.plans(q, "question", "text", planning.alias_dictionary(names_table(spark)), spark.createDataFrame([(2021,)], "y int"))
    rows = [("m20", "V", "a", 2020, "10-K", "lithium one"), ("m21", "V", "b", 2021, "10-Q", "lithium two words"), ("t20", "NIM", "c", 2020, "10-K", "lithium three words here")]
    rows += [(f"t{i}", "NIM", f"d{i}", 2019, "10-K", "lithium lithium copied in every filing again") for i in range(30, 40)]
    got, c = {}, chunk_rows(spark, rows)
    for r in search.retrieve_for(c, q, p).orderBy("place").collect():
        got.setdefault(r.question, []).append((r.ticker, r.key))
        assert r.max_score >= r.top_score > 0
    assert sorted(got[1]) == [(None, "m20"), (None, "t20")] and sorted(got[2]) == [("V", "m20"), ("V", "m21")] and 4 not in got
    assert got[3] == [("NIM", "t30"), ("NIM", "t20"), ("V", "m20")] or got[3] == [("NIM", "t20"), ("NIM", "t30"), ("V", "m20")] or [t for t, _ in got[3]] == ["NIM", "NIM", "V"]
    assert search.retrieve_for(c.where("false"), q, p).count() == 0
    flags = {r.reranked for r in search.retrieve_for(c, q, p, scorer=None).collect()}
    assert flags == {False}


def test_shares_of_many_companies(spark):
    """Six rows each: a fourth company gets what is left of twenty, a fifth nothing, unless shares are strict."""
    tickers = ["HQ", "V", "NIM", "BRD", "COST"]
    c = chunk_rows(spark, [(f"{t}{i}", t, f"{t}{i}", 2020, "10-K", f"lithium {t} words{i} " + " ".join(f"{t}{i}x{j}" for j in range(9))) for t in tickers for i in range(9)])
    q = spark.createDataFrame([(1, "Lithium of Harbour and Quill, V, Nimbus, Redmoor, and Costa")], "question int, text string")
    p = planning.plans(q, "question", "text", planning.alias_dictionary(names_table(spark)), spark.createDataFrame([(2021,)], "y int"))
    count = lambda **kw: {t: n for t, n in search.retrieve_for(c, q, p, **kw).where("place <= 20").groupBy("ticker").count().collect()}
    assert count() == {"HQ": 6, "V": 6, "NIM": 6, "BRD": 2} and count(strict=True) == dict.fromkeys(tickers, 4)


def test_scopes_of_dense_search_equal_the_filter(spark):
    rng = random.Random(3)
    rows = [(f"k{i:03}", rng.choice(["A", "B", None]), rng.choice([2019, 2020, 2021, None]), rng.choice(["10-K", "10-Q"]), rng.choice([*search.RISK_SECTIONS, "Item 2"]), [rng.random() for _ in range(4)]) for i in range(120)]
    c = spark.createDataFrame(rows, "id string, ticker string, fiscal_year int, form_type string, item_section string, v array<double>")
    plans = [(i, [rng.random() for _ in range(4)], (t, lo, hi, f)) for i, (t, lo, hi, f) in enumerate([("A", None, None, None), (None, 2020, 2021, "10-Q"), ("B", 2019, 2019, "10-K"), (None, None, None, None)])]
    q = spark.createDataFrame(plans, "question int, vector array<double>, plan struct<ticker:string,lo:int,hi:int,form_type:string>")
    got = {}
    for r in search.dense(c, "id", "v", q, 7, {x: x for x in ("ticker", "fiscal_year", "form_type", "item_section")}).collect():
        got.setdefault(r.question, {})[r["rank"]] = r.key
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)
    for i, v, (t, lo, hi, f) in plans:
        inside = [r for r in rows if (t is None or r[1] == t) and (lo is None or r[2] is not None and lo <= r[2] <= hi) and (f is None or r[3] == f or f == "10-Q" and r[4] in search.RISK_SECTIONS)]
        want = sorted(inside, key=lambda r: (-cos(r[5], v), r[0]))[:7]
        assert [got[i][n + 1] for n in range(len(want))] == [r[0] for r in want]


def test_lists_longer_than_a_thousand_are_kept(spark):
    r = spark.range(1500).select(F.lit(1).alias("question"), F.col("id").cast("string").alias("file"), (F.col("id") + 1).alias("rank"))
    assert search.diverse(r, "file", 1500).count() == 1500


def test_reranking(spark):
    rows = [(1, "a", 1, 0.9, "x y"), (1, "b", 2, 0.5, "tax levy"), (1, "c", 3, 0.4, "tax"), (2, "d", 1, 0.2, "tax")]
    df = spark.createDataFrame(rows, "question int, key string, rank int, score double, text string").withColumn("asked", F.lit("the tax levy"))
    got = search.reranked(df, "asked", "text", search.overlap_score).orderBy("question", "rank").collect()
    assert [(r.key, r.score, r.reranked) for r in got] == [("b", 0.5, True), ("c", 0.4, True), ("a", 0.9, True), ("d", 0.2, False)]
    assert [r.key for r in search.reranked(df, "asked", "text", None).orderBy("question", "rank").collect()] == ["a", "b", "c", "d"]


# ---- ingest


def test_header(spark):
    raw = "Company: A: B Inc\nTicker: AB\nEmpty:\nticker: ABC\n" + "=" * 30 + "\nBody: text"
    assert one(spark, ingest.header(F.col("r")), r=raw) == {"company": "A: B Inc", "ticker": "ABC"}
    assert one(spark, ingest.header(F.col("r")), r="no header") == {} and one(spark, ingest.body(F.col("r")), r="no header") == "no header"


def test_reflow_by_hand():
    assert ingest.reflowed("paid the ferry.Harbour dues fell") == "paid the ferry.\n\nHarbour dues fell"
    assert ingest.reflowed("see Form 10-K.ITEM 1A. Risks") == "see Form 10-K.\n\nITEM 1A. Risks"
    for s in ("in the U.S.Ports grew", "Quill Inc.Ports grew", "of the I.R.S.Rules", "see Fig.Two", "approx.Ten", "no join here. None", "xAI and MyPower run", "Alpha | Beta Gamma DeltaTwo rows here"):
        assert ingest.reflowed(s) == s
    assert ingest.reflowed("Port Dues and Harbour FeesWe pay them") == "Port Dues and Harbour Fees\n\nWe pay them"
    assert ingest.reflowed("the dues that weWe pay them") == "the dues that weWe pay them"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB.\"! \nU", max_size=80))
def test_reflow_only_adds_blank_lines(s):
    assert ingest.reflowed(s).replace("\n", "") == s.replace("\n", "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Item 1 — Business\n", "Item 1A. Risk Factors\n", "words and words. ", "“Item 3. Legal Proceedings” ", "Item 7. Management's Discussion | 12\n"]), max_size=12))
def test_sections_tile_the_text(parts):
    text = "".join(parts)
    spans = ingest.sections(text, "10-K")
    assert "".join(text[a:b] for _, a, b in spans) == text


def test_windows():
    count = lambda s: len(s.split())
    text = "\n\n".join(" ".join([f"w{i}"] * 100) for i in range(30))
    got = ingest.windows(text, count)
    assert all(20 <= count(w) <= 800 for w in got) and {w for x in got for w in x.split()} == {f"w{i}" for i in range(30)}
    assert got[1].split()[0] == got[0].split()[-1]  # the overlap is one whole piece
    assert ingest.windows("short") == [] and ingest.windows("") == []
    text = "Costs of $1,200.5 in the U.S. rose -- see   Note 4.\t" * 200
    cut = ingest.hard_windows(text)
    assert all(w in text for w in cut) and all(len(ingest.tokens(w)) <= 800 for w in cut) and "$1,200.5 in the U.S. rose -- see   Note" in cut[0]
    assert len(ingest.hard_windows("x " * 2000)) == 3 and ingest.hard_windows("") == []


@pytest.mark.parametrize("heading, found", [("Item 7. Management’s Discussion", True), ("ITEM\xa07:\xa0 Management's discussion", True), ("Item 1A. | Risk Factors", True), ("Item 1A | Risk Factors | 14", False), ("“Item 1A. Risk Factors”", False), ("Item 1A— Risk\nFactors", True), ("Items 1A Risk Factors", False)])
def test_headings(heading, found):
    text = "Preface of the filing.\n" + heading + "\nText. " * 40
    assert any(label != "Unlabelled section" for label, _, _ in ingest.sections(text, "10-K")) == found
    assert ingest.sections("", "10-K") == [] and ingest.sections("x" * 500 + "Item 1. Business", None) == [("Unlabelled section", 0, 516)]


def test_captions(spark):
    yes = ["(in thousands of dollars", "Amounts in millions", "$ in billions, unaudited"]
    no = ["The board spoke in thousands of words", "millions of visitors came in 2019"]
    assert all(ingest._SCALE.search(x) for x in yes[1:]) and not ingest._SCALE.search(no[1])
    lines = ["| Port | $ 12 |", "| Port | 13 | 4.25 |", "| Port | 13 |", "|  | Q3 | Sep 30 |", "| a | b |", "Item 3 | 41"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    k = [r for r in df.select("i", *(v.alias(n) for n, v in ingest.line_kinds(F.col("line")).items())).orderBy("i").collect()]
    assert [r.scaled_figure for r in k] == [True, True, False, False, False, False] and [r.period_header for r in k] == [False, False, False, True, False, False] and k[5].contents_row
    assert [ingest.is_period_header(x) for x in lines] == [r.period_header for r in k]
    section = "(in thousands)\n|  | 2031 | 2030 |\n| Dues | 4,500 | 3,100 |\nOne remark.\n| Fees | 1,050 | 990 |"
    assert ingest.with_caption(section, "| Fees | 1,050 | 990 |") == "(in thousands)\n|  | 2031 | 2030 |\n| Fees | 1,050 | 990 |"
    prose = "(in thousands)\none\ntwo\n| t | 1 |\nthree\nfour\n| Fees | 1,050 |"
    assert ingest.with_caption(prose, "| Fees | 1,050 |").startswith("(in thousands)")  # a table's line starts the count again
    assert ingest.with_caption("(in thousands)\none\ntwo\nthree\n| Fees | 1,050 |", "| Fees | 1,050 |") == "| Fees | 1,050 |"


def test_chunking(spark):
    body = "Item 1. Business\n" + "We make things. " * 60 + "\nItem 1A: Risk Factors\n" + "Things may break. " * 60
    f = spark.createDataFrame([("f.txt", body, "A", "AB", "1", "10-K", 2020, "2020-12-31", "2021-02-01"), ("g.txt", None, "A", "AB", "1", "10-K", 2020, "", "2021-02-01")], "source_file string, body string, company string, ticker string, cik string, form_type string, fiscal_year int, period_end string, filing_date string")
    got = ingest.chunk_filings(f).collect()
    assert [r.chunk_id for r in got] == ["AB-10K-FY2020-2021-02-01-item1-0000", "AB-10K-FY2020-2021-02-01-item1a-0001"]


def test_filing_from_raw_text(spark):
    head = "Company: Quill Mills Ltd\nTicker: QLLM\nFiling Type: 10-Q\nFiling Date: 2031-05-02\nCIK: 0007\nReport Period: 2031-03-31\n" + "=" * 30 + "\n"
    text = "us-gaap:Assets Preface\nItem 1. Financial Statements | 3\nItem 1. | Financial Statements\n" + "We mill wheat. " * 30 + "\nItem 2. Management’s Discussion\n" + "As said in “Item 1A. Risk Factors” we mill. " * 20 + "\nItem 1. Legal Proceedings\n" + "No suits. " * 40
    raw = spark.createDataFrame([("q.txt", head + text), ("bare.txt", "No header at all. " * 30), ("none.txt", None), ("empty.txt", "")], "source_file string, raw string")
    got = ingest.chunk_filings(ingest.parsed(raw)).collect()
    assert [r.item_section for r in got if r.source_file == "q.txt"] == ["Item 1 — Financial Statements", "Item 2 — Management's Discussion and Analysis", "Part II Item 1 — Legal Proceedings"]
    q = next(r for r in got if r.source_file == "q.txt")
    assert (q.fiscal_year, q.period_end, q.company, q.cik) == (2031, "2031-03-31", "Quill Mills Ltd", "0007") and "us-gaap" not in q.text
    bare = [r for r in got if r.source_file == "bare.txt"]
    assert len(bare) == 1 and bare[0].item_section == "Unlabelled section" and bare[0].company == "" and {r.source_file for r in got} == {"q.txt", "bare.txt"}
    assert [r.source_file for r in ingest.headers(raw).collect()] == ["q.txt"]
    part = ingest.section_coverage(ingest.parsed(raw).where("form_type = '10-Q'")).first()
    assert part.form_type == "10-Q" and 0.9 < part.coverage < 1


# ---- sources and history


def test_sources(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.txt").write_text(f"Ticker: {n.upper()}\n{'=' * 20}\nbody")
    assert corpus.read_filings(spark, str(tmp_path)).count() == 2
    assert corpus.read_filings(spark, str(tmp_path), ["a.txt"]).count() == 1
    with pytest.raises(FileNotFoundError):
        corpus.read_filings(spark, str(tmp_path), ["c.txt"])
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "x.txt").write_bytes(b"ab\xff\xfecd")
    assert corpus.read_filings(spark, str(tmp_path / "bytes")).first().raw == "ab\ufffd\ufffdcd"
    (runs := tmp_path / "runs").mkdir()
    for n, t in (("1.json", json.dumps({"config": "a", "generated_at": "2025"})), ("2.json", "{broken"), ("latest.json", "{}"), ("3.json", json.dumps({"config": "b", "generated_at": "2026"}, indent=2))):
        (runs / n).write_text(t)
    assert [r.file for r in corpus.read_runs(spark, str(runs)).collect()] == ["3.json", "1.json"]
    (tmp_path / "g.json").write_text(json.dumps({"note": "", "questions": [{"id": "1", "category": "x", "question": "?"}]}))
    assert corpus.read_golden(spark, str(tmp_path / "g.json")).first().category == "x"


def test_index(spark, tmp_path):
    c = spark.createDataFrame([("1", "A", 2020, "f"), ("2", "B", 2021, "g")], "chunk_id string, ticker string, fiscal_year int, source_file string")
    path = str(tmp_path / "index")
    corpus.write_index(c, path, recreate=True)
    corpus.write_index(c.where("ticker = 'B'").withColumn("fiscal_year", F.lit(2022)), path)
    assert sorted((r.ticker, r.fiscal_year) for r in spark.read.parquet(path).collect()) == [("A", 2020), ("B", 2022)]
    assert corpus.reconciled(c, c.where("ticker = 'A'")).collect()[0].sent == 1
    (tmp_path / "index" / "foreign.txt").write_text("x")
    with pytest.raises(PermissionError):
        corpus.write_index(c, path)


def test_index_rows_and_counts(spark, tmp_path):
    c = spark.createDataFrame([("1", "A", 2020, "f", 0), ("2", "B", 2021, "g", 1)], "chunk_id string, ticker string, fiscal_year int, source_file string, chunk_index int")
    path = str(tmp_path / "index")
    assert corpus.index_count(spark, path) == 0 and corpus.bootstrapped(spark, path, c) and not corpus.bootstrapped(spark, path, c)
    assert corpus.index_count(spark, path) == 2 and corpus.index_count(spark, path, ["f", "x"]) == 1
    assert sorted(r.ticker for r in corpus.indexed_tickers(spark, path).collect()) == ["A", "B"]
    points = corpus.index_row(c, F.array(F.lit(1.0)), F.create_map(F.lit("t"), F.lit(1)))
    assert sorted(map(tuple, corpus.passages(points).collect())) == sorted(map(tuple, c.collect())) and points.first().point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "f#0"))


def test_history(spark):
    at = F.lit("2026-02-02 00:00:00")
    conv0 = spark.createDataFrame([("1", "u", "a", "x")], "id string, user_id string, title string, updated_at string")
    msgs = spark.createDataFrame([(1, "1", "user", "q", "x")], "id long, conversation_id string, role string, content string, created_at string")
    new = spark.createDataFrame([(2, "1", "u", "assistant", "r"), (3, "1", "v", "user", "not theirs"), (4, "1", "u", "tool", "x"), (5, "1", "u", "user", "  ")], "id long, conversation_id string, user_id string, role string, content string")
    c2, m2 = history.appended(conv0, msgs, new, at)
    assert [r.id for r in m2.orderBy("id").collect()] == [1, 2] and c2.first().updated_at == "2026-02-02 00:00:00"
    assert history.owned(conv0, "1", "v").count() == 0 and [r.id for r in history.messages_of(m2, conv0, "1", "u").collect()] == [1, 2] and history.messages_of(m2, conv0, "1", "v").count() == 0
    own = spark.createDataFrame([(" A@x.Org ", "n"), ("", "n"), (None, None)], "e string, n string").select(history.owner_key(F.col("e"), F.col("n")).alias("k"))
    assert [r.k for r in own.collect()] == ["a@x.org", "anon:n", "anon:unknown"]
    conv = spark.createDataFrame([("1", "u", "a"), ("2", "u", "b"), ("3", "v", "c")], "id string, user_id string, title string")
    log = spark.createDataFrame([("1", "u", 1, "rename", " x  y "), ("1", "u", 2, "rename", "  "), ("2", "u", 3, "delete", None), ("3", "u", 4, "delete", None)], "id string, user_id string, seq int, op string, title string")
    left = history.replayed(conv, log)
    assert sorted((r.id, r.title) for r in left.collect()) == [("1", "x y"), ("3", "c")]
    m = spark.createDataFrame([(1, "1"), (2, "2")], "m int, conversation_id string")
    assert [r.m for r in history.cascade(m, left).collect()] == [1]


def test_stream(spark, tmp_path):
    from orrery.streaming import ingest as stream

    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.sql("select * from values ('1', timestamp'2026-01-01 00:00:00', 'a'), ('2', timestamp'2026-01-01 00:00:00', 'b') as t(chunk_id, ingested_at, text)")
    df.write.parquet(src)
    stream.upsert_stream(spark, src, df.schema, target, str(tmp_path / "c")).awaitTermination()
    spark.sql("select '1' as chunk_id, timestamp'2026-01-02 00:00:00' as ingested_at, 'new' as text").write.mode("append").parquet(src)
    stream.upsert_stream(spark, src, df.schema, target, str(tmp_path / "c")).awaitTermination()
    want = [("1", "new"), ("2", "b")]
    assert sorted((r.chunk_id, r.text) for r in stream.current(spark, target).collect()) == want
    stream.compact(spark, target)
    assert sorted((r.chunk_id, r.text) for r in stream.current(spark, target).collect()) == want
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) == 1 and stream.current(spark, target).count() == 2


def test_arrivals(spark, tmp_path):
    from orrery.streaming import ingest as stream

    rows = spark.sql("select * from values (timestamp'2026-01-01 03:00:00', '10-K'), (timestamp'2026-01-01 09:00:00', '10-K'), (timestamp'2026-01-02 00:00:00', '10-Q') as t(ingested_at, form_type)")
    rows.write.parquet(str(tmp_path / "in"))
    s = stream.arrivals(spark, str(tmp_path / "in"), rows.schema)
    s.writeStream.format("memory").queryName("arrivals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r.day.start)[:10], r.form_type, r.n) for r in spark.table("arrivals").collect()) == [("2026-01-01", "10-K", 2), ("2026-01-02", "10-Q", 1)]


def test_the_last_of_repeated_rows(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 5, "p"), ("c", None, "q"), ("c", 1, "r"), ("d", 3, "s"), ("d", 3, "s"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    got = sorted((r.k, r.t, r.v) for r in history.once(df, "k", "t").where("k is not null").collect())
    assert got == sorted((r.k, r.t, r.v) for r in history.latest(df, "k", "t").where("k is not null").collect()) == [("a", 2, "y"), ("b", 5, "p"), ("c", 1, "r"), ("d", 3, "s")]
    plain = history.once(df.where("k in ('a', 'b') and v <> 'z'"), "k", "t")
    assert "v" not in "".join(x for x in plain._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x)


# ---- answers, evaluation runs, summaries


def passage_rows(spark):
    rows = [(1, 1, "k1", 0.5, "Quill", "QLLM", "10-Q", 2031, "2031-03-31", "Part II Item 1A — Risk Factors", "q.txt", "Wheat is dear."), (1, 2, "k2", 0.9, "Vantor", "V", "10-K", 2030, "", "Item 1 — Business", "v.txt", "We ship.")]
    return spark.createDataFrame(rows, "question int, rank int, key string, score double, company string, ticker string, form_type string, fiscal_year int, period_end string, item_section string, source_file string, text string")


def test_prompts(spark):
    q = spark.createDataFrame([(1, "Why?"), (2, "Who?")], "question int, text string")
    plan = spark.createDataFrame([(1, ["V"], ["Zenith"], 2030, 2030, None), (2, [], ["Zenith", "Spotter"], None, None, "10-K")], "question int, tickers array<string>, unresolved array<string>, lo int, hi int, form_type string")
    cover = spark.createDataFrame([(1, "two filings.")], "question int, sentence string")
    p = {r.question: r for r in answer.prompts(q, passage_rows(spark), plan, cover).collect()}
    assert not p[1].refuses and p[1].prompt.startswith("Passages:\n\n[C1] Quill (QLLM) | 10-Q, period ending 2031-03-31 | Part II Item 1A — Risk Factors\nWheat is dear.\n\n[C2] Vantor (V) | 10-K, FY2030 | Item 1 — Business\nWe ship.")
    assert "Companies in the passages: Quill, Vantor" in p[1].prompt and "held for Zenith;" in p[1].prompt and "C1 are quarterly" in p[1].prompt and "two filings." in p[1].prompt and p[1].prompt.endswith(answer.FORMAT)
    assert p[2].refuses and "Zenith, Spotter" in p[2].prompt and answer.FORMAT not in p[2].prompt
    none = answer.unmatched(plan, passage_rows(spark), spark.createDataFrame([(9, 2020, 2021)], "n int, first_year int, last_year int")).collect()
    assert [(r.question, r.status) for r in none] == [(2, "empty_scope")] and "10-K filings" in none[0].answer and "2020–2021" in none[0].answer
    assert answer.unmatched(plan, passage_rows(spark), spark.createDataFrame([(0, None, None)], "n int, first_year int, last_year int")).first().answer is None
    calls = []
    got = answer.answers(answer.prompts(q, passage_rows(spark), plan), lambda t: calls.append(t) or "See [C2] and [C7], [C2].")
    checked = {r.question: r for r in answer.checked(got, answer.citations(passage_rows(spark))).collect()}
    assert len(calls) == 2 and (checked[1].cited, checked[1].fabricated, checked[1].uncited, checked[1].shown) == (["C2"], ["C7"], ["C1"], ["C2"]) and checked[2].fabricated == ["C2", "C7"]
    with pytest.raises(answer.NotConfigured):
        answer.answers(got.withColumnRenamed("answer", "prompt"), None)
    meta = {r.question: r.meta for r in answer.meta(passage_rows(spark).withColumn("reranked", F.lit(True)), plan).collect()}
    assert (meta[1].top_score, meta[1].max_score, meta[1].passages, meta[1].reranked) == (0.5, 0.9, 2, True) and meta[2].passages == 0 and meta[2].model is None
    assert one(spark, T.linked_handles(F.col("n"), F.array(F.lit("C1")), "p"), n="a [C1] `[C1]` [C2] [x](y) [C1, C2]") == "a [C1](#p-cite-C1) `[C1]` [C2] [x](y) [C1, C2]"
    assert "## A prompt" in answer.template("rules", "sample") and one(spark, T.asked(F.col("n")), n=" \n ") is None


def test_evaluation_run(spark, tmp_path):
    gold = spark.createDataFrame([("g1", "single", ["A"], ["a1", "a2"], [2020, 2021], "x"), ("g2", "cross", ["A", "B"], ["b1"], [], "x"), ("g3", "unanswerable", [], [], [], None)], "id string, category string, tickers array<string>, source_files array<string>, expect_fiscal_years array<int>, probe string")
    got = spark.createDataFrame([("g1", "a1", "A", 1), ("g1", "z", "A", 2), ("g2", "z", "B", 1)], "question string, file string, ticker string, rank int")
    derived = spark.createDataFrame([("g1", 2020, 2022)], "question string, lo int, hi int")
    run = evaluation.run(gold, got, evaluation.config_label("own", True), F.lit("2031-01-01T00:00:00"), derived=derived)
    r = run.first()
    assert (r.config, r.n_scored, r.n_unanswerable, r.unanswerable_ids) == ("own+rerank", 2, 1, ["g3"])
    assert r.overall.recall_10 == 0.25 and r.by_category["single"].recall_10 == 0.5 and r.overall.entity_coverage_10 == 0.75
    per = {x.question: x for x in r.per_question}
    assert per["g1"].suspect == "" and per["g1"].parser_window_agrees is False and per["g2"].parser_window_agrees is None and "no labelled file" in per["g2"].suspect
    name = corpus.write_run(spark, str(tmp_path / "runs"), run)
    assert [x.config for x in corpus.read_runs(spark, str(tmp_path / "runs")).collect()] == ["own+rerank"] and name.endswith("--own-rerank.json")
    with pytest.raises(FileExistsError):
        corpus.write_run(spark, str(tmp_path / "runs"), run)
    files = spark.createDataFrame([("a1", "A", 2020, "A Ferry sank"), ("b1", "B", 2021, "ferry"), ("b2", "B", None, "FERRY")], "source_file string, ticker string, fiscal_year int, text string")
    probes = spark.createDataFrame([("p1", "ferry", None, None, None), ("p2", "ferry", ["B"], 2020, 2021), ("p3", "airship", None, None, None)], "id string, probe string, tickers array<string>, lo int, hi int")
    found = evaluation.labels(files, probes)
    assert sorted(map(tuple, found.collect())) == [("p1", "a1"), ("p1", "b1"), ("p1", "b2"), ("p2", "b1")]
    q = probes.select("id", "probe", F.array().cast("array<string>").alias("source_files"))
    with pytest.raises(ValueError, match="p3"):
        evaluation.labelled(q, found)
    corpus.write_golden(spark, str(tmp_path / "g.json"), evaluation.labelled(q.where("id <> 'p3'"), found).withColumn("category", F.lit("x")).withColumn("question", F.lit("?")))
    assert sorted((x.id, len(x.source_files)) for x in corpus.read_golden(spark, str(tmp_path / "g.json")).collect()) == [("p1", 3), ("p2", 1)]
    assert evaluation.by_category(gold, "cross").count() == 1 and evaluation.answerable(gold).count() == 2


def test_summaries(spark, tmp_path):
    kind = "config string, file string, generated_at string, metrics map<string,double>, by_category map<string,map<string,double>>, n_scored int, n_unanswerable int, per_question array<struct<id:string,suspect:string>>"
    runs = spark.createDataFrame([("a", "1.json", "2031-01", {"mrr": 0.5, "x": -0.25}, {"c": {"mrr": 0.4}}, 9, 1, [("q", "bad"), ("r", "")]), ("b", "2.json", "2031-02", {"mrr": 0.625}, {}, 9, 1, []), ("a", "3.json", "2031-03", {"mrr": 0.75, "x": -0.25}, {"c": {"mrr": 0.4}}, 9, 1, [("q", "bad")])], kind)
    new = {r.config: r for r in summary.newest_per_config(runs).collect()}
    assert (new["a"].file, new["a"].first_seen, new["a"].place, new["b"].place) == ("3.json", "2031-01", 1, 2)
    assert {r.metric: r.delta for r in summary.deltas(summary.newest_per_config(runs)).collect()} == {"mrr": -0.125, "x": None}
    assert tuple(summary.counts(runs).first()) == (3, 2, 1)
    data = summary.payload(runs)
    allowed = summary.figures_of(data)
    assert {"0.75", "75%", "75.0", "0.125", "-0.125", "0.25", "25%", "2031", "9", "3"} <= allowed and "0.74" not in allowed
    reply = {"headline": "b trails a by 0.125", "findings": [{"point": "a has 75% and 0.74", "metrics": ["mrr", "speed"]}, "b is 3 strong"], "caveat": "9 questions"}
    doc = summary.document(reply, data, "v1", "m", ["1.json", "2.json"], "2031-04")
    assert doc["verification"] == {"verified": False, "n_figures": 5, "figures": ["0.125", "75%", "0.74", "3", "9"], "unverified_figures": ["0.74"], "untraced_findings": ["b is 3 strong"], "unknown_metrics": ["speed"]}
    texts = spark.createDataFrame([("a has 75% and 0.74", [("75% of it", None), ("calm", [])]), (None, None)], "t string, f array<struct<point:string,metrics:array<string>>>")
    v = summary.verified(texts, "t", F.array(*map(F.lit, sorted(allowed))), F.col("f"), F.array(F.lit("mrr"))).collect()
    assert v[0].unverified == ["0.74"] and v[0].untraced == ["75% of it"] and v[1].figures == []
    corpus.write_summary(spark, str(tmp_path / "summary.json"), doc)
    r = corpus.read_summary(spark, str(tmp_path / "summary.json"), ["2.json", "1.json"]).first()
    assert (r.verified, r.stale) == (False, False) and corpus.read_summary(spark, str(tmp_path / "summary.json"), ["4.json"]).first().stale
    assert corpus.read_summary(spark, str(tmp_path / "none.json"), []).count() == 0
    corpus.write_summary(spark, str(tmp_path / "bad.json"), {"summary": {"headline": "", "findings": []}})
    assert corpus.read_summary(spark, str(tmp_path / "bad.json"), []).count() == 0
    fence = "`" * 3
    raw = [fence + 'json\n{"headline": "h", "findings": ["p", {"point": "q", "metrics": ["m"]}]}\n' + fence, '{"headline": "", "findings": ["p"]}', "no json", '{"headline": "h", "findings": []}', None]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, s string").orderBy("i").select(summary.parsed(F.col("s")).alias("s")).collect()]
    assert got[0].headline == "h" and [(f.point, f.metrics) for f in got[0].findings] == [("p", []), ("q", ["m"])] and got[1:] == [None] * 4
    files = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    cur = spark.range(1).select(summary.is_current(F.lit("v1"), F.lit("m"), files("a", "b"), "v1", "m", files("b", "a")).alias("x"), summary.is_current(F.lit("v1"), F.lit("m"), files("a"), "v1", "m", files("b", "a")).alias("y")).first()
    assert cur.x and not cur.y and summary.numeral_forms(7.0) >= {"7", "7.0", "7.00"} and summary.flagged(spark.createDataFrame([("x",), ("",), (None,)], "suspect string")).count() == 1


def test_settings(tmp_path):
    from orrery.settings import settings

    (tmp_path / "env").write_text("# c\nORRERY_MODEL = small\nORRERY_BASE_URL=\nORRERY_RERANK='no'\n")
    s = settings({"ORRERY_MODEL": "large", "ORRERY_API_KEY": "  "}, str(tmp_path / "env"))
    assert (s.model, s.rerank, s.fusion_constant, s.model_configured) == ("large", False, 60, False) and settings({"ORRERY_BASE_URL": "http://x"}).model_configured


