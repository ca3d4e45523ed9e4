"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for a search.
STOP_WORDS = (
    "a about after also an and are as at be because been but by can could did do does for from give gives had has have how "
    "if in into is it its me more not of on or our please say since so some than that the their then there they this to "
    "was we were what when which who why will with would you your"
).split()


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, without stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def shingles(text: Column, k: int = 5) -> Column:
    """The distinct runs of ``k`` words, as strings; fewer than ``k`` words are one run."""
    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(each))

    # bound as the element of an array, or the words would be found again for every run
    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), runs)[0]


# What is no part of a name.
NAME_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "company", "co", "plc", "llc", "lp", "ltd", "limited", "holdings", "group", "the", "and", "&")


def normalised_name(name: Column) -> Column:
    """A company's name without its legal form and without articles, in lower case, punctuation as spaces; inner runs of
    spaces stay."""
    forms = rf"[\s,]*\b(?:{'|'.join(NAME_SUFFIXES)})\b\.?"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), forms, " "), "[^a-z0-9 ]+", " "))


def title(text: Column, limit: int = 60) -> Column:
    """One line of at most ``limit`` characters and an ellipsis, cut at the last space beyond 60 % of the limit; blank text
    is a new chat."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " "))
    head = F.substring(one, 1, limit)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > limit * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(one == "", "New chat").when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def citation_handles(text: Column) -> Column:
    """The distinct handles such as [C1], without brackets, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(C\d+)\]"), F.lit(1)))


def figures(text: Column) -> Column:
    """The distinct numbers, with a per cent sign where one follows, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0)))


# Runs of capitalised words and possessive endings.
_CAPITALISED = r"[A-Z][a-zA-Z0-9&.\-]*"
RUN = rf"\b({_CAPITALISED}(?:\s+(?:of|and|the|de|&)\s+{_CAPITALISED}|\s+{_CAPITALISED})*)\b"
POSSESSIVE = r"['’]s\b"


def capitalised_runs(text: Column) -> Column:
    """Runs of capitalised words, which may cross one of, and, the, de or & at a time, without possessive endings."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(1)), lambda r: F.regexp_replace(r, POSSESSIVE, ""))


# Words that ask for quarterly or for annual filings, and numbers of years in words.
QUARTERLY_WORDS = r"\b(10-?q|quarter|quarterly|q[1-4])\b"
ANNUAL_WORDS = r"\b(10-?k|annual|full[- ]year|fiscal\s+year\s+end)\b"
LAST_YEARS = r"\b(?:last|past|previous|recent)\s+(two|three|four|five|2|3|4|5|few|several|couple(?:\s+of)?)\s+(?:fiscal\s+)?years?\b"
SINCE_YEAR = r"\bsince\s+((?:19|20)\d{2})\b"


def form_hint(question: Column) -> Column:
    """10-Q for quarterly words, 10-K for annual ones, null for neither or both."""
    q, k = F.lower(question).rlike(QUARTERLY_WORDS), F.lower(question).rlike(ANNUAL_WORDS)
    return F.when(q & ~k, "10-Q").when(k & ~q, "10-K")


def year_window(question: Column, latest: Column) -> Column:
    """(lo, hi) of fiscal years: since a year, the last n years up to ``latest``, or from the first to the last year named;
    null if none is."""
    q = F.lower(question)
    since, last = F.regexp_extract(q, SINCE_YEAR, 1), F.regexp_extract(q, LAST_YEARS, 1)
    n = F.when(last.isin("few", "several", "three", "3"), 3).when(last.isin("four", "4"), 4).when(last.isin("five", "5"), 5).otherwise(2)
    years = F.transform(F.regexp_extract_all(q, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return F.when(since != "", pair(since, latest)).when(last != "", pair(latest - n + 1, latest)).when(F.size(years) > 0, pair(F.array_min(years), F.array_max(years)))


def fiscal_period(report_period: Column, url: Column, filing_date: Column, form: Column) -> Column:
    """(period_end, fiscal_year): the period of the header, else of the address, else no period and the year of filing,
    one less for an annual report filed in January to April; a header without any has year 0."""
    stamp = F.regexp_extract(F.coalesce(url, F.lit("")), r"-(\d{8})[^/]*\.html?", 1)
    dated = F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))
    end = F.when(F.coalesce(report_period, F.lit("")) != "", report_period).when(stamp != "", dated).otherwise("")
    filed = F.substring(filing_date, 1, 4).try_cast("int")
    early = F.upper(form).startswith("10-K") & F.substring(filing_date, 6, 2).isin("01", "02", "03", "04")
    year = F.when(end != "", F.substring(end, 1, 4).try_cast("int")).otherwise(F.coalesce(filed - early.cast("int"), F.lit(0)))
    return F.struct(end.alias("period_end"), year.alias("fiscal_year"))


def contextual_prefix(company: Column, ticker: Column, form: Column, year: Column, period_end: Column, section: Column) -> Column:
    period = F.when(F.coalesce(period_end, F.lit("")) != "", F.concat(F.lit(" (period ending "), period_end, F.lit(")"))).otherwise("")
    return F.concat(F.coalesce(company, F.lit("")), F.lit(" ("), ticker, F.lit(") — "), form, F.lit(", FY"), F.coalesce(year.cast("string"), F.lit("")), period, F.lit(" — "), section, F.lit(":"))


def embedding_text(prefix: Column, text: Column) -> Column:
    """What is encoded of a passage: its prefix, a line break, its text."""
    return F.concat(prefix, F.lit("\n"), text)


def passage_label(company: Column, ticker: Column, form: Column, year: Column, period_end: Column, section: Column) -> Column:
    """How a passage is introduced: company, form, the end of its period (the fiscal year where none is known), section."""
    when = F.when(F.coalesce(period_end, F.lit("")) != "", F.concat(F.lit("period ending "), period_end)).otherwise(F.concat(F.lit("FY"), F.coalesce(year.cast("string"), F.lit(""))))
    return F.concat(F.coalesce(company, F.lit("")), F.lit(" ("), ticker, F.lit(") | "), form, F.lit(", "), when, F.lit(" | "), section)


def incremental_risk(form: Column, section: Column) -> Column:
    """Whether a passage is a quarterly report's risk section, which states changes only."""
    return F.coalesce((form == "10-Q") & F.contains(F.lower(section), F.lit("risk factors")), F.lit(False))


def asked(question: Column) -> Column:
    """The question without surrounding white space; null if nothing is left."""
    q = F.regexp_replace(question, r"^\s+|\s+$", "")
    return F.when(q != "", q)


def linked_handles(text: Column, handles: Column, prefix: str) -> Column:
    """Text with each handle of ``handles`` as a link to the anchor ``prefix``-cite-handle; other handles stay as they are,
    and so does what stands in code spans and in links."""
    parts = F.regexp_extract_all(text, F.lit(r"(`[^`]*`|\[[^\]]*\]\([^)]*\)|\[C\d+\]|[^\[`]+|.)"), F.lit(1))
    own = lambda p: F.regexp_extract(p, r"^\[(C\d+)\]$", 1)
    link = lambda p: F.when((own(p) != "") & F.array_contains(handles, own(p)), F.concat(p, F.lit(f"(#{prefix}-cite-"), own(p), F.lit(")"))).otherwise(p)
    return F.array_join(F.transform(parts, link), "")
