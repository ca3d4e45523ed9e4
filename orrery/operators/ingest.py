"""Filings from raw text: header, sections, lost block boundaries, passages.

The header is parsed by column expressions. Segmenting and cutting are stateful within one filing and run in Arrow batches,
one filing at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import fiscal_period

TARGET, OVERLAP, LEAST = 800, 0.15, 20
LATE, MAX_PROSE = 0.9, 2
#: Characters of a file in which its header stands.
HEADER = 4000
# The headings of the items, in order: number, pattern of the title's beginning, label that passages carry.
ANNUAL = (
    ("1", r"Business", "Item 1 — Business"),
    ("1A", r"Risk\s+Factors", "Item 1A — Risk Factors"),
    ("3", r"Legal\s+Proceedings", "Item 3 — Legal Proceedings"),
    ("7", r"Management.s\s+Discussion", "Item 7 — Management's Discussion and Analysis"),
    ("7A", r"Quantitative", "Item 7A — Quantitative and Qualitative Disclosures About Market Risk"),
    ("8", r"Financial\s+Statements", "Item 8 — Financial Statements"),
)
QUARTERLY = (
    ("1", r"Financial\s+Statements", "Item 1 — Financial Statements"),
    ("2", r"Management.s\s+Discussion", "Item 2 — Management's Discussion and Analysis"),
    ("3", r"Quantitative", "Item 3 — Quantitative and Qualitative Disclosures About Market Risk"),
    ("4", r"Controls\s+and\s+Procedures", "Item 4 — Controls and Procedures"),
    ("1", r"Legal\s+Proceedings", "Part II Item 1 — Legal Proceedings"),
    ("1A", r"Risk\s+Factors", "Part II Item 1A — Risk Factors"),
)
# What stands between an item's number and its title, and a row of a table of contents.
BETWEEN = r"[.:\-–—]?[\s\xa0|]*"
CONTENTS_ROW = re.compile(r"[^\n]*\|[\s\xa0]*\d+[\s\xa0]*")
# Words that end with a full stop within a sentence.
ABBREVIATIONS = frozenset("inc corp ltd co no nos mr mrs ms dr jr sr st vs etc al ph fig e.g i.e approx dept div univ sec art".split())
# Captions of scale, figures whose scale matters, labels of periods, residue of tags, joins of sentences and of
# headings to what follows them.
SCALE_CAPTION = r"(?:\(|\b)(?:\$\s*)?(?:in|dollars\s+in|amounts\s+in)\s+(?:millions|thousands|billions)\b"
SCALED_FIGURE = r"\|\s*\$?\s*\(?(?:\d{1,3}(?:,\d{3})+|\$\s*[\d.]+|\d+\.\d\d)\b"
PERIOD_LABEL = r"\b(?:19|20)\d\d\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\b|\b(?:Three|Six|Nine|Twelve)\s+Months\b|\bQ[1-4]\b|\bYears?\s+Ended\b"
TAG = r"(us-gaap:|http://fasb\.org|http://xbrl\.|iso4217:|srt:)\S*"
TAG_LINE = r"(?m)^[a-z0-9\-]{4,}(false|true)?\d{4}(FY|Q\d)?\d{6,}.*$"
SENTENCE_JOIN = r"(?<=[.!?\"])(?=[A-Z\"])"
HEADING_JOIN = r"[a-z]{3}(?=[A-Z][a-z]+\s)"

_TOKEN = re.compile(r"\w+|[^\w\s]")
_BREAK, _HEADING = re.compile(SENTENCE_JOIN), re.compile(HEADING_JOIN)
_SCALE, _FIGURE, _PERIOD = (re.compile(p, re.I) for p in (SCALE_CAPTION, SCALED_FIGURE, PERIOD_LABEL))


def header(raw: Column) -> Column:
    """The map of lower-case keys to values before the first line of twenty equals signs; without one, an empty map."""
    has = F.regexp_count(raw, F.lit("={20,}")) > 0
    head = F.element_at(F.split(raw, "={20,}", 2), 1)
    lines = F.filter(F.split(head, "\r?\n"), lambda x: (F.instr(x, ":") > 1) & (F.trim(F.substring_index(x, ":", -1)) != ""))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    entries = F.filter(entries, lambda e: e["v"] != "")
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    pairs = F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))  # the last wins
    return F.when(has, F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>"))


def body(raw: Column) -> Column:
    return F.when(F.regexp_count(raw, F.lit("={20,}")) > 0, F.element_at(F.split(raw, "={20,}", 2), 2)).otherwise(raw)


def without_residue(text: Column) -> Column:
    """Text without tag residue: single tags become a space, lines of joined contexts go."""
    return F.regexp_replace(F.regexp_replace(text, TAG, " "), TAG_LINE, "")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def token_spans(text: str) -> list[tuple[int, int]]:
    """Where the tokens of a text stand."""
    return [m.span() for m in _TOKEN.finditer(text)]


def _headings(form: str | None) -> list[tuple[str, re.Pattern]]:
    return [(label, re.compile(rf"Item\s+{n}{BETWEEN}{title}", re.I)) for n, title, label in (QUARTERLY if "10-Q" in (form or "").upper() else ANNUAL)]


def _quoted(text: str, at: int) -> bool:
    if text[at - 1 : at] in ("\"", "“", "'", "‘"):
        return True
    before = text[max(0, at - 48) : at].rsplit("\n", 1)[-1]
    return before.rfind("“") > before.rfind("”")


def sections(text: str, form: str) -> list[tuple[str, int, int]]:
    """(label, start, end) that tile the text: each heading of the form is sought after the one before; headings in
    quotations or tables of contents don't count; if the first lies in the last tenth, none does."""
    found, cursor = [], 0
    for label, pattern in _headings(form):
        for m in pattern.finditer(text, cursor):
            end = text.find("\n", m.start())
            if not _quoted(text, m.start()) and not CONTENTS_ROW.fullmatch(text, m.start(), end if end >= 0 else len(text)):
                found.append((label, m.start()))
                cursor = m.start() + 1
                break
    if not found or found[0][1] > LATE * len(text):
        return [("Unlabelled section", 0, len(text))] if text else []
    starts = ([("Unlabelled section", 0)] if found[0][1] else []) + found
    return [(label, at, starts[i + 1][1] if i + 1 < len(starts) else len(text)) for i, (label, at) in enumerate(starts)]


def _abbreviated(before: str) -> bool:
    """Whether a text ends with an abbreviation's full stop or with an initial's."""
    if not before.endswith("."):
        return False
    word = re.search(r"[\w.]*$", before[:-1])[0]
    ends = {word.lower(), word.lower().rsplit(".", 1)[-1]}
    return bool(ends & ABBREVIATIONS) or bool(re.search(r"(?:^|[\s(.])[A-Z]$", before[:-1]))


def boundaries(text: str) -> list[int]:
    """Where blocks were joined without a space: at a sentence's end that meets a capital, but for abbreviations; and where a
    heading runs into its text: a capitalised word begins within one, in the last 70 characters there is no table and no new
    line in the last 25, and three of the last four words are capitalised."""
    found = {m.start() for m in _BREAK.finditer(text) if not _abbreviated(text[max(0, m.start() - 12) : m.start()])}
    for m in _HEADING.finditer(text):
        before = text[max(0, m.end() - 70) : m.end()]
        last = before.split()[-4:]
        if "|" not in before and "\n" not in before[-25:] and sum(w[0].isupper() for w in last) >= 3:
            found.add(m.end())
    return sorted(found)


def reflowed(text: str) -> str:
    """Text with a blank line at each lost boundary of blocks; nothing else changes."""
    cuts = [0, *boundaries(text), len(text)]
    return "\n\n".join(text[a:b] for a, b in zip(cuts, cuts[1:])) if len(cuts) > 2 else text


def pieces(text: str) -> list[str]:
    """Paragraphs; where there is only one, its sentences."""
    parts = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    return parts if len(parts) > 1 else [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z\"“])", text) if p.strip()]


def hard_windows(text: str, spans: Callable[[str], list[tuple[int, int]]] = token_spans, size: int = TARGET, overlap: float = OVERLAP) -> list[str]:
    """Slices of the text of ``size`` tokens each, the overlap shared with the one before; no character changes."""
    at, step = spans(text), size - int(size * overlap)
    return [text[at[i][0] : at[min(i + size, len(at)) - 1][1]] for i in range(0, len(at), step)]


def is_period_header(line: str) -> bool:
    return line.count("|") >= 2 and not _FIGURE.search(line) and bool(_PERIOD.search(line))


def line_kinds(line: Column) -> dict[str, Column]:
    """What a line is, as columns: a caption of scale, a row with figures whose scale matters, a header of periods, a row of a
    table of contents."""
    figure = line.rlike(SCALED_FIGURE)
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    header_row = (pipes >= 2) & ~figure & line.rlike(f"(?i){PERIOD_LABEL}")
    return {"scale_caption": line.rlike(f"(?i){SCALE_CAPTION}"), "scaled_figure": figure, "period_header": header_row, "contents_row": line.rlike(f"^{CONTENTS_ROW.pattern}$")}


def with_caption(section: str, window: str) -> str:
    """A window with figures but no scale caption gets the nearest caption before it, and the header of periods after that,
    unless more than two lines of prose in a row, without a table's line between, come first. A window that does not stand in
    the section word for word is left."""
    lines = window.split("\n")
    if any(_SCALE.search(x) for x in lines) or not any(_FIGURE.search(x) for x in lines) or (at := section.find(window)) <= 0:
        return window
    prose, head = 0, []
    for line in reversed(section[:at].split("\n")):
        if not head and is_period_header(line):
            head = [line]
        if _SCALE.search(line):
            return "\n".join([line, *head, window])
        if line.strip():
            prose = 0 if "|" in line else prose + 1
        if prose > MAX_PROSE:
            break
    return window


def windows(text: str, count: Callable[[str], int] = lambda s: len(tokens(s)), target: int = TARGET, overlap: float = OVERLAP, least: int = LEAST, spans: Callable[[str], list[tuple[int, int]]] = token_spans) -> list[str]:
    """Passages of whole pieces up to ``target`` tokens, each beginning with the last pieces of the one before that fit into
    the overlap; a piece over the target is cut at tokens; passages under ``least`` tokens are dropped."""
    text = reflowed(text)
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for p in pieces(text):
        n = count(p)
        if n > target:
            out += [" ".join(x for x, _ in held)] if held else []
            out += hard_windows(p, spans, target, overlap)
            held = []
            continue
        if held and sum(m for _, m in held) + n > target:
            out.append(" ".join(x for x, _ in held))
            keep, total = len(held), 0
            while keep and total + held[keep - 1][1] <= int(target * overlap):
                keep -= 1
                total += held[keep][1]
            held = held[keep:]
        held.append((p, n))
    out += [" ".join(x for x, _ in held)] if held else []
    return [with_caption(text, w) for w in (x.strip() for x in out) if w and count(w) >= least]


CHUNK = "chunk_id string, text string, company string, ticker string, cik string, form_type string, fiscal_year int, period_end string, filing_date string, item_section string, chunk_index int, source_file string, token_count int"


def chunk_filings(filings: DataFrame, count: Callable[[str], int] = lambda s: len(tokens(s))) -> DataFrame:
    """Passages of filings (source_file, body, company, ticker, cik, form_type, fiscal_year, period_end, filing_date)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                i = 0
                for label, lo, hi in sections(r.body, r.form_type):
                    slug = re.sub("[^a-z0-9]", "", label.split("—")[0].lower())
                    for w in windows(r.body[lo:hi], count):
                        cid = f"{r.ticker}-{r.form_type.replace('-', '')}-FY{r.fiscal_year}-{r.filing_date}-{slug}-{i:04d}"
                        rows.append((cid, w, r.company, r.ticker, r.cik, r.form_type, r.fiscal_year, r.period_end, r.filing_date, label, i, r.source_file, count(w)))
                        i += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    cols = ["source_file", "body", "company", "ticker", "cik", "form_type", "fiscal_year", "period_end", "filing_date"]
    return filings.select(*cols).where("body is not null").mapInPandas(cut, CHUNK)


def parsed(raw: DataFrame) -> DataFrame:
    """Filings (source_file, raw) with the columns that ``chunk_filings`` reads: header, fiscal period, and the text after the
    header without tag residue. A file without a header is all text and has empty fields."""
    h = raw.where("raw is not null").select("source_file", header(F.col("raw")).alias("h"), without_residue(body(F.col("raw"))).alias("body"))
    get = lambda k: F.coalesce(F.col("h")[k], F.lit(""))
    period = fiscal_period(F.col("h")["report period"], F.col("h")["url"], get("filing date"), get("filing type"))
    return h.select(
        "source_file", "body", get("company").alias("company"), get("ticker").alias("ticker"), get("cik").alias("cik"), get("filing type").alias("form_type"),
        period["fiscal_year"].alias("fiscal_year"), period["period_end"].alias("period_end"), get("filing date").alias("filing_date"),
    )


def headers(raw: DataFrame) -> DataFrame:
    """(source_file, header) from the first HEADER characters of each file; files without a header are left out."""
    h = raw.select("source_file", header(F.substring("raw", 1, HEADER)).alias("header"))
    return h.where(F.size("header") > 0)


def section_coverage(filings: DataFrame) -> DataFrame:
    """(form_type, coverage): of each form the upper median of the share of a filing's text that stands in labelled sections."""

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = [sum(b - a for label, a, b in sections(t, f) if label != "Unlabelled section") / max(len(t), 1) for t, f in zip(pdf.body, pdf.form_type)]
            yield pd.DataFrame({"form_type": pdf.form_type, "share": part})

    each = filings.select("body", "form_type").where("body is not null").mapInPandas(share, "form_type string, share double")
    place = F.row_number().over(Window.partitionBy("form_type").orderBy("share"))
    ranked = each.withColumn("_i", place).withColumn("_n", F.count("*").over(Window.partitionBy("form_type")))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select("form_type", F.round("share", 6).alias("coverage"))


def point_id(source_file: Column, chunk_index: Column) -> Column:
    """The deterministic id of a passage in an index: a version 5 UUID, from the bytes of a SHA-1 digest."""
    name = F.concat(source_file, F.lit("#"), chunk_index.cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
