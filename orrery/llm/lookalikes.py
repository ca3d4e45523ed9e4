"""Problem 1: text that reads alike is brought to one consistent form.

Look-alike classes are built by union-find over strings (a ligature and its letters, a letter with a loose accent and the
composed one) and code points (wide, mathematical, presentation and canonical variants; spaces; signs; and, across scripts,
letters that look like Latin ones: those that are drawn alike, and those that the public table of confusable characters of the
Unicode consortium names, which the session's own ICU library holds). Each class within a script is represented by the member
met most often in the corpus, among those that may represent it; texts are rewritten greedily, longest match first, by an
Aho-Corasick automaton over all other members. A class across scripts is resolved after that, word by word: a word belongs to
the script of its letters that look like no other's; where all of its letters are look-alikes, to the script of its neighbours;
where these don't tell, to the script whose letters the corpus has more of. So words spelled as their script requires
stay as they are; letters among digits are digits. Characters that cannot be seen are removed unless the script needs them
(joiners after a virama or between Arabic letters).

Defined results: null stays null, "" stays "", text of any length is taken whole, and the form is idempotent.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts, each after the Latin letter that looks the same in common typefaces.
CROSS_SCRIPT = (
    "AАΑ BВΒ CС EЕΕ HНΗ IІΙ JЈ KКΚ MМΜ NΝ OОΟՕ PРΡ SЅՏ TТΤ XХΧ YҮΥ ZΖ UՍ QԚ WԜ "
    "aаα cсϲ eе gց hһհ iіι jјϳ nո oоοօ pрρ qԛզ sѕ uսυ vνѵ wԝ xх yуү dԁ lӏ kκ"
).split()
# Signs, each after the ordinary one that looks the same, and Latin letters after theirs.
SIGNS = ":∶ :˸ :꞉ :⁚ -˗ *⁎".split()
LATIN_FORMS = "aɑ gɡ".split()
#: Scripts whose letters can stand in for Latin ones.
SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
#: Cf characters with a visible shape of their own.
_VISIBLE_CF = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Blank characters that are not in category Cf.
_BLANK = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_ZWNJ, _ZWJ = "‌", "‍"


@functools.cache
def unseen() -> frozenset[str]:
    """The characters that cannot be seen, except line breaks and tabs."""
    out = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"} - {chr(c) for c in _VISIBLE_CF}
    out |= {chr(c) for c in _BLANK} | {chr(c) for c in (*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA0)) if c != 0x85}
    return frozenset(out)


_SIGNS = {x[1]: x[0] for x in SIGNS}


def _variant_of(ch: str) -> str | None:
    """The ordinary string of which ``ch`` is another form, by the Unicode character data; None if there is none."""
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return None if ch in "  " else " "
    if ch in "‐‑":
        return "-"
    if ch == "․":
        return "."
    if ch in _SIGNS:
        return _SIGNS[ch]
    parts = unicodedata.decomposition(ch)
    if not parts:
        return None
    composed = unicodedata.normalize("NFC", ch)
    if not parts.startswith("<"):
        return composed if composed != ch and len(composed) == 1 else None
    tag = parts[1 : parts.index(">")]
    plain = unicodedata.normalize("NFKC", ch)
    if tag in ("wide", "narrow", "font", "small", "initial", "medial", "final", "isolated"):
        return plain if " " not in plain else None
    if tag == "compat" and (cat[0] == "L" or cat == "Nl") and not (0x0590 <= ord(ch) < 0x2000 or 0x3000 <= ord(ch) < 0xF900):
        return plain if " " not in plain else None
    return None


class _Union:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)


@functools.cache
def classes() -> tuple[tuple[str, ...], ...]:
    """The transitive look-alike classes within one script: tuples of strings, sorted."""
    sets = _Union()
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        if 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000:  # Hangul syllables are composed by rule; surrogates are no text
            continue
        if (plain := _variant_of(ch)) is not None and plain != ch:
            sets.join(ch, plain)
        elif (pair := unicodedata.decomposition(ch)) and pair[0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            sets.join(ch, "".join(chr(int(x, 16)) for x in pair.split()))
            sets.join(ch, unicodedata.normalize("NFD", ch))
    found: dict[str, list[str]] = {}
    for x in list(sets.parent):
        found.setdefault(sets.find(x), []).append(x)
    return tuple(tuple(sorted(v)) for v in found.values() if len(v) > 1)


@functools.cache
def _confusable_pairs(skeletons: tuple[str, str]) -> dict[str, str]:
    letters, plain = (x.split("\n") for x in skeletons)
    out = {}
    for c, k in zip(letters, plain):
        k = "I" if k == "l" and not c.islower() else k
        if len(k) == 1 and k.isascii() and k.isalpha() and (k.isupper() == c.isupper() or unicodedata.category(c) == "Lo"):
            out[c] = k
    return out


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of SCRIPTS and the ASCII letters of their case that they can be confused with, by the Unicode table in the ICU
    library of the session: one call for the letters of all scripts."""
    letters = [chr(c) for c in range(0x80, 0x1_2000) if chr(c).isalpha() and _script(chr(c)) in SCRIPTS]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return _confusable_pairs(("\n".join(letters), checker.getSkeleton("\n".join(letters))))


def across_scripts(more: dict[str, str] | None = None) -> dict[str, tuple[str, ...]]:
    """The look-alike classes across scripts, by the ASCII letter in them: the closure of what is drawn alike and of ``more``."""
    sets = _Union()
    for group in CROSS_SCRIPT:
        for x in group[1:]:
            sets.join(x, group[0])
    for x, y in (more or {}).items():
        if x not in sets.parent:  # what is drawn alike goes first, and no two ASCII letters meet
            sets.join(x, y)
    found: dict[str, list[str]] = {}
    for x in list(sets.parent):
        found.setdefault(sets.find(x), []).append(x)
    return {min(v): tuple(sorted(v)) for v in found.values()}


def representatives(counts: dict[str, int] | None = None) -> dict[str, str]:
    """Each other member of a class to the class's representative: of the members in composed form that are no variant of
    another string, the one met most often (a string counts as its rarest character), then the first by code points."""
    counts, out = counts or {}, {}
    for members in classes():
        fit = [m for m in members if unicodedata.normalize("NFC", m) == m and not any(unicodedata.combining(c) for c in m[1:])]
        fit = [m for m in fit if all(_variant_of(c) in (None, c) for c in m)] or fit or list(members)
        best = min(fit, key=lambda m: (-min(counts.get(c, 0) for c in m), len(m), m))
        out |= {m: best for m in members if m != best}
    return out


@functools.lru_cache(4096)
def _script(ch: str) -> str:
    """The script of a letter as the first word of its Unicode name."""
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0] if name else ""


_OUTSIDE_ASCII = re.compile("[^\x00-\x7f]")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
#: A stretch that can hold a member of a class: every member has a character outside ASCII, after one base letter at most.
_STRETCH = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")


class Normaliser:
    """Rewrites text to the consistent form; cheap where a text holds nothing to rewrite."""

    def __init__(self, counts: dict[str, int] | None = None, built: tuple | None = None, more: dict[str, str] | None = None) -> None:
        """``counts`` of code points choose representatives; ``more`` are letters that can be confused with ASCII ones beside
        those that are drawn alike; they are rewritten in words that hold ASCII letters only."""
        if built is None:
            cross = across_scripts(more)
            often: dict[str, int] = {}
            for plain, group in cross.items():
                for c in group:
                    often[_script(c)] = often.get(_script(c), 0) + (counts or {}).get(c, 0)
            drawn = {x for group in CROSS_SCRIPT for x in group[1:]}
            also = {c: plain for plain, group in cross.items() for c in group if c != plain and c not in drawn}
            built = representatives(counts), unseen(), also, frozenset(k for k, n in often.items() if n > often.get("LATIN", 0))
        self.built = rep, hidden, self.also, self.usual = built
        self.automaton = ahocorasick.Automaton()
        for member, best in rep.items():
            self.automaton.add_word(member, (len(member), best))
        self.automaton.make_automaton()
        self.unseen = hidden
        self.latin = {x: group[0] for group in CROSS_SCRIPT for x in group[1:]}
        self.native = {(_script(x), group[0]): x for group in CROSS_SCRIPT for x in group[:0:-1]}
        self.risky = {c for m in rep for c in m if c > "\x7f"} | self.unseen | {*self.latin, *self.also, *"".join(LATIN_FORMS), *map(chr, range(0x1100, 0x1200))} - {x[0] for x in LATIN_FORMS}
        self.risky -= {c for m in rep if len(m) > 1 for c in m[:1]} - {m for m in rep if len(m) == 1} - {*self.latin, *self.also}
        self.joiner = regex.compile(r"(?<!\p{ccc=9})\u200d|(?<!\p{Arabic}|\p{ccc=9})\u200c|(?<=\p{Arabic})\u200c(?!\p{Arabic})")

    def __reduce__(self):
        return Normaliser, (None, self.built)  # workers get the classes, and need not build them

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        if text.isascii():
            return _CONTROL.sub("", text) if _CONTROL.search(text) else text
        present = set(_OUTSIDE_ASCII.findall(text))
        if self.risky.isdisjoint(present) and not _CONTROL.search(text):
            return text
        out = _CONTROL.sub("", text)
        for c in present & self.unseen:
            out = self.joiner.sub("", out) if c in (_ZWJ, _ZWNJ) else out.replace(c, "")
        for _ in range(4):  # a rewritten base letter can meet its accent in the next round
            if out.isascii():
                return out
            new = unicodedata.normalize("NFC", _STRETCH.sub(self._rewrite, out))
            if new == out:
                break
            out = new
        if any(c in self.latin or c in self.also for c in present):
            out = self._across(out)
        return _FORMS.sub(lambda m: m[0].translate(_TO_LATIN), out) if not present.isdisjoint(_FORM_LETTERS) else out

    def _rewrite(self, m: re.Match) -> str:
        text, parts, at = m[0], [], 0
        for end, (n, best) in self.automaton.iter_long(text):
            parts += text[at : end - n + 1], best
            at = end + 1
        return "".join(parts) + text[at:] if parts else text

    def _across(self, text: str) -> str:
        """Letters of another script are rewritten in words that mix scripts, and in words made of look-alikes only that
        stand beside words of the script they stand in for."""
        parts, at = [], 0
        for m in _OUTSIDE_ASCII.finditer(text):
            if m.start() < at or m[0] not in self.latin and m[0] not in self.also:
                continue
            lo, hi = m.start(), m.end()
            while lo > at and _in_word(text[lo - 1]):
                lo -= 1
            while hi < len(text) and _in_word(text[hi]):
                hi += 1
            parts += text[at:lo], self._word(text[lo:hi], text, lo, hi)
            at = hi
        return "".join(parts) + text[at:] if parts else text

    def _word(self, s: str, text: str, lo: int, hi: int) -> str:
        strict = {_script(c) for c in s if c not in self.latin and c.isalpha()} - {"LATIN"}
        latin = [c for c in s if c.isalpha() and _script(c) == "LATIN"]
        weak = {_script(c) for c in s if c in self.latin}
        if not strict:
            plain = {self.latin.get(c, c) for c in s}
            if not latin and lo and text[lo - 1].isdigit() and (hi == len(text) or not text[hi].isalpha()) and (plain <= {"O", "o"} or plain <= {"I", "l"}):
                return ("0" if plain <= {"O", "o"} else "1") * len(s)
            near = {self._side(text, lo, -1), self._side(text, hi, 1)}
            if not (latin or len(weak) > 1 or "LATIN" in near and not weak & near):
                return s
            if latin and len(weak) == 1 and weak <= self.usual and "LATIN" not in near and all((*weak, c) in self.native for c in latin):
                return "".join(self.native.get((*weak, c), c) for c in s)
        elif not latin:
            return s
        elif len(strict) == 1 and all((*strict, c) in self.native for c in latin):
            return "".join(self.native.get((*strict, c), c) for c in s)
        elif all(c in self.also for c in s if c not in self.latin and c.isalpha() and _script(c) != "LATIN"):
            return "".join(self.latin.get(c) or self.also.get(c, c) for c in s)
        return "".join(self.latin.get(c, c) for c in s)

    def _side(self, text: str, at: int, step: int) -> str:
        """The script of the next word to one side, as far as its letters tell: look-alikes of Latin letters tell nothing."""
        at -= step < 0
        while 0 <= at < len(text) and not text[at].isalpha():
            at += step
        while 0 <= at < len(text) and _in_word(text[at]):
            if text[at] not in self.latin and text[at].isalpha():
                return _script(text[at])
            at += step
        return ""


_FORM_LETTERS = frozenset(x[1] for x in LATIN_FORMS)
_TO_LATIN = {ord(x[1]): x[0] for x in LATIN_FORMS}
#: A word of ASCII letters, two at least, and of Latin letters in other forms.
_FORMS = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?=[^\p{{L}}]*(?:[{''.join(_FORM_LETTERS)}]*[A-Za-z]){{2}})[A-Za-z{''.join(_FORM_LETTERS)}]+(?![\p{{L}}\p{{M}}])")


def _in_word(c: str) -> bool:
    return c.isalpha() or c > "\x7f" and unicodedata.category(c)[0] == "M"


def code_point_counts(df: DataFrame, columns: list[str], more: dict[str, str] | None = None) -> dict[str, int]:
    """How often each member character of a class, within or across scripts, stands in ``columns``, over all rows. What comes to the driver is at
    most one row for each code point of the classes, whatever the size of the table."""
    wanted = np.zeros(sys.maxunicode + 1, bool)
    wanted[[ord(c) for group in classes() for m in group for c in m] + [ord(c) for group in across_scripts(more).values() for c in group]] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for b in batches:
            for column in b.columns:
                for v in column.drop_null().to_pandas():
                    if not v.isascii():
                        points, n = np.unique(np.frombuffer("".join(c for c in v if c > "\x7f").encode("utf-32-le", "replace"), np.uint32), return_counts=True)
                        total[points] += n
                raw = column.buffers()[2]
                if raw is not None and len(column):
                    lo, hi = (np.frombuffer(column.buffers()[1], np.int32)[i + column.offset] for i in (0, len(column)))
                    total[:128] += np.bincount(np.frombuffer(raw, np.uint8)[lo:hi], minlength=256)[:128]
        at = np.flatnonzero(total * wanted)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["code_point", "n"])

    rows = df.select(*columns).mapInArrow(count, "code_point int, n long").groupBy("code_point").agg(F.sum("n").alias("n")).collect()
    return {chr(r.code_point): r.n for r in rows}


def normaliser_for(df: DataFrame, columns: list[str]) -> Normaliser:
    """The normaliser whose representatives follow the frequencies in ``columns`` of ``df``."""
    more = confusables(df.sparkSession)
    return Normaliser(code_point_counts(df, columns, more), more=more)


def normalise_columns(df: DataFrame, columns: list[str], normaliser: Normaliser | None = None, suffix: str = "") -> DataFrame:
    """``df`` with each of ``columns`` in its consistent form, in place or, with a ``suffix``, beside it (an existing
    column of that name is refused). All other columns pass through unread by Python."""
    if taken := [c + suffix for c in columns if suffix and c + suffix in df.columns]:
        raise ValueError(f"columns exist already: {taken}")
    norm = normaliser or normaliser_for(df, columns)
    form = _form_udf(norm)
    return df.withColumns({c + suffix: form(F.col(f"`{c}`")) for c in columns})


def _form_udf(norm: Normaliser):
    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(norm, na_action="ignore")

    return form


def dirty_fields(df: DataFrame, key: str, columns: list[str], normaliser: Normaliser | None = None) -> DataFrame:
    """(key, field): the fields that differ from their consistent form, once for each key. Copies of a row count once."""
    norm = normaliser or normaliser_for(df, columns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fields = [], []
            for field in columns:
                known: dict[str, bool] = {}
                values = b.column(field).to_pylist()
                for i, v in enumerate(values):
                    if v is None:
                        continue
                    hit = known.get(v)
                    if hit is None:
                        hit = norm(v) != v
                        if len(v) < 200:
                            known[v] = hit
                    if hit:
                        keys.append(i)
                        fields.append(field)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keys, pa.int64())), pa.array(fields, pa.string())], names=[key, "field"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field string"
    return df.select(key, *columns).mapInArrow(find, schema).distinct()
