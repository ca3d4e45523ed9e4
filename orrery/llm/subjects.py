"""Problem 8: the subject areas that a document's sentences deal with.

Each subject has an interpolated bigram model for each language: the probability of a word after the one before it, from the
subject's sentences as far as they hold the word before, interpolated with that of the word alone and with the background's;
the background is the interpolated bigram model of all sentences of the corpus. Where neither the bigram nor the word is
concentrated in a subject's sentences, all models are tied and have the background's probability. A sentence deals with every subject
under whose model its cross-entropy lies below the background's by more than a threshold, in nats a token. Models are
trained on the labelled passages and then again on all sentences of the corpus, each under the subject of the lowest
cross-entropy if the models before are sure of it, so that words the passages lack are learned from their company. The
threshold is calibrated: the valley between the two heaps of the gains of all sentences, but not far below or above what
nearly all labelled sentences reach. A document has each subject that at least a share of its sentences deal with.

Counts are kept in hashed tables of fixed size, over all documents; only these tables and a histogram come to the driver.
Every bigram of the corpus has been counted, so a model is one table of gains by the bigram's place. Defined results: null
and empty texts and texts without words have no sentences and no subjects; copies are scored alike; texts of any length are
read whole; without labelled passages there are no subjects.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import shingles
from orrery.llm.neardup import _rows
from orrery.llm.replies import FUNCTION_WORDS
from orrery.session import written

#: Places of the table of words and of the table of bigrams; the first eight of words count the words of each language.
PLACES = 1 << 20
#: Share of a bigram's own frequency in the background, of the background in a subject's model, the most that a subject's
#: own bigrams weigh against its words, and the count of the word before at which they weigh half of that.
OWN, BACKGROUND, TRUST, ENOUGH = 0.1, 0.3, 0.95, 0.3
#: Share of an n-gram's probability in all models from which on it tells of a subject, the counts added against chance, and
#: the weight of the corpus beside that of a subject.
CONCENTRATED, AGAINST_CHANCE, CORPUS_WEIGHT = 0.5, 0.6, 2.0
SHARE, ROUNDS = 0.25, 3
#: Labelled passages that are read, at most (a table of parameters).
MOST_EXAMPLES = 100_000
#: Quantile of the labelled sentences' gains above which sentences are taken over, by round.
MARGINS = (0.5, 0.1, 0.03)
#: Edges of the histogram of gains, in nats a token.
EDGES = np.linspace(0.0, 2.0, 201)
#: Sentences whose best gain is under this share of the lowest threshold are not kept between scoring and assigning.
LEAST_KEPT = 0.5

_BASE, _INVERSE = shingles._BASE, shingles._INVERSE
_NUMBER, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 13, 32]] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@functools.cache
def _languages() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words of one language each, sorted, and the language's number, from 1."""
    words = [(w, i + 1) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split() if sum(w in x.split() for x in FUNCTION_WORDS.values()) == 1]
    h = _hashed([w.encode() for w, _ in words])
    at = np.argsort(h)
    return h[at], np.array([i for _, i in words])[at]


def _hashed(words: Sequence[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"\x00" + b"\x00".join(words) + b"\x00\x00\x00", np.uint8)
    return _words(buf)[2]


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, context, word, bigram, doc): for each word its sentence, counted through all texts, and the places of the
    word before it in its sentence (or of the sentence's start), of the word, and of both, each told apart by the sentence's
    language (by its frequent words), which stands in the upper bits of the context; and the text of each sentence.
    Sentences end at line breaks, and at a full stop, question or exclamation mark before white space that no small letter
    follows."""
    out, docs, first, base = [], [], 0, 0
    raw = [(t or "").encode("utf-8", "replace").replace(b"\x00", b" ") for t in texts]
    while first < len(raw):
        size, last = 0, first
        while last < len(raw) and (last == first or size + len(raw[last]) < shingles.SLAB):
            size += len(raw[last]) + 1
            last += 1
        s, *places, d = _slab(raw[first:last])
        out.append((s + base, *places))
        docs.append(d + first)
        base += len(d)
        first = last
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    return *(np.concatenate(x) for x in zip(*out)), np.concatenate(docs)


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = shingles._TABLE[buf]
    edge = np.flatnonzero((x[1:] != 0) != (x[:-1] != 0)) + 1
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.cumsum(x * shingles._powers(_BASE, len(x))[: len(x)])
        w = shingles.mix((total[end - 1] - total[start - 1]) * shingles._powers(_INVERSE, len(x))[start] + (end - start).astype(np.uint64))
    w[_DIGIT[buf[start]]] = _NUMBER
    return start, end, w


def _slab(raw: Sequence[bytes]) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"\x00" + b"\x00".join(raw) + b"\x00\x00\x00", np.uint8)
    start, _, w = _words(buf)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    stops = np.flatnonzero(_STOP[buf[:-2]] & _SPACE[buf[1:-1]] & ~_LOWER[buf[2:]])
    ends = np.sort(np.concatenate([stops, np.flatnonzero((buf == 10) | (buf == 0))]))
    piece = np.searchsorted(ends, start)
    fresh = np.concatenate([[True], piece[1:] != piece[:-1]])
    sentence = np.cumsum(fresh) - 1
    begins = np.cumsum([1] + [len(t) + 1 for t in raw[:-1]])
    doc = np.searchsorted(begins, start[fresh], side="right") - 1
    known, which = _languages()
    at = np.minimum(np.searchsorted(known, w), len(known) - 1)
    told = np.flatnonzero(known[at] == w)
    votes = np.bincount(sentence[told] * 8 + which[at[told]], minlength=8 * len(doc)).reshape(-1, 8)
    language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), 0)[sentence].astype(np.uint64)
    before = np.concatenate([[_START], w[:-1]])
    before[fresh] = _START
    with np.errstate(over="ignore"):
        salt = shingles.mix(language + np.uint64(1))
        place = lambda v: (np.uint64(8) + shingles.mix(v + salt) % np.uint64(PLACES - 8)).astype(np.int64)
        both = (shingles.mix(w * np.uint64(3) + before * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(PLACES)).astype(np.int64)
    return sentence, place(before) | language.astype(np.int64) << 32, place(w), both, doc


class Models:
    """For each place of a bigram the subject whose model is not tied there (``owner``, -1 for none), and how far its log
    probability of the word lies over the background's (``value``). ``counts`` has a row for each place of words, then of bigrams, and a column for each subject; ``background``
    has the counts of all sentences of the corpus, ``pairs`` the (bigram, language, context, word) that stand in it."""

    def __init__(self, counts: np.ndarray, background: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.subjects, self.owner, self.value = counts.shape[1], np.full(PLACES, -1, np.int8), np.zeros(PLACES, np.float32)
        bigram, language, context, word = pairs
        b, c = background, counts
        common = OWN * b[PLACES + bigram] / np.maximum(b[context], 1) + (1 - OWN) * b[word] / np.maximum(b[language], 1)
        common = np.clip(common, 1e-9, 1)
        told = self._told(c[PLACES + bigram], b[PLACES + bigram], c[language], b[language])
        told = np.where(told >= 0, told, self._told(c[word], b[word], c[language], b[language]))
        for j in range(c.shape[1]):
            at = np.flatnonzero(told == j)
            h, w, l, g = context[at], word[at], language[at], bigram[at]
            after = np.maximum(c[h, j], c[PLACES + g, j])
            own = c[w, j] / np.maximum(c[l, j], 1)
            own = own + TRUST * after / (after + ENOUGH) * (c[PLACES + g, j] / np.maximum(after, 1) - own)
            self.owner[g], self.value[g] = j, np.log(BACKGROUND + (1 - BACKGROUND) * own / common[at])

    @staticmethod
    def _told(c: np.ndarray, b: np.ndarray, all_c: np.ndarray, all_b: np.ndarray) -> np.ndarray:
        """The subject in whose sentences alone an n-gram is frequent, -1 if there is none: there all models are tied."""
        p = c / np.maximum(all_c, 1)
        best, at = p.argmax(axis=1), np.arange(len(p))
        share = p[at, best] / np.maximum(p.sum(axis=1) + CORPUS_WEIGHT * b / np.maximum(all_b, 1), 1e-30)
        return np.where(share * c[at, best] / (c[at, best] + AGAINST_CHANCE) >= CONCENTRATED, best, -1)

    def gains(self, sentence: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """How far each subject's cross-entropy lies below the background's, in nats a token, by sentence."""
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        own = self.owner[pair]
        at = np.flatnonzero(own >= 0)
        out = np.bincount(sentence[at] * self.subjects + own[at], self.value[pair[at]], minlength=n * self.subjects)
        return out.reshape(n, self.subjects) / np.maximum(np.bincount(sentence, minlength=n), 1)[:, None]


def _by_label(context: np.ndarray, word: np.ndarray, pair: np.ndarray, first: np.ndarray, label: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by place and label, as sorted numbers place * columns + label and how often each occurs: of words (a sentence's
    start is one), of the words of each language, and of bigrams. ``first`` marks the words that begin a sentence."""
    places = np.concatenate([word, context[first] & 0xFFFFFFFF, context >> 32, pair + PLACES])
    return np.unique(places * columns + np.concatenate([label, label[first], label, label]), return_counts=True)


def _table(at: np.ndarray, n: np.ndarray, columns: int) -> np.ndarray:
    out = np.zeros(2 * PLACES * columns, np.float32)
    out[at] = n
    return out.reshape(2 * PLACES, columns)


def _firsts(sentence: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, bool)


def _background(df: DataFrame, text: str) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The counts of all rows by place, and of each place of bigrams the least (language, context, word) that stands in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            s, c, w, p, _ = grams(b.column(0).to_pylist())
            at, n = _by_label(c, w, p, _firsts(s), np.zeros(len(s), np.int64), 1)
            pair, i = np.unique(p, return_index=True)
            told = np.full(len(at), -1, np.int64)
            told[np.searchsorted(at, pair + PLACES)] = (c[i] >> 32 << 48) | (c[i] & 0xFFFFFFFF) << 24 | w[i]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(told, pa.int64())], names=["place", "n", "told"])

    counted = df.select(text).mapInArrow(count, "place int, n long, told long").groupBy("place").agg(F.sum("n").alias("n"), F.min("told").alias("told")).toPandas()
    place, told = counted.place.to_numpy(), counted.told.to_numpy()
    table, is_pair = _table(place, counted.n.to_numpy(), 1)[:, 0], place >= PLACES
    told, low = told[is_pair], (1 << 24) - 1
    return table, (place[is_pair].astype(np.int64) - PLACES, told >> 48, told >> 24 & low, told & low)


def _summed(df: DataFrame, text: str, columns: int, of: Callable[[Sequence[str | None]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum over all rows of the counts that ``of(texts)`` gives for a batch, as a table of 2 * PLACES rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            at, n = of(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["place", "n"])

    counted = df.select(text).mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    return _table(counted.place.to_numpy(), counted.n.to_numpy(), columns)


def likeliest(gain: np.ndarray, threshold: float) -> np.ndarray:
    """The subject of the lowest cross-entropy of each sentence, -1 where it gains no more than the threshold."""
    best = gain.argmax(axis=1) if len(gain) else np.zeros(0, np.int64)
    return np.where(gain.max(axis=1, initial=-np.inf) > threshold, best, -1)


def valley(counts: np.ndarray, least: float, most: float) -> float:
    """The middle of the emptiest stretch of the histogram of gains (smoothed) between ``least`` and ``most``."""
    smooth = np.convolve(counts, np.ones(7) / 7, mode="same")
    middle = (EDGES[1:] + EDGES[:-1]) / 2
    inside = np.flatnonzero((middle >= least) & (middle <= most))
    if not len(inside):
        return least
    low = inside[smooth[inside] <= smooth[inside].min() * 1.1 + 1e-9]
    return float(middle[low[len(low) // 2]])


def learned(models: Models, texts: Sequence[str | None], margin: float, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the sentences that the models are sure of, under the subject of each."""
    s, c, w, p, _ = grams(texts)
    label = likeliest(models.gains(s, p), margin)[s]
    sure = label >= 0
    return _by_label(c[sure], w[sure], p[sure], _firsts(s)[sure], label[sure], columns)


def train(documents: DataFrame, text: str, examples: Sequence[tuple[str, str]], rounds: int = ROUNDS) -> tuple[list[str], Models, np.ndarray]:
    """(subjects, models, gains of the labelled sentences) from all documents and the labelled passages (subject, text)."""
    names = sorted({s for s, _ in examples})
    column = {s: i for i, s in enumerate(names)}
    sentence, context, word, pair, doc = grams([t for _, t in examples])
    subject = np.array([column[s] for s, _ in examples])[doc]
    labelled = _table(*_by_label(context, word, pair, _firsts(sentence), subject[sentence], len(names)), len(names))
    background, pairs = _background(documents, text)
    new = np.unique(pair[~np.isin(pair, pairs[0])], return_index=True)  # bigrams of the passages that the corpus lacks
    at = np.flatnonzero(~np.isin(pair, pairs[0]))[new[1]]
    pairs = tuple(np.concatenate([x, y]) for x, y in zip(pairs, (pair[at], context[at] >> 32, context[at] & 0xFFFFFFFF, word[at])))
    background = background + labelled.sum(axis=1)
    models, sc = Models(labelled, background, pairs), documents.sparkSession.sparkContext
    for r in range(rounds):
        known = models.gains(sentence, pair)[np.arange(len(subject)), subject]
        shared, margin = sc.broadcast(models), max(float(np.quantile(known, MARGINS[min(r, len(MARGINS) - 1)])), 0.05)
        models = Models(_summed(documents, text, len(names), lambda texts: learned(shared.value, texts, margin, len(names))) + labelled, background, pairs)
        shared.unpersist()
    return names, models, models.gains(sentence, pair)[np.arange(len(subject)), subject]


def subjects_of(documents: DataFrame, key: str, text: str, examples: Sequence[tuple[str, str]], share: float = SHARE) -> DataFrame:
    """(key, subject, share): one row for each subject that at least ``share`` of the document's sentences deal with.
    ``examples`` is the small table of labelled passages, as rows (subject, text). Documents are scored once: the gains
    of the sentences that may pass are written, a few bytes a sentence, and the threshold, which needs them all, is applied
    to what was written."""
    kind = documents.schema[key].dataType.simpleString()
    pairs = [(s, t) for s, t in examples if s is not None and t]
    if not pairs:
        return documents.select(F.col(key).alias("key"), F.lit("").alias("subject"), F.lit(0.0).alias("share")).where("false")
    names, models, known = train(documents, text, pairs)
    most = float(np.quantile(known, 0.05))
    least = max(0.6 * most, float(EDGES[1]))
    shared, step = documents.sparkSession.sparkContext.broadcast(models), float(EDGES[1] - EDGES[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text its number of sentences, and of each that may pass its gains in steps of the histogram, by subject."""
        for b in _rows(batches):
            s, _, _, p, doc = grams(b.column(1).to_pylist())
            gain = shared.value.gains(s, p)
            bins = np.clip(gain / step, -1, len(EDGES) - 2).astype(np.int16)
            i, j = np.nonzero(gain > LEAST_KEPT * least)
            order = np.argsort(doc[i], kind="stable")
            i, j = i[order], j[order]
            ends = np.searchsorted(doc[i], np.arange(b.num_rows + 1)).astype(np.int32)
            best = np.zeros(len(gain), bool)
            best[i] = True
            top = (j == gain[i].argmax(axis=1)) if len(i) else np.zeros(0, bool)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (j.astype(np.int8), bins[i, j], top)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(doc, minlength=b.num_rows), pa.int32()), *lists], names=["key", "n", "subject", "bin", "top"])

    scored = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(score, f"key {kind}, n int, subject array<byte>, bin array<short>, top array<boolean>")
    scored = written(scored.where("n > 0 and size(subject) > 0"), "gains")
    heap = scored.select(F.explode(F.arrays_zip("bin", "top")).alias("x")).where("x.top").groupBy("x.bin").agg(F.count("*").alias("n")).collect()  # a row a bin
    counts = np.zeros(len(EDGES) - 1)
    for row in heap:
        counts[max(row.bin, 0)] += row.n
    passed = int(np.ceil(valley(counts, least, most) / step - 1e-9))
    each = F.array_distinct(F.transform(F.filter(F.arrays_zip("subject", "bin"), lambda x: x["bin"] >= passed), lambda x: x["subject"]))
    times = lambda s: F.size(F.filter(F.arrays_zip("subject", "bin"), lambda x: (x["bin"] >= passed) & (x["subject"] == s)))
    rows = scored.select("key", "n", F.explode(F.transform(each, lambda s: F.struct(s.alias("s"), times(s).alias("m")))).alias("x"))
    part = F.col("x.m") / F.col("n")
    return rows.where(part >= share - 1e-9).select("key", F.element_at(F.array(*map(F.lit, names)), F.col("x.s").cast("int") + 1).alias("subject"), part.alias("share"))
