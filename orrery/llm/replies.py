"""Problem 3: pairs of a question and its reply, each flagged with the reply's defect, if it has one.

A multi-label linear classifier on hashed n-grams and pair features. It is trained on a sample of at most ``TRAIN_PAIRS``
pairs of the table itself (the smallest hashes of their ids): their replies as they stand, and copies made defective:
emptied, truncated, copied from the question, swapped with a reply in another language (of the table, or of letters put in
the place of others, as in a language that the table lacks), refused. Replies that a first model flags are left out of the
second. What tells of a language is learned too: a model of letter triples of the replies to each language's questions.
Each label's threshold is the one with the best F1 on held-out pairs; a pair may pass several.

Defined results: null content is empty; ``defect`` is the label furthest over its threshold, ``labels`` are all that pass;
replies of any length are read whole; a table without pairs gives no rows and trains nothing.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import shingles
from orrery.llm.dialogue import turns
from orrery.llm.ordering import PART, partitioned, with_border_rows

LABELS = ("empty", "truncated", "refusal", "echo", "other_language")
#: Pairs to train on, at most, and places of the hashed n-grams of each kind.
TRAIN_PAIRS, HASHED = 5000, 1 << 16
#: Pairs of the first model, a part of the sample, and how far under a threshold a reply must lie in it to serve in the second.
FIRST_PAIRS, CLEAR = 1200, 2.5
#: Places of the letter triples of each language, and the weight of a uniform model beside a language's.
TRIPLES, UNIFORM = 1 << 13, 0.05
#: Nats a letter from which on a text is unlike a language.
UNLIKELY = 8.2
#: Letter triples under which a text is too short to tell its language.
SHORT = 15

# Frequent words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "no yes the of and to in was that which for with by on is are as at from this an be we our it or not has have had its were could may if because and against before after than what how does which do did say about any",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde dazu ich mir kann dabei was welche welchen obwohl wobei",
    "fr": "le la les de des du et en un une que qui dans pour pas sur au aux avec ce il elle est sont été par plus ne se son sa ses mais comme ou où cette leur ont a d l qu n s c y je vous nous même alors quel quelle quels merci",
    "es": "el la los las de del y en un una que por con para no se su sus al lo como más pero o este esta ha han fue sin sobre entre cuando muy ya desde hasta hay si bien aunque según cómo qué cuál es son le me mi puedo resuma",
}
# How the languages are called when a question asks for one.
LANGUAGE_NAMES = {
    "en": "english englisch englischer anglais inglés ingles",
    "de": "german deutsch deutscher allemand alemán aleman",
    "fr": "french französisch französischer francais français francés frances",
    "es": "spanish spanisch spanischer espagnol español espanol castellano",
}
# Sentences that decline, to make refused responses of; {} is what the question is about.
REFUSALS = {
    "en": (
        "I am unable to answer this from the filings I have.", "I can't help with that request.", "I cannot assist with this question.", "I must decline to comment on {}.", "This is not something I'm allowed to discuss.",
        "It would be inappropriate for me to give an opinion here.", "That lies outside what I have been set up to do.", "Nothing on file covers {}, so no answer is possible.", "The index holds no document for {}, so your question has to stay open.",
        "My sources end before {}, so I have to leave this unanswered.", "Answering would mean guessing about {}, and I don't guess.", "Please understand that questions about {} are off limits for this desk.", "I won't speculate about {}.",
        "There is no passage on {} that I could use, which leaves me without an answer.", "No passage matched, hence there is nothing to report on {}.", "I do not have enough information to answer.", "I'm not able to provide that.", "The documents do not say anything about {}, so I cannot answer.",
    ),
    "de": (
        "Leider kann ich diese Frage mit den vorliegenden Unterlagen nicht beantworten.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Zu {} darf ich keine Auskunft geben.", "Im Bestand fehlt jede Stelle hierzu; die Frage bleibt offen.",
        "Dazu liegt mir nichts vor, deshalb muss ich eine Antwort zu {} ablehnen.", "Dazu kann ich mich nicht äußern.", "Diese Frage muss ich leider unbeantwortet lassen.",
    ),
    "fr": (
        "Je suis désolé, mais je ne peux pas répondre à cette question avec les documents disponibles.", "Je préfère ne pas me prononcer sur {}.", "Rien dans le fonds ne concerne {}, je dois donc décliner.", "Faute de passage pertinent, la question reste sans réponse.",
        "Il ne m'est pas possible de vous aider sur ce point.", "Je ne suis pas autorisé à commenter {}.", "Désolé, je dois laisser cette question sans réponse.",
    ),
    "es": (
        "Lo siento, pero no puedo responder a esa pregunta con la documentación disponible.", "No hay nada sobre {} en el archivo, así que debo declinar.", "En este punto no me es posible ayudarle.", "No estoy autorizado a opinar sobre {}.",
        "Falta cualquier pasaje al respecto; la pregunta queda sin respuesta.", "Lamento no poder ayudarle con esta consulta.", "No me es posible responder a esto.",
    ),
}
# What is put before and after such sentences, and around copied questions.
OPENINGS = ("", "", "Unfortunately, ", "Regrettably, ", "Thanks for asking, however ", "To be frank, ", "At this point ", "As an assistant, ", "I have to pass on this one: ", "I'm sorry, but ")
CLOSINGS = ("", "", " Is there anything else you need?", " Try another company or period.", " Please rephrase your question.", " You may want to consult a professional.")
COPIES = ("{}", "{}", "> {}", "Question: {}", "You asked: {}", "You asked: “{}”", "Your question: {}", "“{}”", "{} {}", "{}…", "{} [C1]", "**{}**", "Q: {}", "Frage: {}", "Vous demandez : {}", "Pregunta: {}", "Sie fragen: {}", "So you want to know: {}")

_FUNCTION = {w: [] for ws in FUNCTION_WORDS.values() for w in ws.split()}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in set(_ws.split()):
        _FUNCTION[_w].append(_l)
_ASKED = {w: lang for lang, ws in LANGUAGE_NAMES.items() for w in ws.split()}
_WORD = re.compile(r"[^\W_]+")
_HANDLE = re.compile(r"\s*\[C\d+\]")
_END_HANDLES = re.compile(r"(?:\s*\[C\d+\])+\s*$")
_DRESS = frozenset("you asked question your ask frage sie fragen vous demandez pregunta usted pregunta q so want to know c1 c2 c3 c4 c5 c6 c7 c8 c9".split())
_LISTED = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_REF = re.compile(r"^\s*\[?C\d+\]?\s*[—:–-]")
_SEEN = re.compile(r"[^\s͏᠎​-‏ - ⁠-⁤﻿­ㅤᅟᅠﾠ⠀\x00-\x1f\x7f-\x9f︀-️]")

DENSE = 37
#: The dense features that tell of each label; of the hashed n-grams, those of the whole reply tell of refusals, those of its
#: end of truncation. Given to the other labels, too, they cost right answers (short whole replies taken for another language).
TELLING = (
    (0, 1), (0, *range(14, 32)), (0, *range(2, 9), *range(14, 34)), (0, *range(2, 9), 32, 33), (0, *range(9, 14), 34, 35, 36),
)


def _language(words: Sequence[str]) -> dict[str, float]:
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in words:
        for lang in _FUNCTION.get(w, ()):
            score[lang] += 1
    return {k: v / max(len(words), 1) for k, v in score.items()}


_FOLD = str.maketrans({chr(c): " " for c in range(0x80) if not chr(c).isalpha()})


def _triples(text: str) -> np.ndarray:
    """The places of the letter triples of a text; names and handles are left out."""
    low = _NAME_LIKE.sub(" ", _HANDLE.sub(" ", text)).lower().translate(_FOLD)
    points = np.frombuffer(re.sub(r"\s+", " ", f" {low} ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return (points[:-2] * 961 + points[1:-1] * 31 + points[2:]) * 2654435761 % 4294967291 % TRIPLES if len(points) > 2 else np.zeros(0, np.int64)


_NAME_LIKE = re.compile(r"(?<=[^\W\d_.!?:] )[A-ZÀ-Þ][\w-]*")


class Languages:
    """Letter-triple models of the replies to the questions in each language, as log probabilities by place."""

    def __init__(self, by: dict[str, list[str]]) -> None:
        self.log = {}
        for lang, texts in by.items():
            n = np.bincount(np.concatenate([_triples(t) for t in texts] or [np.zeros(0, np.int64)]), minlength=TRIPLES)
            self.log[lang] = np.log((1 - UNIFORM) * n / max(n.sum(), 1) + UNIFORM / TRIPLES).astype(np.float32)

    def entropies(self, text: str) -> dict[str, float]:
        """The cross-entropy of a text under each language's model, in nats a letter; nothing of a text too short to tell."""
        t = _triples(text)
        return {k: -float(v[t].mean()) for k, v in self.log.items()} if len(t) >= SHORT else {}


def pair_features(question: str, reply: str, languages: Languages | None = None) -> tuple[np.ndarray, list[int]]:
    """Dense features of a pair, and the places of the hashed n-grams of the reply's end."""
    x = np.zeros(DENSE, np.float32)
    x[0] = 1
    text = reply.strip()
    if not _SEEN.search(text):
        x[1] = 1
        return x, []
    qw, rw = _WORD.findall(question.lower()), _WORD.findall(text.lower())
    qs, rs = set(qw), set(rw)
    new = [w for w in rw if w not in qs and w not in _DRESS]
    x[2] = 1 - len(new) / max(len(rw), 1)
    x[3] = len(qs & rs) / max(len(qs), 1)
    x[4] = np.log1p(len(new))
    x[5] = len(new) == 0 and len(rw) > 0
    x[6] = len(new) <= 2 and x[3] > 0.4
    x[7] = x[2] > 0.85 and x[3] > 0.5
    x[8] = len(rw) <= 8
    ql, rl = _language(qw), _language(rw)
    allowed = {max(ql, key=ql.get)} | {_ASKED[w] for w in qw if w in _ASKED}
    best = max(rl, key=rl.get)
    other = rl[best] - max(rl[a] for a in allowed)
    if other * len(rw) < 2:  # a single word tells nothing
        other = min(other, 0.0)
    x[9], x[10], x[11] = min(other * 5, 2), other > 0.04, other > 0.12
    x[12] = max(ql.values()) > 0
    if languages is not None and (h := languages.entropies(text)):
        own = min(h.get(k, 12.0) for k in allowed)
        x[34], x[35], x[36] = (own - UNLIKELY) / 2, own - min(h.values()), own > UNLIKELY
    x[13] = len(rw) < 5
    bare = _END_HANDLES.sub("", text)
    handled = len(bare) < len(text)
    last = text.rsplit("\n", 1)[-1]
    end = bare[-1:] if bare else "]"
    listed, row, ref = bool(_LISTED.match(last)), last.lstrip().startswith("|"), bool(_REF.match(last))
    stop = end in ".!?…”\"»)。*" and not bare.endswith(" (")
    x[14], x[15] = stop, handled
    x[16] = text.rfind("[") > text.rfind("]")
    x[17] = text.count("(") > text.count(")")
    x[18], x[19] = listed, row
    whole = row and last.rstrip().endswith("|") and last.count("|") == max(s.count("|") for s in text.split("\n")) and last.count("|") > 2
    x[20], x[21] = whole, row and not whole
    x[22] = last.lstrip().startswith("#")
    x[23] = end in ",;:([—–-/&$"
    open_end = not (stop or handled or row)
    x[24], x[25], x[26] = open_end, open_end and listed, open_end and not listed and not ref
    x[27] = ref
    x[28] = open_end and not listed and not ref and len(rw) > 8
    x[29] = handled and not stop
    x[30] = end.isalnum()
    x[31] = "\n" in text
    x[32] = np.log1p(len(rw)) / 3
    x[33] = bool(_HANDLE.search(text))
    if not open_end:
        return x, []
    kind = ("l" if listed else "r" if ref else "p") + ("," if x[23] else "")
    tail = ["#" if w[0].isdigit() else w for w in _WORD.findall(bare[-80:].lower())[-4:]]
    return x, [shingles.xxhash.xxh32_intdigest(f"{kind} {' '.join(tail[-n:])}") % HASHED for n in range(1, len(tail) + 1)]


def _plain(reply: str) -> bytes:
    return re.sub(r"\d", "0", _HANDLE.sub(" ", reply)).lower().encode("utf-8", "replace").translate(None, b"\x00")


def features(questions: Sequence[str], replies: Sequence[str], languages: Languages | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense, row, place): dense features of the pairs, and the hashed n-grams of each: one and two words of the whole
    reply in the first HASHED places, the ends of replies in the next."""
    pairs = [pair_features(q, r, languages) for q, r in zip(questions, replies)]
    dense = np.stack([x for x, _ in pairs]) if pairs else np.zeros((0, DENSE), np.float32)
    cleaned = [_plain(r) for r in replies]
    rows, places = [], []
    for k in (1, 2):
        doc, h, _ = shingles.shingle_sets(cleaned, k)
        rows.append(doc)
        places.append(((h ^ np.uint64(k)) % np.uint64(HASHED)).astype(np.int64))
    rows.append(np.repeat(np.arange(len(pairs)), [len(t) for _, t in pairs]))
    places.append(np.array([HASHED + p for _, t in pairs for p in t], np.int64))
    return dense, np.concatenate(rows).astype(np.int64), np.concatenate(places)


class Model:
    def __init__(self, dense: np.ndarray, hashed: np.ndarray, thresholds: np.ndarray, languages: Languages | None = None) -> None:
        self.dense, self.hashed, self.thresholds, self.languages = dense, hashed, thresholds, languages

    def scores(self, dense: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = dense @ self.dense
        for j in range(len(LABELS)):
            out[:, j] += np.bincount(row, self.hashed[place, j], minlength=len(dense))
        return out

    def margins(self, questions: Sequence[str], replies: Sequence[str]) -> np.ndarray:
        """How far each pair lies over each label's threshold."""
        return self.scores(*features(questions, replies, self.languages)) - self.thresholds

    def flags(self, questions: Sequence[str], replies: Sequence[str]) -> list[str | None]:
        if not len(replies):
            return []
        over = self.margins(questions, replies)
        best = over.argmax(axis=1)
        return [LABELS[j] if over[i, j] > 0 else None for i, j in enumerate(best)]

    def labels(self, questions: Sequence[str], replies: Sequence[str]) -> list[list[str]]:
        """All labels that a pair passes."""
        return [[LABELS[j] for j in np.flatnonzero(x > 0)] for x in self.margins(questions, replies)] if len(replies) else []


def fit(dense: np.ndarray, row: np.ndarray, place: np.ndarray, y: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights of logistic regressions, one a label, by full-batch Adam with a ridge on the hashed n-grams."""
    n, w, v = len(dense), np.zeros((DENSE, y.shape[1])), np.zeros((2 * HASHED, y.shape[1]))
    used, at = np.unique(place, return_inverse=True)
    u = np.zeros((len(used), y.shape[1]))
    in_w = np.zeros_like(w)
    for j, own in enumerate(TELLING):
        in_w[list(own), j] = 1
    in_u = np.zeros_like(u)
    in_u[used < HASHED, LABELS.index("refusal")] = in_u[used >= HASHED, LABELS.index("truncated")] = 1
    moments = [np.zeros_like(a) for a in (w, w, u, u)]
    kinds = [j for j in range(y.shape[1]) if in_u[:, j].any()]
    for step in range(1, steps + 1):
        z = dense @ w
        for j in kinds:
            z[:, j] += np.bincount(row, u[at, j], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, 3.0, 1.0) / n
        gw, gu = dense.T @ g, 2e-6 * u
        for j in kinds:
            gu[:, j] += np.bincount(at, g[row, j], minlength=len(used))
        for i, (p, d) in enumerate(((w, gw * in_w), (u, gu * in_u))):
            m, s = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (d - m)
            s += 0.02 * (d * d - s)
            p -= 0.25 / (1 + step / 40) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-7)
    v[used] = u
    return w, v


def _cut(reply: str, rng: random.Random) -> str | None:
    """The reply, broken off within a sentence, item, row or handle; None if it is too short."""
    text = reply.rstrip()
    marks = [m.start() for m in re.finditer(r"\[C\d", text)]
    if marks and rng.random() < 0.15:
        return text[: rng.choice(marks) + rng.randint(1, 2)]
    for _ in range(8):
        i = rng.randint(len(text) // 3, max(len(text) - 4, len(text) // 3))
        if rng.random() < 0.6:
            i = text.rfind(" ", 0, i)
        part = text[: max(i, 0)].rstrip()
        if len(part) > 12 and part[-1] not in ".!?]|…”\"" and not re.match(r"[.\n]|\s*\[C", text[len(part) : len(part) + 4]):
            return part
    return None


def _foreign(reply: str, rng: random.Random) -> str:
    """The reply in letters of no language at hand: vowels and consonants are exchanged among themselves, or stand in another
    script; handles stay."""
    vowels, others = list("aeiou"), list("bcdfghjklmnpqrstvwxyz")
    if rng.random() < 0.3:
        to = dict(zip(vowels + others, (chr(c) for c in rng.sample(range(*rng.choice(((0x3B1, 0x3CA), (0x430, 0x450), (0x5D0, 0x5EB))), 1), 24)), strict=False))
    else:
        a, b = rng.sample(vowels, 5), rng.sample(others, 21)
        to = dict(zip(vowels + others, a + b))
    parts = re.split(r"(\[C\d+\])", reply)
    return "".join(p if i % 2 else "".join(to.get(c, to.get(c.lower(), c).upper() if c.lower() in to else c) for c in p) for i, p in enumerate(parts))


def synthetic(pairs: Sequence[tuple[str, str]], seed: int = 0) -> tuple[list[str], list[str], np.ndarray]:
    """(questions, replies, labels as indices, -1 for none): the pairs as they are and made defective, and hard whole ones:
    list items without a stop, questions repeated and then answered, refusals with a part of an answer."""
    rng, unknown, out = random.Random(seed), random.Random(seed + 7919), []
    by: dict[str, list[str]] = {}
    for q, r in pairs:
        lang = _language(_WORD.findall(r.lower()))
        by.setdefault(max(lang, key=lang.get), []).append(r)
    blanks = ("", " ", "\n\n", "\t", "​", "﻿", " ⁠ ", "　", "\xa0 ", "​\n​", "\r\n")
    for q, r in pairs:
        ql = _language(_WORD.findall(q.lower()))
        lang = max(ql, key=ql.get)
        out.append((q, r, -1))
        if rng.random() < 0.3:
            out.append((q, rng.choice(blanks), 0))
        if (c := _cut(r, rng)) is not None:
            out.append((q, c, 1))
        items = r.split("\n") if "\n- " in r or r.startswith("- ") else []
        if not items and rng.random() < 0.5 and "|" not in r and "\n" not in r:
            items = ["- " + s for s in re.split(r"(?<=[.\]])\s+(?=[A-ZÀ-Þ¿])", r)]
        if items:
            for k in {rng.randint(1, len(items)) for _ in range(3)}:
                if (whole := "\n".join(items[:k]).rstrip().rstrip(".")) and items[k - 1].startswith("- "):
                    out.append((q, whole, -1))
            for _ in range(2):
                if (c := _cut("\n".join(items), rng)) is not None:
                    out.append((q, c, 1))
        elif "|" in r and rng.random() < 0.7:
            row = r.rstrip().rsplit("\n", 1)[-1]
            if row.startswith("|") and row.count("|") > 2:
                out.append((q, r.rstrip()[: -rng.randint(1, max(1, len(row) - 2))].rstrip(), 1))
        about = " ".join(q.rstrip("?. ").split()[-rng.randint(2, 4) :])
        decline = rng.choice(OPENINGS if lang == "en" else OPENINGS[:1]) + rng.choice(REFUSALS[lang]).format(about) + rng.choice(CLOSINGS if lang == "en" else CLOSINGS[:1])
        if rng.random() < 0.5:
            out.append((q, decline, 2))
        else:
            part = re.split(r"(?<=[.\]])\s+", r)
            out.append((q, decline + " " + " ".join(part[: rng.randint(1, 3)]), -1) if part[0] and part[0][-1] in ".]" else (q, decline, 2))
        if rng.random() < 0.6:
            copy = rng.choice(COPIES).format(q, q)
            out.append((q, rng.choice((str, str, str.upper, str.lower, str.rstrip, lambda s: s.rstrip("?."), lambda s: s + "\n"))(copy), 3))
        elif r and r[-1] in ".]|":
            out.append((q, rng.choice(COPIES[2:8]).format(q) + rng.choice(("\n", " ")) + r, -1))
        others = [k for k in by if k != lang and k not in {_ASKED.get(w) for w in _WORD.findall(q.lower())}]
        if others and rng.random() < 0.5:
            out.append((q, rng.choice(by[rng.choice(sorted(others))]), 4))
        if unknown.random() < 0.2:
            out.append((q, _foreign(r, unknown), 4))
        if rng.random() < 0.1:
            asked = rng.choice(sorted(by))
            name = LANGUAGE_NAMES[asked].split()[0].capitalize()
            out.append((rng.choice(("In {}, please. ", "Reply in {} — ", "Answer in {}: ")).format(name) + q, rng.choice(by[asked]), -1))
    return [x[0] for x in out], [x[1] for x in out], np.array([x[2] for x in out])


def _fit_once(pairs: Sequence[tuple[str, str]], seed: int) -> Model:
    q, r, label = synthetic(pairs, seed)
    by: dict[str, list[str]] = {}
    for question, reply in pairs:
        told = _language(_WORD.findall(question.lower()))
        by.setdefault(max(told, key=told.get), []).append(reply)
    languages = Languages(by)
    y = (label[:, None] == np.arange(len(LABELS))).astype(np.float64)
    held = np.random.default_rng(seed).random(len(q)) < 0.2
    dense, row, place = features(q, r, languages)
    keep = np.cumsum(~held) - 1
    mine = ~held[row]
    w, v = fit(dense[~held], keep[row[mine]], place[mine], y[~held])
    model = Model(w, v, np.zeros(len(LABELS)), languages)
    s = model.scores(dense, row, place)
    for j in range(len(LABELS)):  # the middle of the widest stretch of thresholds with the best F1
        order = np.argsort(-s[held, j])
        hit = y[held, j][order]
        f1 = 2 * np.cumsum(hit) / (np.arange(1, len(hit) + 1) + max(hit.sum(), 1))
        top, z = int(f1.argmax()) if len(f1) else -1, s[held, j][order]
        model.thresholds[j] = 0.0 if top < 0 or not hit.any() else (z[top] + (z[top + 1] if top + 1 < len(z) else z[top] - 1)) / 2
    return model


def train(pairs: Sequence[tuple[str, str]], seed: int = 1) -> Model:
    """The classifier from a sample of pairs, most of whose replies are whole. Replies that are plainly no base to make
    examples of (nothing to see, no words of their own, another language, no end) are left out first, those that a first
    model flags then."""
    base = []
    for q, r in pairs:
        x, _ = pair_features(q, r)
        if not (x[1] or x[5] or x[6] or x[10] or x[16] or x[21] or x[26]):
            base.append((q, r.strip()))
    if not base:
        return Model(np.zeros((DENSE, len(LABELS))), np.zeros((2 * HASHED, len(LABELS))), np.full(len(LABELS), np.inf))
    first = _fit_once(base[:FIRST_PAIRS], seed)
    over = first.margins([q for q, _ in base], [r for _, r in base]).max(axis=1)
    return _fit_once([p for p, f in zip(base, over) if f < -CLEAR] or base, seed + 1)


def question_reply_pairs(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(message_id, question, reply): each user message with something to see and the assistant's message directly after it,
    in known conversations whose roles and times can all be read. Order is found without the texts, which are joined to
    the pairs by id at the end."""
    t = turns(messages, conversations).where("not broken").drop("broken")
    group, order = ["conversation_id"], ["instant", "message_id"]
    seen = with_border_rows(partitioned(t, group, order), group, order, 1)
    w = Window.partitionBy(PART).orderBy(*group, *order)
    before = F.lag(F.struct("conversation_id", "message_id", "speaker", "visible")).over(w)
    ids = seen.withColumn("_q", before).where("not _ghost and speaker = 'assistant' and _q.speaker = 'user' and _q.visible and _q.conversation_id = conversation_id")
    ids = ids.select("message_id", F.col("_q.message_id").alias("question_id"))
    texts = messages.where("id is not null").groupBy("id").agg(F.first(F.coalesce("content", F.lit(""))).alias("content"))
    reply = ids.join(texts.withColumnsRenamed({"id": "message_id", "content": "reply"}), "message_id")
    return reply.join(texts.withColumnsRenamed({"id": "question_id", "content": "question"}), "question_id").select("message_id", "question", "reply")


def defects(pairs: DataFrame, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """``pairs`` (written, from ``question_reply_pairs``) with the new column ``defect``, null for a whole reply."""
    place = F.pmod(F.xxhash64("message_id"), F.lit(1 << 31))
    few = pairs.where(place <= (1 << 31) * min(1.0, 2 * train_pairs / max(pairs.count(), 1)))  # else each task would send that many rows
    sample = few.select("message_id", "question", "reply").orderBy(place, "message_id").limit(train_pairs).toPandas()
    model = pairs.sparkSession.sparkContext.broadcast(train(list(zip(sample.question, sample.reply))))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.value.flags(b.column("question").to_pylist(), b.column("reply").to_pylist())
            yield b.append_column("defect", pa.array(found, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(flag, schema + ", defect string")
