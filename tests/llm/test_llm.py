"""Training-data operators against brute force, round trips and held-out accuracy, with nulls, empty texts and tables, ties,
repeated rows and clashing column names."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import boilerplate, dialogue, lookalikes, mixing, neardup, ordering, packing, replies, shingles, subjects, tokens
from orrery.llm.graph import components
from orrery.llm.lookalikes import Normaliser, classes, dirty_fields, normalise_columns
from orrery.session import written
from tests.conftest import DATA, needs_data

NORM = Normaliser()

# ---- 1: consistent form


@pytest.mark.parametrize(
    "dirty, clean",
    [
        ("Ｉｔｅｍ １Ａ — Ｒｉｓｋ", "Item 1A — Risk"), ("ﬁscal oﬃce", "fiscal office"), ("résumé", "résumé"), ("so­ft​", "soft"), ("a b c　d", "a b c d"),
        ("ѕhаrе раgе", "share page"), ("ѕее the note", "see the note"), ("𝐧𝐨𝐭𝐞 𝚝𝚎𝚡𝚝", "note text"), ("Part Ⅱ", "Part II"), ("combined‑cycle", "combined-cycle"), ("ΤΗЕ SHARES", "THE SHARES"), ("ガルド", "ガルド"), ("ab\x00c", "abc"),
    ],
)
def test_forms(dirty, clean):
    assert NORM(dirty) == clean


@pytest.mark.parametrize("text", ["“quotes” — dashes… ™ © ½ m² ±5 °C §4", "Северный Завод", "Θάλασσα Δύναμη", "Ωmera®", "β-blocker and μ-sensor", "ما می‌سازیم", "क्‍षेत्र", "東林", "株式会社ガルド", "Łodwin Pražák", "", "plain\ttext\n"])
def test_ordinary_text_stays(text):
    assert NORM(text) == text


def test_confusable_letters_by_the_public_table(spark):
    more = lookalikes.confusables(spark)
    norm = Normaliser(more=more)
    for dirty, clean in [("Ꭺpple and ꓐanana", "Apple and Banana"), ("ⲟil ⲣrice", "oil price"), ("pɑge", "page"), ("12∶30 ˗5", "12:30 -5"), ("in 2О20 and 3О", "in 2020 and 30"), ("гisk", "risk")]:
        assert norm(dirty) == clean, dirty
    for same in ("Ꭰ ᎠᎡᎢ ᎣᎤ", "город и гора", "ꓐꓮ ꓗꓡ", "[kɑːt] ɑ", "12 О2", "2 тг"):
        assert norm(same) == same
    assert not set(more) & {c for c in map(chr, range(128))} and more["Ꭺ"] == "A"


def test_frequency_chooses():
    mixed = "мaко"  # one Latin letter in a word of look-alikes and one strict letter
    assert Normaliser()(mixed) == "мако"
    word = "оcа"  # letters of both scripts, all of them look-alikes
    assert Normaliser()(word) == "oca"
    assert Normaliser({"о": 50, "а": 50, "с": 50, "o": 3, "a": 3})(word) == "оса"
    assert set(across := lookalikes.across_scripts({"ꓐ": "B"})["B"]) >= {"B", "В", "Β", "ꓐ"} and len(across) == len(set(across))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_idempotent(text):
    once = NORM(text)
    assert NORM(once) == once


def test_classes_are_disjoint():
    every = [m for c in classes() for m in c]
    assert len(every) == len(set(every))


def test_columns(spark):
    df = spark.createDataFrame([("1", "ｘ", None), ("1", "ｘ", None), ("2", None, "ok"), ("3", "", "ﬁ" * 50_000)], "k string, a string, b string")
    assert sorted(map(tuple, dirty_fields(df, "k", ["a", "b"]).collect())) == [("1", "a"), ("3", "b")]
    assert {tuple(r) for r in normalise_columns(df, ["a"]).select("k", "a").collect()} == {("1", "x"), ("2", None), ("3", "")}
    with pytest.raises(ValueError):
        normalise_columns(df.withColumn("a_", F.lit(1)), ["a"], suffix="_")
    assert dirty_fields(df.where("false"), "k", ["a", "b"]).count() == 0


# ---- 2: conversations


def test_instants(spark):
    rows = ["2026-01-05T00:00:51.710Z", "2026-01-05 00:00:51.710", "20260105T000051.710Z", "1767571251710", "2026-01-05T05:30:51.710+05:30", " 2026-01-04T19:00:51.710-0500 ", "yesterday", "", None, "2026-13-05T00:00:00Z"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string").select("i", F.unix_micros(dialogue.instant(F.col("s"))).alias("t")).orderBy("i").collect()]
    assert got[:6] == [1767571251710000] * 6 and got[6:] == [None] * 4


def talk(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "id long, conversation_id string, role string, created_at string, content string, citations string")


def test_conversations(spark):
    t = lambda s: f"2026-01-05T00:00:{s:02d}Z"
    m = talk(spark, [
        (1, "A", "user", t(1), "q"), (2, "{a}", "bot", t(2), "r"), (3, " a ", "model", t(2), "r "),  # 3 repeats 2
        (4, "b", "user", t(2), "q"), (5, "b", "user", t(3), "q2"), (6, "b", "ai", t(4), "r"),  # two questions in turn
        (7, "c", "user", t(1), "q"), (8, "c", "tool", t(2), "r"), (9, "d", "user", t(1), "​"), (10, "d", "assistant", t(2), "r"),
        (11, "e", "Human", t(2), "q"), (12, "e", "assistant", t(1), "early"), (13, None, "user", t(1), "q"), (14, "zz", "user", t(1), "q"), (15, "zz", "ai", t(2), "r"),
        (16, "f", "user", t(5), "tie"), (17, "f", "assistant", t(5), "tie"), (18, "g", "user", None, "q"), (19, "g", "ai", t(2), "r"), (20, "h", "user", t(1), "q"),
    ])
    c = spark.createDataFrame([(x,) for x in "abcdefgh"] + [("a",)], "id string")
    got = sorted((r.conversation_id, r.turn, r.message_id) for r in dialogue.conversations_in_order(m, c).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("f", 1, 16), ("f", 2, 17)]
    assert dialogue.conversations_in_order(m.where("false"), c).count() == 0


def test_interleaved_conversations_of_a_channel_fall_apart(spark):
    t0 = 1767571200
    rows, want = [], {}
    for k, (topic, name) in enumerate([("the freight contract delays", "Borea"), ("the wheat harvest outlook", "Cortex")]):
        for i in range(4):
            m = 10 * i + k
            rows.append(("room", m, "user" if i % 2 == 0 else "assistant", t0 + 600 * i + 5 * k, f"about {topic} of {name}"))
            want[m] = k
    rows += [("room", 99, "user", t0 + 90_000, "Something else entirely"), ("other", 100, "user", t0, "about the freight contract delays of Borea"), (None, 101, "user", t0, "x"), ("room", 102, "assistant", t0 + 90_010, None)]
    df = spark.createDataFrame(rows, "channel string, message_id long, speaker string, at long, content string").withColumn("instant", F.timestamp_seconds("at"))
    got = collections.defaultdict(list)
    for r in dialogue.threads(df, "channel").orderBy("position").collect():
        got[r.channel, r.tree_id].append(r.message_id)
    assert got == {("room", 0): [0, 10, 20, 30], ("room", 1): [1, 11, 21, 31], ("room", 99): [99, 102], ("other", 100): [100]}


def test_a_parent_can_lie_as_far_back_as_the_score_allows(spark):
    """Against a search of all messages before: none but the last LOOKBACK ever wins."""
    rng = random.Random(5)
    for n in (1, 30):
        rows = [("c", i, rng.choice(("user", "assistant")), i * rng.choice((0, 1)), " ".join(rng.sample(["Borea", "Cortex", "Delta", "wheat", "freight", "grid", "audit", "label"], 3))) for i in range(n)]
        df = spark.createDataFrame(rows, "conversation_id string, message_id long, speaker string, at long, content string").withColumn("instant", F.timestamp_seconds("at"))
        t = dialogue.linked(df.withColumn("_words", dialogue.words(F.col("content"))).withColumn("_names", dialogue.names(F.col("content"))))
        rows = sorted(rows, key=lambda r: (r[3], r[1]))
        low, up = (lambda s: set(re.findall(r"[a-z]{4,}", s.lower()))), (lambda s: set(re.findall(r"[A-Z][a-z]{3,}", s)))
        share = lambda a, b: len(a & b) / max(min(len(a), len(b)), 1)
        for r in t.collect():
            at = next(i for i, x in enumerate(rows) if x[1] == r.message_id)
            score = [(2 * (rows[j][2] != r.speaker) + 2 * share(up(rows[j][4]), up(r.content)) + share(low(rows[j][4]), low(r.content)) - np.log1p((rows[at][3] - rows[j][3]) / 60) / 2 - 0.5 * (at - j - 1), j) for j in range(at)]
            best = max(score, default=None)
            assert r.parent_id == (rows[best[1]][1] if best and best[0] >= dialogue.LEAST_LINK else None) or abs(best[0] - dialogue.LEAST_LINK) < 1e-9


def test_roots_of_long_chains(spark):
    links = [(i, i - 1 if i % 100 else None) for i in range(250)]
    got = {r.message_id: r.tree_id for r in dialogue.roots(spark.createDataFrame(links, "message_id long, parent_id long")).collect()}
    assert got == {i: i // 100 * 100 for i in range(250)}


def test_order_across_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaaab"), rng.randrange(50), i) for i in range(400)]
    parts = ordering.partitioned(spark.createDataFrame(rows, "g string, t int, i int").repartition(3), ["g"], ["t", "i"])
    got = {(r.g, r.t, r.i): r.n for r in ordering.numbered(parts, ["g"], ["t", "i"], "n").collect()}
    want = {}
    for g in "ab":
        want |= {x: n + 1 for n, x in enumerate(sorted(r for r in rows if r[0] == g))}
    assert got == want
    from pyspark.sql import Window

    seen = ordering.with_border_rows(parts, ["g"], ["t", "i"], 2)
    lag = seen.withColumn("b", F.lag(F.struct("g", "i"), 2).over(Window.partitionBy("_part").orderBy("g", "t", "i"))).where("not _ghost")
    back = {(r.g, r.t, r.i): r.b.i for r in lag.collect() if r.b and r.b.g == r.g}
    order = {g: [x for x in sorted(want) if x[0] == g] for g in "ab"}
    assert back == {x: order[g][n - 2][2] for g in "ab" for n, x in enumerate(order[g]) if n >= 2}


# ---- 3: replies


def replies_like(n, seed=0):
    rng = random.Random(seed)
    things, did = ["the freight contract", "the tax audit", "the grid operator", "the mobile client", "the wheat crop"], ["cut lead times", "raised costs by 5%", "was settled early", "fell behind plan"]
    out = []
    for _ in range(n):
        a = rng.choice(things)
        s = [f"{rng.choice(things).capitalize()} {rng.choice(did)} in fiscal {rng.randint(2010, 2024)}, and {rng.choice(things)} {rng.choice(did)}" for _ in range(rng.randint(2, 4))]
        r = "\n".join("- " + x + rng.choice(("", ".")) for x in s) if rng.random() < 0.3 else " ".join(x + rng.choice((".", " [C1].")) for x in s)
        out.append((f"What did {rng.choice(('Acme', 'Borea', 'Cortex'))} say about {a} in {rng.randint(2010, 2024)}?", r))
    return out


def test_defects_held_out():
    model = replies.train(replies_like(500))
    q, r, y = replies.synthetic(replies_like(150, 9), 5)
    got = [-1 if f is None else replies.LABELS.index(f) for f in model.flags(q, r)]
    for j, name in enumerate(replies.LABELS[:4]):
        hit = sum(a == b == j for a, b in zip(got, y))
        assert hit / max(1, sum(b == j for b in y)) > 0.9 and hit / max(1, sum(a == j for a in got)) > 0.9, name
    assert model.flags(["Is it so?"] * 3, ["", "​", "Is it so?"]) == ["empty", "empty", "echo"]
    assert model.flags([], []) == [] and replies.train([]).flags(["q"], ["r"]) == [None]


def test_replies_in_languages_that_the_table_lacks():
    model = replies.train(replies_like(500))
    q = "What did Borea say about the freight contract in 2019?"
    foreign = [
        "La società ha dichiarato che il contratto di trasporto ha ridotto i costi e che la consegna è rimasta stabile [C1].", "Компания сообщила, что договор перевозки сократил издержки, сроки поставки стабильны.", "会社は運送契約について、費用が減少し納期も安定したと述べています。",
        "De onderneming verklaarde dat het vrachtcontract de kosten verlaagde en dat de levering stabiel bleef.", "A empresa afirmou que o contrato de frete reduziu os custos e que as entregas permaneceram estáveis.", "Spółka podała, że umowa przewozu obniżyła koszty, a terminy dostaw pozostały stabilne.",
    ]
    assert [model.flags([q], [r])[0] for r in foreign].count("other_language") >= 5
    assert model.labels([q], ["The freight contract cut lead times in fiscal 2019, and the tax audit was settled early."]) == [[]] and model.labels([], []) == []


def test_pairs(spark):
    t = lambda s: f"2026-01-05T00:00:{s:02d}Z"
    m = talk(spark, [(1, "a", "user", t(1), "q"), (2, "a", "ai", t(2), None), (3, "a", "ai", t(3), "again"), (4, "b", "user", t(1), " "), (5, "b", "ai", t(2), "r"), (6, "a", "user", t(4), "q2"), (7, "a", "ai", t(5), "x" * 100_000)])
    got = {(r.message_id, r.question) for r in replies.question_reply_pairs(m, spark.createDataFrame([("a",), ("b",)], "id string")).collect()}
    assert got == {(2, "q"), (7, "q2")}


# ---- 4: repeated lines


def test_boilerplate(spark):
    rng = random.Random(4)
    rows, texts = [], {}
    for i in range(120):
        lines = [f"own {chr(97 + i % 26)}{chr(97 + i // 26)} words"] + (["Share this page!", "Legal NOTICE 12"] if i % 5 == 0 else []) + (["…", ""] if i % 3 else [])
        rng.shuffle(lines)
        texts[f"k{i}"] = ("A" if i < 100 else "B", "\n".join(lines))
    rows = [(k, *v) for k, v in texts.items()] + [("k0", *texts["k0"]), ("n", None, "Share this page!"), ("e", "A", None)]
    df = spark.createDataFrame(rows, "id string, src string, body string")
    nodes, places = boilerplate.boilerplate(df, "id", "body", "src", NORM)
    form = lambda x: "".join(c for c in x.lower() if c.isalpha())
    sup, size = collections.Counter(), collections.Counter(s for s, _ in texts.values())
    size["A"] += 1
    for s, t in texts.values():
        sup.update({(s, form(x)) for x in t.split("\n")} - {(s, "")})
    want = {(k, i + 1) for k, (s, t) in texts.items() for i, x in enumerate(t.split("\n")) if form(x) and sup[s, form(x)] >= 8 and sup[s, form(x)] >= 0.04 * size[s]}
    assert {(r.key, r.line_no) for r in places.collect()} == want and want
    assert nodes.count() == 2
    clean = {r.id: r.c for r in boilerplate.without_lines(df, "id", "body", places, "c").collect()}
    assert "Share" not in clean["k0"] and clean["n"] == "Share this page!" and clean["e"] is None
    assert boilerplate.boilerplate(df.where("false"), "id", "body", "src", NORM)[1].count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(1, None), (7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


# ---- 5: near-duplicates


def near_texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    out = {}
    for i in range(150):
        base = [rng.choice(words) for _ in range(60)]
        out[f"a{i:03d}"] = " ".join(base)
        if i % 3 == 0:
            for j in rng.sample(range(60), 3):
                base[j] = rng.choice(words)
            out[f"b{i:03d}"] = " ".join(base).upper() + "!"
    return out | {"c1": out["a000"], "c2": out["a000"], "short": "one two", "empty": "", "uni": "é ü ß " * 9, "uni2": "é ü ß " * 9 + "x"}


def jaccard_pairs(texts, k, threshold):
    sets = {}
    for key, t in texts.items():
        w = re.findall(r"[^\W_]+", NORM(t).lower())
        sets[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates(spark):
    texts = near_texts()
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [("a001", texts["a001"], 2), ("null", None, 1), (None, "x y z", 1)], "id string, body string, h int")
    want = jaccard_pairs(texts, 3, 0.6)
    got = {tuple(r) for r in neardup.similar_pairs(df, "id", "body", 0.6, 3).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 20
    groups = {r.key: (r.group_id, r.links) for r in neardup.similar_groups(df, "id", "body", 0.6, 3).collect()}
    assert groups["c1"][0] == groups["c2"][0] == groups["a000"][0] == "a000" and groups["c1"][1] == groups["a000"][1]
    assert neardup.similar_pairs(df.where("false"), "id", "body").count() == 0
    assert next(iter(neardup._pair_rows(iter([]))), None) is None


def test_pairs_of_a_family_in_a_third_of_the_rows_are_found(spark):
    """Runs that a third of all rows share count as much as any other: pairs just over the threshold are proposed."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    frame = words(92)
    texts = {f"f{i:03}": frame + " " + words(28) for i in range(60)} | {f"o{i:03}": words(60) for i in range(120)}
    want = jaccard_pairs(texts, 3, 0.6)
    assert len(want) == 60 * 59 // 2
    got = {tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(list(texts.items()), "id string, body string"), "id", "body", 0.6, 3).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_exact_links_and_what_sampling_loses(spark):
    texts = near_texts()
    df = spark.createDataFrame([*texts.items(), ("again", texts["a001"]), ("null", None)], "id string, body string")
    links = neardup.exact_links(df, "id", "body", 0.6, 3)
    keys = {shingles.text_hash(shingles.clean(t, NORM)): i for i, t in reversed(texts.items())}
    exact = {tuple(sorted((keys[r.a], keys[r.b]))) for r in links.collect()}
    assert exact == {p for p in jaccard_pairs(texts, 3, 0.6) if set(p) <= set(keys.values())}
    found = {tuple(sorted((keys[r.a], keys[r.b]))) for r in neardup.similar_texts(df, "id", "body", 0.6, 3)[1].collect()}
    assert found <= exact and len(found) >= 0.98 * len(exact)


def test_copies_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES", 7)
    df = spark.createDataFrame([(i, "one two three four five six") for i in range(40)], "id long, body string")
    got = [tuple(r) for r in neardup.similar_pairs(df, "id", "body").collect()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def test_hot_buckets_are_joined_by_blocks(spark):
    sig = np.zeros(neardup.SAMPLES, np.uint8).tobytes()
    got = {tuple(r) for r in neardup.proposed_pairs(spark.createDataFrame([(i, sig) for i in range(450)], "id long, sig binary")).collect()}
    assert got == {(i, j) for i in range(450) for j in range(i + 1, 450)}


def test_large_batches_are_parted(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "ROWS", 7)
    b = pa.RecordBatch.from_pydict({"x": list(range(30))})
    out = list(neardup._rows(iter([b, b.slice(0, 2)])))
    assert max(x.num_rows for x in out) <= 7 and sum((x.column(0).to_pylist() for x in out), []) == [*range(30), 0, 1]


def test_large_buckets_lose_no_pair(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "BUCKET", 3)
    monkeypatch.setattr(neardup, "HELD", 8)
    ids = list(range(100, 120))
    entry = lambda part, buckets, texts: (part, np.array(buckets, np.uint32).tobytes(), np.array(texts, np.uint16).tobytes(), 0)
    rows = [entry(0, [5] * 5 + [6], ids[i : i + 5] + [ids[i]]) for i in range(0, 20, 5)] + [entry(1, [9, 9], [1, 2])]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["part", "bucket", "place", "base"])
    out = [r for b in neardup._pair_rows(iter([batch])) for r in b.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in out if r["a"] is not None}
    blocks = collections.defaultdict(list)
    for r in out:
        if r["members"] is not None:
            blocks[r["bucket"]].append(r["members"])
    for own in blocks.values():
        pairs |= {(min(x, y), max(x, y)) for i, m in enumerate(own) for n in own[i + 1 :] for x in m for y in n if x != y}
    assert pairs >= {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]} | {(1, 2)}


def test_samples_tell_weighted_similarity():
    rng = np.random.default_rng(0)
    docs = []
    for i in range(400):
        common = rng.integers(0, 1 << 48, 60, dtype=np.uint64) if i % 2 == 0 else common
        docs.append(np.unique(np.concatenate([common, rng.integers(0, 1 << 48, 40, dtype=np.uint64)])))
    doc, sh = np.repeat(np.arange(400), [len(d) for d in docs]), np.concatenate(docs)
    w = (1 + (sh % np.uint64(5))).astype(np.float32)
    sig = neardup.weighted_samples(doc, sh, w, 400)
    want = [sum(w[doc == i][np.isin(docs[i], docs[i + 1])]) / (sum(w[doc == i]) + sum(w[doc == i + 1]) - sum(w[doc == i][np.isin(docs[i], docs[i + 1])])) for i in range(0, 400, 2)]
    assert abs(np.mean([(sig[i] == sig[i + 1]).mean() for i in range(0, 400, 2)]) - np.mean(want)) < 0.02


def test_shingles_equal_a_loop():
    texts = ["A b, c d! a b c", "", "one", "Ünï cödé — x²  y", "a b c a b c", "x" * 10_000 + " y z"]
    cleaned = [shingles.clean(t, NORM) for t in texts]
    doc, _, n = shingles.shingle_sets(cleaned, 2)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", NORM(t).lower())
        c = collections.Counter(zip(w, w[1:]))
        assert sorted(n[doc == i]) == sorted(c.values())


# ---- 6: packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12))
def test_plans_cover_and_fit(histogram):
    used, room = collections.Counter(), collections.Counter()
    for length, m, rank, container, times in packing.plan(40, histogram):
        assert rank == used[length]
        used[length] += m * times
        for c in range(container, container + times):
            room[c] += m * length
    assert used == collections.Counter(histogram) and all(v <= 40 for v in room.values())
    assert len(room) <= max(1, 2 * -(-sum(k * v for k, v in histogram.items()) // 40)) or not histogram


def test_fill_is_the_best_subset():
    rng = random.Random(8)
    for _ in range(100):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        target = rng.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums}
        got = packing.fill(target, counts)
        assert sum(k * m for k, m in got.items()) == max(s for s in sums if s <= target) and all(m <= counts[k] for k, m in got.items())


def test_packing(spark):
    rng = random.Random(9)
    sizes = [(i, rng.choice([0, 3, 7, 7, 7, 20, 55, 130])) for i in range(200)] + [(200, None)]
    kinds = spark.createDataFrame([("s", 50), ("l", 200), ("bad", None)], "kind string, cap int")
    items = spark.createDataFrame(sizes, "id long, n long")
    packed = packing.pack(items, "id", "n", kinds, "kind", "cap")
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    fills = collections.Counter()
    for r in packed.collect():
        by[r.kind][r.key].append((r.offset, r.n_tokens))
        fills[r.kind, r.container_id] += r.n_tokens
    for kind, cap in (("s", 50), ("l", 200)):
        assert len(by[kind]) == 201
        for i, n in sizes:
            got = sorted(by[kind][i])
            assert sum(x for _, x in got) == (n or 0) and len(got) == max(1, -(-(n or 0) // cap))
        assert all(v <= cap for (k, _), v in fills.items() if k == kind)
    report = {r.kind: r.fill for r in packing.fill_report(packed, kinds, "kind", "cap").collect()}
    assert report["l"] > 0.9 and max(c for k, c in fills if k == "l") <= sum(v for (k, _), v in fills.items() if k == "l") / 200 + 3
    assert packing.pack(items.where("false"), "id", "n", kinds, "kind", "cap").count() == 0


@needs_data
def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("ü" * 1000,)], "t string")
    assert [r.n_tokens for r in tokens.with_tokens(df, "t").collect()][:3] == [2, 0, 0]


# ---- 7: mixing


def test_mixing(spark):
    rng = random.Random(10)
    docs = [(i, "big" if i < 400 else "mid" if i < 500 else "tiny", rng.randint(5, 20), 1.0) for i in range(520)] + [(900, None, 5, 1.0), (901, "other", 5, 1.0), (902, "big", 0, None)]
    d = spark.createDataFrame(docs, "id long, source string, n long, q double")
    t = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.2, 2), ("tiny", 0.2, 3), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    sel, shares = mixing.mix(d, t, "id", "source", "n", "q", total_share=None)
    rows, rep = sel.collect(), {r.source: r for r in shares.collect()}
    have = collections.Counter()
    for _, s, n, _ in docs:
        have[s] += n
    total = min(have[s] * r / (x / 0.9) for s, x, r in (("big", 0.5, 2), ("mid", 0.2, 2), ("tiny", 0.2, 3)))
    for s, x in (("big", 0.5), ("mid", 0.2), ("tiny", 0.2)):
        assert abs(rep[s].selected_tokens - x / 0.9 * total) <= 10 and abs(rep[s].actual_share - x / 0.9) < 0.01
    assert rep["absent"].selected_tokens == 0 and {r.source for r in rows} == {"big", "mid", "tiny"}
    caps = {"big": 2, "mid": 2, "tiny": 3}
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    for s in caps:  # complete epochs before a part of one
        copies = [r.copies for r in rows if r.source == s]
        whole = min(copies) if len(copies) == len([x for x in docs if x[1] == s and x[2]]) else 0
        assert max(copies) - whole <= 1
    again = mixing.mix(d.repartition(5), t, "id", "source", "n", "q", total_share=None)[0]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))
    assert mixing.mix(d.where("false"), t, "id", "source", "n", "q")[0].count() == 0


def test_budgets_fill_up_from_the_other_sources():
    for seed in range(200):
        g = random.Random(seed)
        src = [(f"s{i}", g.choice([0.0, 0.1, 0.3, 1.5]), g.randint(1, 4), g.choice([0, 3, 40, 1000])) for i in range(g.randint(1, 6))]
        total = g.randint(0, 6000)
        got = dict(mixing.budgets(src, total))
        most = {n: u * h for n, s, u, h in src if s and h}
        assert set(got) == set(most) and all(got[n] <= most[n] for n in got)
        assert abs(sum(got.values()) - min(total, sum(most.values()))) <= len(src)
        level = [got[n] / s for n, s, _, _ in src if n in got and got[n] < most[n]]  # sources that are not used up keep their proportions
        assert not level or max(level) - min(level) <= 11 and all(got[n] / s <= max(level) + 11 for n, s, _, _ in src if n in got)


def test_scarce_sources_are_used_up_and_reported(spark):
    d = spark.createDataFrame([(i, "big" if i < 900 else "tiny", 10, 1.0) for i in range(910)], "id long, source string, n long, q double")
    t = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 3), ("tiny", 0.4, 1), (None, 0.5, 1), ("big", None, 1)], "source string, target_share double, max_repeats int")
    sel, shares = mixing.mix(d, t, "id", "source", "n", "q")
    rep = {r.source: r for r in shares.collect()}
    assert rep["tiny"].selected_tokens == 300 and rep["big"].selected_tokens == 4550 - 300
    assert {r.copies for r in sel.collect() if r.source == "tiny"} == {3}
    with pytest.raises(ValueError):
        many = spark.range(mixing.MOST_TARGETS + 1).select(F.col("id").cast("string").alias("source"), F.lit(0.1).alias("target_share"), F.lit(1).alias("max_repeats"))
        mixing.mix(d, many, "id", "source", "n", "q")


def test_steps_of_keys_are_small_whatever_the_quality(spark):
    e = spark.range(200_000).select(F.floor(F.log(mixing.exponential_key(F.col("id"), F.when(F.col("id") % 2 == 0, 0.25).otherwise(1e-6), 0)) * mixing.KEY_STEPS).alias("b"))
    assert e.groupBy("b").count().agg(F.max("count")).first()[0] < 200


def test_quality_moves_the_sample(spark):
    d = spark.range(4000).select("id", F.lit("s").alias("source"), F.lit(10).alias("n"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("q"))
    d = d.unionByName(spark.range(4000, 4010).select("id", F.lit("t").alias("source"), F.lit(10).alias("n"), F.lit(1.0).alias("q")))
    t = spark.createDataFrame([("s", 0.99, 1), ("t", 0.01, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(d, t, "id", "source", "n", "q", total_share=None)[0].where("source = 's'").collect()
    even = sum(r.key % 2 == 0 for r in got)
    assert 900 <= len(got) <= 1000 and even > 0.7 * len(got)


# ---- 8: subjects


def test_sentences():
    s, *_, doc = subjects.grams(["One two. Three 4.5 four\nfive! six", "", None, "—", "x y. Z"])
    assert [d for d in doc if d != 3] == [0, 0, 0, 4, 4]  # a dash alone may count as a word
    assert len(s) == len(subjects.grams(["One two. Three 4.5 four\nfive! six", "", None, "—", "x y. Z"])[1])


def test_gains_are_differences_of_interpolated_log_probabilities(monkeypatch):
    monkeypatch.setattr(subjects, "AGAINST_CHANCE", 0.0)
    texts = ["the cat sat. the dog sat. the tax rose.", "the tax levy rose. the tax levy fell."]
    s, c, w, p, _ = subjects.grams(texts)
    sub = subjects._table(*subjects._by_label(c[-8:], w[-8:], p[-8:], subjects._firsts(s[-8:]), np.zeros(8, np.int64), 2), 2)
    all_ = subjects._table(*subjects._by_label(c, w, p, subjects._firsts(s), np.zeros(len(s), np.int64), 1), 1)[:, 0]
    u, i = np.unique(p, return_index=True)
    m = subjects.Models(sub, all_, (u, c[i] >> 32, c[i] & 0xFFFFFFFF, w[i]))
    assert all_[:8].sum() == len(s) and not (m.owner == 1).any()  # all words stand under a language; a subject without sentences is tied
    levy = p[len(s) - 6]  # "tax levy": after "tax", which stands twice in the subject and three times in all, twice
    common = subjects.OWN * 2 / 3 + (1 - subjects.OWN) * 2 / len(s)
    own = 2 / 8 + subjects.TRUST * 2 / (2 + subjects.ENOUGH) * (2 / 2 - 2 / 8)
    assert levy == p[len(s) - 2] and m.owner[levy] == 0 and abs(m.value[levy] - np.log(subjects.BACKGROUND + (1 - subjects.BACKGROUND) * own / common)) < 1e-5
    assert np.allclose(m.gains(s, p)[-1], [m.value[p[s == s[-1]]].mean(), 0])


def test_a_sentence_can_gain_from_two_subjects():
    law, sport, both = "The court dismissed the injunction.", "The league signed the striker.", "The court dismissed the injunction and the league signed the striker."
    texts = [law] * 9 + [sport] * 9 + [both] + ["The board met and the revenue of the unit was flat."] * 30
    s, c, w, p, doc = subjects.grams(texts)
    label = np.where(doc[s] < 9, 0, 1)
    mine = doc[s] < 18
    sub = subjects._table(*subjects._by_label(c[mine], w[mine], p[mine], subjects._firsts(s)[mine], label[mine], 2), 2)
    u, i = np.unique(p, return_index=True)
    m = subjects.Models(sub, subjects._table(*subjects._by_label(c, w, p, subjects._firsts(s), np.zeros(len(s), np.int64), 1), 1)[:, 0], (u, c[i] >> 32, c[i] & 0xFFFFFFFF, w[i]))
    g = m.gains(s, p)
    assert g[18].min() > 0.2 and g[0][0] > 0.4 > 0.01 > abs(g[0][1]) and abs(g[19]).max() < 0.01


@needs_data
def test_subjects_held_out(spark):
    e = spark.read.parquet(str(DATA / "sf0.01" / "subject_examples.parquet")).collect()
    fit, held = [r for r in e if r.example_id % 4], [r for r in e if r.example_id % 4 == 0]
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000_000 + r.example_id, r.text) for r in held] + [(20_000_000, None), (20_000_001, ""), (20_000_002, "Gross profit rose by 4% to $3 million.")], "doc_id long, text string"))
    got = collections.defaultdict(set)
    for r in subjects.subjects_of(docs, "doc_id", "text", [(r.subject, r.text) for r in fit]).collect():
        got[r.key].add(r.subject)
    english = [r for r in held if re.search(r"\b(the|of|and)\b", r.text)]  # of other languages the passages left are too few
    assert sum(got[10_000_000 + r.example_id] == {r.subject} for r in english) >= 0.9 * len(english) > 20
    assert not any(got[20_000_000 + i] for i in range(3))
    assert subjects.subjects_of(docs, "doc_id", "text", []).count() == 0


# ---- every query


@needs_data
def test_queries_run(spark):
    from orrery.llm.queries import QUERIES

    for name in ("p1_found", "p1_consistent", "p2_turns", "p3_replies", "p4_cleaned", "p4_blocks", "p5_groups", "p6_fill", "p7_shares", "p8_composition"):
        assert written(QUERIES[name](spark, str(DATA / "sf0.001")), "test").columns, name


@needs_data
def test_conversations_equal_sql(spark):
    import duckdb

    from orrery.llm.queries import ORACLES, QUERIES

    con, folder = duckdb.connect(), DATA / "sf0.01"
    for t in ("messages", "conversations"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = {(r.conversation_id, r.turn, r.message_id) for r in con.sql(ORACLES["p2_found"]).df().itertuples()}
    assert {tuple(r) for r in QUERIES["p2_found"](spark, str(folder)).collect()} == want and len(want) > 1000
