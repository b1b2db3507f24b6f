"""Decontamination, source divergence and spelling variants against brute force, with nulls, empties, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditloom.llm import divergence, spelling, winnowing


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_hits(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        width = min(len(own), 10)
        for i in range(len(own) - width + 1 if own else 0):
            windows[tuple(own[i:i + width])].add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for width in {len(w) for w in windows}:
            for i in range(len(own) - width + 1):
                names = windows.get(tuple(own[i:i + width]))
                if names:
                    hit.update(range(i, i + width))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "Gamma", "ÉTÉ", "été", "7", "naïve", "x"]

    def words(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", " -"]) for _ in range(n))

    items = [(n, words(rng.choice([3, 4, 9, 10, 11, 14, 40]))) for n in range(12)]
    items += [(30, items[6][1]), (None, words(12)), (31, None), (32, "..."), (33, ""), (6, words(15)), (34, "solo"), (35, "a " * 25)]
    rows = [(n, words(rng.randint(0, 30)) + " " + items[n % 12][1].upper()[:rng.randint(20, 200)] + " " + words(rng.randint(0, 30))) for n in range(60)]
    rows += [(70, items[5][1]), (71, None), (72, ""), (None, items[5][1]), (70, items[5][1]), (73, items[12 - 1][1] + " " + items[5][1]),
             (74, "a " * 30_000), (75, "one SOLO voice"), (76, (items[8][1] + " ") * 800), (77, "É" + items[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("extra")).withColumn("words", F.lit(1)).withColumn("item", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("extra"))
    expected = brute_hits(rows, items)
    assert sum(r[5] for r in expected) > 20 and not all(r[5] for r in expected)
    assert sorted([tuple(r) for r in winnowing.decontaminate(docs, bench).collect()], key=str) == expected
    assert winnowing.decontaminate(docs.limit(0), bench).count() == 0
    clean = winnowing.decontaminate(docs, bench.limit(0))
    assert sorted([tuple(r) for r in clean.collect()], key=str) == brute_hits(rows, [])


def test_fingerprints_hold_the_smallest_gram_of_each_window(spark):
    rng = random.Random(8)
    texts = spark.createDataFrame([(n, [rng.choice("abc") for _ in range(size)]) for n, size in enumerate([0, 4, 5, 9, 10, 60])], "id long, words array<string>")
    got = {r.id: {(p.pos, p.gram) for p in r.prints} for r in winnowing.fingerprints(texts, [], "id").collect()}
    hashed = texts.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).select("id", winnowing._grams(5).alias("g"))
    for row in hashed.collect():
        expected = set()
        for i in range(len(row.g) - 5):
            low = min(row.g[i:i + 6])
            expected |= {(k + 1, low) for k in range(i, i + 6) if row.g[k] == low}
        assert got[row.id] == expected


def brute_audit(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, w in own for t in set(w))
        kept = {t for t, n in seen.items() if n >= 3}
        total = Counter(t for _, _, w in own for t in w if t in kept)
        by = {s: Counter(t for _, o, w in own if o == s for t in w if t in kept) for s in {d[1] for d in own}}

        def level(counts, term):
            return 1 + 10 ** 9 * (counts[term] + 1) // (sum(counts.values()) + len(kept))

        def gap(p, q):
            return (p - q) ** 2 // q

        for a, counts in by.items():
            pairs = [(sum(gap(level(counts, t), level(other, t)) for t in kept), b) for b, other in by.items() if b != a]
            terms = [(gap(level(counts, t), level(total, t)), t) for t in kept if counts[t] and level(counts, t) > level(total, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, a, part, item, value, n + 1) for n, (value, item) in enumerate(ranked) if part == "pair" or n < divergence.TOP]
    return sorted(out)


def audit_rows():
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "abé" for b in "xyzß" for c in ("", "o", "Ü", "ee")] + ["don't", "x2y"]
    rows = []
    for n in range(120):
        lang, source = rng.choice(["en", "de", "en"]), rng.choice(["web", "web", "web", "news", "code"])
        share = vocabulary[:20] if source == "news" else vocabulary
        rows.append((" ".join(rng.choice(share) for _ in range(rng.randint(0, 40))).upper() if n % 7 == 0 else " ".join(rng.choices(share, k=30)), lang, source))
    return rows + [(None, "en", "empty"), ("", None, None), ("lonely words", "fr", "a"), ("other words", "fr", "b"), ("axo axo", "en", None), ("z" * 3000 + " axo", "en", "web"),
                   rows[3], rows[3]]


@pytest.mark.parametrize("bits", [64, 4])
def test_divergence_matches_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "TOP", 7)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("extra")).withColumn("digest", F.lit(1)).withColumn("n", F.lit(5))
    got = sorted(tuple(r) for r in divergence.audit(docs, bits).collect())  # with 4 bits most digests stand for several terms
    assert got == brute_audit(rows)
    assert divergence.audit(docs.limit(0), bits).count() == 0


def brute_variants(rows):
    words: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in words.items() if n >= 5 and len(w) >= 6}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) > len(b):
            a, b = b, a
        k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]

    others = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(others[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_variants_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 30)
    rng = random.Random(9)
    bases = ["garden", "gardens", "éclairé", "aaaaaaa", "abababab", "colours", "naïvement", "straße", "x×÷xx÷", "aaaaaaaaaaaaaaaaaaaa"]
    forms = Counter()
    for base in bases:
        forms[base] = rng.choice([5, 30, 200, 1000])
        for _ in range(14):
            at, edit = rng.randrange(len(base)), rng.choice(["cut", "add", "swap"])
            letter = rng.choice("abcéÿ")
            forms[base[:at] + {"cut": "", "add": letter + base[at], "swap": letter}[edit] + base[at + 1:]] += rng.choice([1, 4, 5, 6, 30])
    forms.update({"chained": 1000, "chainedo": 60, "chainedoo": 8})
    stream = [w if rng.random() < 0.8 else w.upper().replace("É", "é").replace("SS", "ß") for w, n in forms.items() for _ in range(n)]
    rng.shuffle(stream)
    rows = [(n, " ".join(stream[n::50])) for n in range(50)] + [(None, "garden gardens, Garden"), (60, None), (61, ""), (3, " ".join(stream[3::50])), (62, "q" * 5000), (63, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("extra")).withColumn("n", F.lit(1))
    expected = brute_variants(rows)
    assert sum(r[1] is not None for r in expected) > 10 and any(r[1] and r[1] != r[2] for r in expected)
    assert sorted(tuple(r) for r in spelling.variants(docs).collect()) == expected
    assert spelling.variants(docs.limit(0)).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        grams = [(p, n, rng.randint(1, 9)) for n, p in enumerate(places)]
        cheapest = min(a[2] + b[2] for a in grams for b in grams if b[0] - a[0] >= 2)
        first, second = spelling.pivots(grams)
        assert second[0] - first[0] >= 2 and first[2] + second[2] == cheapest


def test_a_run_loses_the_character_its_hash_names():
    got = Counter()
    for n in range(400):
        got += spelling.read_words(n, b"Elephants")
    lost = [n for n in range(400) if zlib.crc32(f"{n}:elephants".encode()) % 199 == 0]
    assert lost and got["elephants"] == 400 - len(lost) and sum(got.values()) == 400
