"""Near-duplicate operators and repeat removal against brute force, with nulls, empties, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import common, embedding_dedup, ngram_join, suffix_dedup


def groups(ids, pairs):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    members: dict[int, list] = {}
    for n in range(len(ids)):
        members.setdefault(find(n), []).append(ids[n])
    return [min([i for i in members[find(n)] if i is not None], default=None) for n in range(len(ids))]


def test_components_of_chains_stars_and_islands(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (201, 200), (201, 200)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(41)} | {n: 100 for n in range(100, 140)} | {200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if fine(rows[i][1]) and fine(rows[j][1]) and len(rows[i][1]) == len(rows[j][1])
             and np.dot(rows[i][1], rows[j][1]) >= 0.9 * np.sqrt(np.dot(rows[i][1], rows[i][1]) * np.dot(rows[j][1], rows[j][1]))]
    degree = Counter(n for pair in pairs for n in pair)
    ids = [r[0] for r in rows]
    return sorted([(i, degree[n], c, i == c) for n, (i, c) in enumerate(zip(ids, groups(ids, pairs)))], key=str)


@pytest.mark.parametrize("block", [256, 3])
def test_embeddings_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # small blocks split buckets
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(6):
        base = rng.normal(size=8)
        rows += [(len(rows) + k - 20, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.35]) for k in range(6)]
    rows += [(500, rows[3][1]), (500, rows[3][1]), (None, rows[3][1]), (None, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8),
             (504, [None] + [1.0] * 7), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [float("inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("digest", F.lit("extra")).withColumn("n", F.lit(9))
    got = sorted([tuple(r) for r in embedding_dedup.near_duplicates(table).collect()], key=str)
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def brute_shingles(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k:k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))})
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
    degree, ids = Counter(n for pair in pairs for n in pair), [r[0] for r in rows]
    return sorted([(i, len(sets[n]), degree[n], c) for n, (i, c) in enumerate(zip(ids, groups(ids, pairs)))], key=str)


def near_texts():
    rng = random.Random(3)
    words = [f"w{n}" for n in range(60)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 200]))]
        for k in range(5):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), ("\n" if k % 2 else " ").join(own).upper() if k == 3 else " ".join(own)))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(len(rows) + k, passage + " " + " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 5, 12, 15, 20, 100] * 5)]
    return rows + [(900, None), (901, ""), (902, " \t\n"), (None, rows[3][1]), (3, rows[3][1]), (903, "a b"), (904, "A  b"), (None, "zz yy"),
                   (905, "long " * 20_000)]


@pytest.mark.parametrize("block", [64, 2])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("extra")).withColumn("cls", F.lit(1))
    got = sorted([(r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in ngram_join.links(docs).collect()], key=str)
    assert got == brute_shingles(rows)
    assert ngram_join.links(docs.limit(0)).count() == 0


def test_words_that_cancel_in_sums_of_powers_do_not_link(spark):
    rows = []
    for size in (1024, 2048):
        word = "".join("ab"[bin(n).count("1") % 2] for n in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        rows += [(len(rows), word), (len(rows) + 1, other), (len(rows) + 2, " ".join([word] * 4 + [other])), (len(rows) + 3, " ".join([other] * 4 + [word]))]
        rows += [(len(rows), " ".join(word)), (len(rows) + 1, " ".join(other))]
    got = ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_shingles(rows)
    assert sorted([(r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got], key=str) == expected
    assert {r.doc_id for r in got if r.n_links == 0} >= {0, 1, 2, 3, 6, 7, 8, 9}


def test_one_document_of_each_group_stays(spark):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("x"))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = brute_shingles(rows)
    empty = sum(1 for r in expected if r[1] == 0)
    assert kept.count() == len({r[3] for r in expected if r[1]}) + empty
    assert {r.doc_id for r in kept.collect()} >= {900, 901, 902, 903, 905}


def brute_repeats(rows, length=400):
    texts = [(text or "").encode() for _, text in rows]
    count = Counter(b[p:p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for (number, _), b in zip(rows, texts):
        covered = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                covered[p:p + length] = True
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = int((covered[1:] & ~covered[:-1]).sum() + covered[0])
        out.append((number, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [2048, 3])
def test_repeats_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # a small bound halves the names
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgü") for _ in range(rng.randint(1, 8))) for _ in range(n))

    passage, other, short = words(70), words(200), words(200)[:390]
    rows = [(k, words(rng.randint(0, 60)) + passage[rng.randint(0, 30):len(passage) - rng.randint(0, 60)] + words(rng.randint(0, 60))
             + (other[rng.randint(0, 300):] if k % 3 == 0 else "")) for k in range(40)]
    rows += [(100, other), (101, other), (102, None), (103, ""), (104, "a" * 399), (105, "b" * 400), (106, "b" * 401), (107, "xyz" * 300),
             (None, other), (100, other), (108, short + words(30)), (109, words(20) + short), (110, (words(50) + "\n") * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("extra"))
    got = sorted([tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs).collect()], key=str)
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_samples_of_a_text_longer_than_a_segment(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd ") for _ in range(5000))
    whole = suffix_dedup.samples(text)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    cut = suffix_dedup.samples(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_the_order_of_shingles_reaches_the_driver_as_arrow_columns(spark, monkeypatch):
    """2**LENGTH_BITS rows as Python objects took 280 MB of the driver; the table is the same."""
    from auditloom.llm import ngram_join

    texts = [" ".join(f"w{n}" for n in range(start, start + 300)) for start in (0, 0, 100, 250)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {}
    for text in texts:
        for token in ngram_join.shingles((text or "").encode()).tolist():
            if token < ngram_join._LIMIT:
                counts[token] = counts.get(token, 0) + 1
    want = np.zeros(1 << ngram_join.LENGTH_BITS, np.uint8)
    for token, count in counts.items():
        if count > 1:
            slot = token >> (64 - ngram_join.LENGTH_BITS)
            want[slot] = max(want[slot], int(np.log2(count)))
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("rows on the driver"))
    assert want.any() and (ngram_join.order(docs).logs == want).all()
    assert not ngram_join.order(docs.limit(0)).logs.any()


def test_names_that_stand_once_are_seldom_taken_for_repeated_ones(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAP_BITS", 16)
    rng = random.Random(3)
    one, other = (suffix_dedup.samples(rng.randbytes(120_000))[1] for _ in range(2))
    bits = np.zeros(1 << 13, np.uint8)
    np.bitwise_or.at(bits, suffix_dedup._slot(one) >> 3, (1 << (suffix_dedup._slot(one) & 7)).astype(np.uint8))
    assert len(one) > 1000 and len(suffix_dedup._marked(bits, one)) == len(one)
    assert len(suffix_dedup._marked(bits, other)) < 0.05 * len(other)


def test_only_texts_that_lose_bytes_are_sent_on(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    clean = ["".join(rng.choice("ijklmnop ") for _ in range(900)) for _ in range(20)]
    docs = spark.createDataFrame([(k, chr(65 + k) + passage + str(k)) for k in range(5)] + [(100 + k, text) for k, text in enumerate(clean)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert all(got[k].n_removed == 700 and got[k].n_spans == 1 for k in range(5))  # planted passages are all caught
    assert all(got[100 + k].n_removed == 0 and got[100 + k].kept_sha256 == hashlib.sha256(text.encode()).hexdigest() for k, text in enumerate(clean))
    rows = docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS row")
    lost = suffix_dedup.bit_map(rows.where("doc_id < 5").selectExpr("row AS value"))
    sent = rows.mapInArrow(suffix_dedup._settled(spark.sparkContext.broadcast(lost)), "doc_id long, row long, text string, n_bytes long, kept_sha256 string")
    assert {r.doc_id for r in sent.where("text IS NOT NULL").collect()} == set(range(5))


def test_components_go_on_with_the_edges_that_are_left(spark, monkeypatch):
    whole, seen = common.cut, []
    monkeypatch.setattr(common, "cut", lambda df: seen.append(whole(df)) or seen[-1])
    edges = [(a + 10 * k, b + 10 * k) for k in range(6) for a in range(10) for b in range(a)] + [(9 + 10 * k, 18 + 10 * k) for k in range(5)]
    assert {r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}
    left = [df.count() for df in seen if df.columns == ["x", "y"]]
    assert left[0] == len(edges) and left[1] < 10 and left[-1] == 0


def test_the_join_runs_few_tasks_however_many_partitions_there_are(spark):
    """The driver keeps a record of every task, so tables between the steps are not read in a task for each partition."""
    docs, context = spark.createDataFrame(near_texts(), "doc_id long, text string"), spark.sparkContext
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        context.setJobGroup("few-tasks", "")
        ngram_join.links(docs).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    tracker = context.statusTracker()
    stages = {stage for job in tracker.getJobIdsForGroup("few-tasks") for stage in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert 0 < tasks < 1600  # 1,078; 2,520 when each table was a checkpoint


def test_the_map_of_repeated_shingles_grows_with_their_number(spark, monkeypatch):
    """A full map took shingles that stand once for repeated ones; common shingles then joined most texts in one group."""
    monkeypatch.setattr(ngram_join, "MAP_BITS", 15)
    copied = " ".join(f"w{n}" for n in range(30_000))
    once = ngram_join.shingles(" ".join(f"x{n}" for n in range(30_000)).encode())
    found = ngram_join.order(spark.createDataFrame([(1, copied), (2, copied)], "doc_id long, text string"))
    repeated = ngram_join.shingles(copied.encode())
    assert (found.log(repeated)[repeated < ngram_join._LIMIT] > 0).all()
    assert (found.log(once)[once < ngram_join._LIMIT] > 0).mean() < 0.1


def test_texts_whose_sizes_cannot_link_form_no_group(spark, monkeypatch):
    """Texts that share but a passage made groups that grew faster than the table, and each set goes to all blocks of its group."""
    passage = [f"p{n}" for n in range(40)]
    texts = [" ".join(passage + [f"a{size}x{n}" for n in range(size)]) for size in (10, 30, 60)]
    seen, whole = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    rows = ngram_join.links(spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "doc_id long, text string")).collect()
    assert seen == [0, 0] and all(r.n_links == 0 and r.component_id == r.doc_id for r in rows)


def test_sets_that_link_just_so_share_a_list():
    rng, tried = np.random.default_rng(1), 0
    for n in range(4000):
        one = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 60 if n % 2 else 600)), dtype=np.uint64))
        both = rng.permutation(one)[:len(one) - int(rng.integers(0, len(one) // 4 + 1))]
        other = np.unique(np.append(both, rng.integers(0, 1 << 64, max(len(both) * 100 // 80 - len(one), 0), dtype=np.uint64)))
        if 100 * len(both) < 80 * len(np.union1d(one, other)):
            continue
        tried += 1
        lists = []
        for found in (one, other):
            known = np.where(np.isin(found, both), 1 + (found % np.uint64(3)).astype(np.int64), (found % np.uint64(7) < 2).astype(np.int64))
            lists.append(ngram_join.keys(found, np.where(found < ngram_join._LIMIT, known, 64))[0])
        assert len(np.intersect1d(*lists))
    assert tried > 2000
