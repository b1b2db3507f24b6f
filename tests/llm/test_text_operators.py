"""Secret scans, mixing, piece codec, quality rules and classifier, WARC and URL filters on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import labelled, mixing, piece_codec, quality_classifier, quality_rules, secret_scan, text_stats, url_filter, warc

ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    listed = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(1 for f in found if f[1] == k) for k in range(3)], hashlib.sha256(listed.encode()).hexdigest()


SECRETS = [
    (None, None), (7, ""), (7, ""), (8, "token = 'a token=abcdef passwd: \U0001F600 secret=token:abcdef'"),
    (9, "x" * 50 + " \U0001F600 client_id: abcd1234 https://host.example.org/ key Ab3" + "dE5f" * 6 + " AKIA" + "Z9" * 9),
    (10, 'API_KEY="AKIA' + "A1" * 9 + '" ' + "deadbeef" * 4), (11, "token=abcdefg " * 3000), (12, "key Ab3" + "dE5f" * 6),
    (13, "\x01token=abcdef\x02 https://host.example.org client_id: abcd1234"), (14, "https://lone.example.org and user: someone1"),
]


def test_base_spans_match_brute_force_and_weak_parts_need_each_other(spark):
    docs = spark.createDataFrame(SECRETS, "doc_id long, text string").withColumn("n_hex", F.lit("extra")).withColumn("__weak", F.lit(1))
    got = secret_scan.scan(docs, "doc_id", "text").collect()
    assert len(got) == len(SECRETS)
    for row in got:
        counts, digest = brute_spans(row.text or "")
        assert ([row.n_assign, row.n_access, row.n_hex], row.base_sha256) == (counts, digest)
    spans = {r.doc_id: r.spans for r in got}
    assert {s.split(":")[0] for s in spans[9].split(",")} == {"weak_id", "endpoint", "weak_secret", "access"}
    assert spans[12] == spans[14] == ""  # a weak part alone is nothing
    assert secret_scan.scan(docs.limit(0), "doc_id").count() == 0


def test_linked_parts_match_a_loop_over_pairs(spark):
    filler = "word " * 50
    texts = [(n, "client_id: abcd1234 " + filler * n + "token=abcdef99 " + filler * (3 - n) + "https://host.example.org") for n in range(4)]
    got = {r.doc_id: r.found for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id").collect()}
    for number, text in texts:
        starts = {"weak_id": 0, "assign": text.index("token"), "endpoint": text.index("https")}
        near = {a: {b for b in starts if a != b and abs(starts[a] - starts[b]) <= secret_scan.SCOPE} for a in starts}
        expected = {"assign"} | ({"weak_id"} if "assign" in near["weak_id"] else set()) | ({"endpoint"} if near["endpoint"] == {"weak_id", "assign"} else set())
        assert {secret_scan.KINDS[s["rank"]] for s in got[number]} == expected, number


def test_redaction_masks_spans_and_leaves_clean_texts(spark):
    docs = spark.createDataFrame([*SECRETS, (20, "clean text"), (21, "a token=abcdef9 b " + "0123456789abcdef" * 2)], "doc_id long, text string").withColumn("n_chars", F.lit(1))
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[20].text == "clean text" and texts[21].text == "a [SECRET] b [SECRET]" and texts[21].n_chars == 21
    assert texts[12].text == SECRETS[7][1] and texts[None].text is None and texts[7].text == ""


def test_poisson_mix_matches_a_loop(spark):
    rows = [(n, f"t{n}", "big" if n % 3 else "small") for n in range(300)] + [(None, None, None), (5, "t5", "big"), (5, "t5", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))
    sizes: dict = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + 1
    weight = {s: math.sqrt(n) for s, n in sizes.items()}
    expected: dict = {}
    for number, text, source in rows:
        rate = weight[source] / sum(weight.values()) * len(rows) / sizes[source] * 20
        parts, count = max(math.ceil(rate / mixing.PART), 1), 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}|{'' if number is None else number}|{hashlib.md5((text or '').encode()).hexdigest()}|{part}".encode()).hexdigest()[:13], 16) / 2 ** 52
            p = total = math.exp(-rate / parts)
            k = 0
            while u >= total and k < mixing.TERMS:
                k += 1
                p *= rate / parts / k
                total += p
            count += k
        expected[number] = expected.get(number, 0) + count
    mixed = mixing.mix(docs, size=20.0)
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in expected.items() if v}
    keys = [r.shuffle_key for r in mixed.collect()]
    assert keys == sorted(keys) and dict(mixed.dtypes)["copy"] == "int"
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.source for r in mixing.mix(docs, {"big": 1.0}).collect()} == {"big"}


def test_rows_without_id_draw_by_their_texts(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(docs)
    counts = [r["count"] for r in mixed.groupBy("text").count().collect()]
    assert abs(sum(counts) - 2000) < 200 and abs((2000 - len(counts)) / 2000 - math.exp(-1)) < 0.05
    assert mixed.select("shuffle_key").distinct().count() == sum(counts)
    assert "hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vocabulary():
    return piece_codec.load()


TEXTS = ["", "a", " a", "  two  spaces ", "line\nbreak\n\n", "▁▁ literal ▁", "ünï \U0001F600 日本", "x" * 3000, " " * 100 + "y", "\t tab"]


def test_pieces_round_trip_and_null(spark, vocabulary):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)] + [(None, None), (1, "a")], "doc_id long, text string").withColumn("token_ids", F.lit("clash"))
    coded = piece_codec.encode(docs, vocabulary, verify=True)
    assert coded.where("NOT round_trip").count() == 0
    back = piece_codec.decode(coded.withColumnRenamed("text", "was"), vocabulary)
    assert back.where("NOT (text <=> was)").count() == 0 and back.count() == len(TEXTS) + 2
    assert [r.n_tokens for r in coded.where("text = ''").collect()] == [0]
    assert piece_codec.encode(docs.limit(0), vocabulary).count() == 0


def test_viterbi_finds_the_best_score(vocabulary):
    encoder = piece_codec.Encoder(vocabulary)
    score = {n: s for _, n, s in vocabulary.pieces}
    pieces = {p: s for p, _, s in vocabulary.pieces}
    for text in ("▁reading", "▁unbelievable,", "▁▁▁x", "▁thntblere", "▁q日€"):
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                own = pieces.get(text[start:end], encoder.unknown if end - start == 1 else -math.inf)
                best[end] = max(best[end], best[start] + own)
        ids = encoder.viterbi(text.replace("▁", " "))
        unknown = sum(encoder.unknown for c in text if c not in pieces)
        assert sum(score.get(i, 0.0) for i in ids) + unknown == pytest.approx(best[-1])


def test_counts_match_plain_python():
    for text in ("", " \n ", "a b c a b c\nline x\nline x\n#$ %", "one", "ü " * 70, "x y z " * 100):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        again = {k + s for k, w in enumerate(windows) if windows.count(w) > 1 for s in range(3)}
        lines = text.split("\n")
        repeated = sum(1 for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:k])
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(again))
        assert text_stats.measure(text.encode())[0] == expected, text


def labelled_tables(spark):
    good = "These ordinary words make up a calm sentence number {n}, with some more of them and of others that differ."
    rows, labels = [], []
    for n in range(200):
        bad = n % 4 == 0
        words = (f"buy ### now $$$ {n} " if bad else good.format(n=n) + f" extra{n} ") * 1
        rows.append((n, words + " ".join(f"{'%%' if bad else ''}w{n}x{k}" for k in range(80))))
        labels.append((n, int(not bad), 0))
    rows += [(None, None), (900, ""), (901, "short"), (902, "again and again " * 4000)]
    labels += [(5, None, 0), (None, 1, 1), (7, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("extra")).withColumn("label", F.lit(3))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_decision_list_rejects_bad_texts_and_base_rule_holds(spark):
    docs, labels = labelled_tables(spark)
    rules = quality_rules.learn_rules(docs, labels)
    assert rules
    rows = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    assert all(rows[n].kept == (n % 4 != 0) for n in range(200) if zlib.crc32(str(n).encode()) % 5 == 0)  # never trained on
    assert rows[None].base_failed and rows[900].base_failed and rows[901].base_failed and rows[902].base_failed and not rows[902].kept
    x = np.array([text_stats.measure((r.text or "").encode())[1] for r in docs.orderBy("doc_id").collect()])
    first = np.full(len(x), -1)
    for n, rule in reversed(list(enumerate(rules))):
        first[quality_rules.covers(rule, x)] = n
    by_id = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    assert [rows[i].rule if rows[i].rule is not None else -1 for i in by_id] == first.tolist()  # the CASE is the list
    assert quality_rules.learn_rules(docs, labels.limit(0)) == [] and quality_rules.judge(docs.limit(0), rules).count() == 0


def test_additive_model_scores_held_out_rows(spark):
    docs, labels = labelled_tables(spark)
    model = quality_classifier.train(docs, labels)
    rows = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[n].predicted == int(n % 4 != 0) for n in range(200) if rows[n].held_out)
    assert {n: rows[n].held_out for n in range(200)} == {n: zlib.crc32(str(n).encode()) % 5 == 0 for n in range(200)}
    # A score is the logistic of table entries, looked up one by one.
    x = np.array([text_stats.measure((r.text or "").encode())[1] for r in docs.collect()])
    for row, expected in zip(x, model.score(x)):
        total, at = model.intercept, [int((edges < v).sum()) for edges, v in zip(model.edges, row)]
        total += sum(t[b] for t, b in zip(model.tables, at))
        total += sum(t[model.coarse[a][at[a]], model.coarse[b][at[b]]] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert 1 / (1 + math.exp(-max(min(total, 30), -30))) == pytest.approx(expected)
    kept = quality_classifier.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows.values())
    blank = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, blank).collect()} == {0.5}
    assert len(labelled.training_sample(docs, labels, "quality", max_rows=10)[1]) <= 10


PAGES = [(1, "http://a", None), (2, None, "x" * 99), (3, "http://b\r\nX: 1", "x" * 99), (4, "u", "y" * 100), (5, "u", "y" * 100), (None, "u", "y" * 100),
         (4, "u", "y" * 100), (6, "v", "ü" * 50), (7, "v", "<p>" + "long " * 200_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("extra"))
    got = sorted([tuple(r)[:5] for r in warc.round_trip(pages).collect()], key=str)
    expected = []
    for number, _, html in PAGES:
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and html[0] == "y" and number != 4
        expected.append((number, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", 4 if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_checks_frames_and_records():
    records = [warc.record(n, "http://a", f"<p>{n} common words in all of them</p>".encode() * 5, "00", 9, None) for n in range(40)]
    archive = warc.pack(records)

    def reader(data, step=37):
        rest = [data]

        def read(n):
            part, rest[0] = rest[0][:min(n, step)], rest[0][min(n, step):]
            return part
        return read

    assert list(warc.frames(reader(archive))) == records and archive[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(archive[4:8], "little") > 0
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.frames(reader(archive[:-3])))
    with pytest.raises(ValueError, match="dictionary frame"):
        list(warc.frames(reader(archive[8:])))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(records[0][:-1])
    with pytest.raises(ValueError, match="without WARC-Date"):
        warc.parse(records[0].replace(b"WARC-Date", b"X-Date"))
    assert list(warc.frames(reader(warc.pack(records[:2])))) == records[:2]


URLS = [(1, "http://x.Example.COM/en/1"), (2, "https://www.example.com/en/"), (3, "http://a.net/es/q?x"), (4, "http://a.net/de/1#z"), (5, None), (6, "no scheme"),
        (7, "http://net/fr/"), (8, "http://notnet/fr/"), (9, "ftp://EXAMPLE.com?x=/en/"), (10, "http://other.com/x://y"), (11, ""), (12, "http://example.com"), (12, "http://example.com")]


def test_url_rules_match_a_loop(spark):
    model = url_filter.train(url_filter.default_labels(spark))
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = url_filter.judge(pages, model).collect()
    assert len(rows) == len(URLS)
    urls = dict(URLS)
    for row in rows:
        url = urls[row.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (row.host, row.path, row.rule) == (host, path, best[0])
        assert row.verdict == (best[1] or ("block" if row.score >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), model).count() == 0


def test_long_urls_take_linear_time(spark):
    model = url_filter.train(url_filter.default_labels(spark))
    urls = ["http://" + "ab." * 150_000 + "example.com/en/" + "x/" * 300_000, "http://a/" + "\U0001F600" * 200_000, "x" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    start = time.time()
    rows = {row.page_id: row for row in url_filter.judge(pages, model).collect()}
    assert time.time() - start < 60
    assert rows[0].rule == "example.com/en/" and rows[0].verdict == "block" and rows[1].path == "/" + "\U0001F600" * 200_000 and rows[2].host == ""


def test_url_grams_match_a_loop(spark):
    rows = spark.createDataFrame([("a.de", "/é\U0001F600x"), ("", ""), ("b", "")], "host string, path string")
    found = rows.select("host", "path", url_filter.grams(F.col("host"), F.col("path")).alias("g")).collect()
    for row in found:
        text = f"^{row.host}${row.path}$"
        want = [text[i:i + n] for n in url_filter.WIDTHS for i in range(max(len(text) - n + 1, 1))]
        hashed = spark.createDataFrame([(w,) for w in want], "w string").select(F.pmod(F.xxhash64("w"), F.lit(url_filter.BUCKETS)).alias("h"))
        assert row.g == [r.h for r in hashed.collect()]


def test_url_model_learns_from_names(spark):
    model = url_filter.train(url_filter.default_labels(spark))
    bad = ("casino-club", "adult-video", "poker-night", "bets-today", "xxx-stories", "loans-fast", "slots-world", "porn-archive")
    good = ("libraries", "weather-map", "universities", "museums", "schools", "recipe-book", "healthcare", "forums")
    held = [(f"http://{name}.example.net/it/9", int(name in bad)) for name in (*bad, *good)]
    host, path = url_filter.parts(F.col("url"))
    rows = spark.createDataFrame(held, "url string, label int").select("label", model.score(host, path).alias("p")).collect()
    assert sum((r.p >= 0.5) == bool(r.label) for r in rows) >= 0.8 * len(rows), rows
    constant = url_filter.train(spark.createDataFrame([("a", None)], "url string, label int"))
    assert constant.weights == (0.0,) * url_filter.BUCKETS and constant.intercept == 0
