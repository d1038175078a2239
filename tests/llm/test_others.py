"""The scoring operators, WARC and mixing: brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import math
import re
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from fixtures import by_id, prose
from pyspark.sql import functions as F

from quantloom.llm import url_table
from quantloom.llm.language import dictionaries, identify, language_id
from quantloom.llm.license_rules import SIGNATURES
from quantloom.llm.license_scan import GATE, Rules, license_scan, suppressed, word_starts
from quantloom.llm.mixing import mix_sources, token_count
from quantloom.llm.quality import buckets, quality
from quantloom.llm.quality import train as train_quality
from quantloom.llm.sampling import labelled_texts
from quantloom.llm.toxicity import _NORMS, DECAY, GAPS, ToxicModel, letter_codes, marked, score_toxicity, toxicity, unit_ranges, within
from quantloom.llm.toxicity import train as train_toxicity
from quantloom.llm.url_filter import filter_urls, gram_buckets, host_of, path_of
from quantloom.llm.url_filter import train as train_urls
from quantloom.llm.warc import archive_round_trip, open_path, ranges, read_archives, sweep, write_archives
from quantloom.llm.words import slices
from quantloom.runtime import table
from quantloom.scratch import Scratch

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def base_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def base_quality(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def check_bases(docs):
    got, rated = by_id(license_scan(docs)), by_id(quality(docs, None))
    for r in docs.select("doc_id", "text").collect():
        g, q = got[r.doc_id], rated[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base_license(r.text)
        assert set(g.base_labels.split(",")) - {""} <= set(g.labels.split(",")) and 0 <= g.score <= 1
        want = base_quality(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and q.kept == (not q.base_failed)


def test_bases(spark, edge, sf):
    check_bases(edge)
    check_bases(table(spark, sf, "documents"))


def test_license_labels_and_suppression(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "nothing of the kind", "GNU Lesser General Public License v2.1"]
    got = by_id(license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got[0].labels == "apache,apache-2.0" and got[1].labels == "gpl-3.0-or-later" and got[2].labels == "" and got[2].score == 0
    assert "lgpl-2.1" in got[3].labels and "gpl" in got[3].base_labels
    assert suppressed(np.array([(0, 5, 9, 0), (1, 3, 5, 1), (4, 7, 5, 2)])).tolist() == [[0, 5, 9, 0], [4, 7, 5, 2]]


def test_license_suppression_by_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(200):
        first = r.integers(0, 12, 30)
        found = np.stack([first, first + r.integers(1, 8, 30), r.choice([50, 60, 90], 30), r.integers(0, 9, 30)], 1)
        rows = {tuple(map(int, d)) for d in found}
        rank = lambda d: (-d[2], d[0] - d[1], d[3], d[0])
        want = sorted(d for d in rows if not any(rank(o) < rank(d) and o[0] <= d[0] and d[1] <= o[1] for o in rows))
        assert sorted(map(tuple, suppressed(found).tolist())) == want


def spelled(tree):
    """Texts of a parsed pattern: every branch and class member, optional parts without and with."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "IN":
            parts = [chr(c if str(k) == "LITERAL" else c[0] if str(k) == "RANGE" else ord("7")) for k, c in arg]
        elif name == "ANY":
            parts = ["x"]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            parts = [p for n in {arg[0], min(arg[1], arg[0] + 1)} for p in ("".join(c) for c in itertools.product(spelled(arg[2]), repeat=n))]
        elif name == "SUBPATTERN":
            parts = spelled(arg[3])
        elif name == "BRANCH":
            parts = [p for b in arg[1] for p in spelled(b)]
        else:
            assert name in ("AT", "ASSERT_NOT")
            parts = [""]
        out = [a + b for a in out for b in parts]
    return out


def test_license_prefilter_loses_no_rule():
    for label, _, keyword, patterns in SIGNATURES:
        for pattern in patterns:
            for text in spelled(re._parser.parse(pattern)):
                assert re.search(pattern, text), (label, text)
                assert keyword in text and any(g.decode() in text for g in GATE), (label, keyword, text)


def test_license_without_other_stems(spark):
    cases = {"CC\nBY 4.0": "cc-by-4.0", "CC_BY_4.0": "cc-by-4.0", "MIT\nNo Attribution": "mit-0", "MS_PL": "ms-pl", "Proprietary and confidential": "proprietary", "unauthorized copying of this file": "proprietary", "Responsible AI License": "bigscience-rail-1.0", "the PSF license": "psf-2.0", "X Consortium License": "x11", "mulan PSL v2": "mulan-2.0"}
    got = by_id(license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")))
    assert [got[i].labels for i in range(len(cases))] == list(cases.values())


def brute_license(text):
    """Labels and score by every pattern of every rule, without gate or keywords, and suppression by comparing all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = " ".join(words)
    order = sorted(range(len(SIGNATURES)), key=lambda i: (-SIGNATURES[i][1], i))
    found = set()
    for n, i in enumerate(order):
        label, priority, _, patterns = SIGNATURES[i]
        for pattern in patterns:
            for m in re.finditer(pattern, joined):
                found.add((joined.count(" ", 0, m.start()), joined.count(" ", 0, max(m.end() - 1, m.start())) + 1, priority, n, label))
    rank = lambda d: (-d[2], d[0] - d[1], d[3], d[0])
    kept = [d for d in found if not any(rank(o) < rank(d) and o[0] <= d[0] and d[1] <= o[1] for o in found)]
    base = base_license(text)[4]
    labels = {d[4] for d in kept} | set(base.split(",")) - {""}
    return ",".join(sorted(labels)), min(1.0, max([d[2] for d in kept] + [60] * bool(base), default=0) / 90)


def test_license_labels_by_brute_force(spark, edge, sf):
    own = ["Redistribution and use in source and binary forms, with or without modification, are permitted", "neither the name of " + "Long Holder " * 40 + "nor the names of its contributors may be used to endorse or promote products"]
    own += [" ".join(spelled(re._parser.parse(p))[0] for p in r[3]) for r in SIGNATURES] + [f"{a[3][0]} {b[3][-1]}".replace("\\b", "") for a, b in zip(SIGNATURES, SIGNATURES[7:])]
    docs = edge.select("doc_id", "text").unionByName(table(spark, sf, "documents").selectExpr("doc_id + 100000 AS doc_id", "text")).unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    got = by_id(license_scan(docs))
    for r in docs.collect():
        assert (got[r.doc_id].labels, got[r.doc_id].score) == brute_license(r.text), r.text
    assert "bsd-3-clause" in got[10**6 + 1].labels
    assert license_scan(docs.where("false")).collect() == []


def test_license_of_a_text_full_of_detections(spark):
    """One text of a million words; in the kernel, memory beyond the text is a few numbers a detection."""
    text = "MIT License " * 400_000
    (r,) = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("detections").collect()
    assert r.n_base == 400_000 and r.first_word == 0 and r.last_word == 799_998 and r.labels == "mit"
    words, rules = text.lower().strip()[:1_200_000].strip(), Rules()
    tracemalloc.start()
    found = rules.detections(words, word_starts(words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) >= 100_000 and peak < 260 * len(found)


def folds(docs, by, remainder):
    return {r.doc_id: crc32(str(r.doc_id).encode()) % by == remainder for r in docs.select("doc_id").collect()}


def test_bounds_split_ties():
    assert within({5.0: 2000}, 1500) == (math.inf, 5.0, 0.75)
    assert within({9: 10, 5: 20, 2: 80}, 50) == (5, 2, 0.25) and within({9: 10}, 10) == (9, None, 0.0) and within({}, 5) == (math.inf, None, 0.0)


def test_toxicity_of_many_tied_insults(spark):
    """As many equally toxic words as the bound on landmarks has no room for; none is more enriched than the others."""
    insults = [f"zog{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    rows = [(i, f"{prose(i, 3)} {' '.join(insults[(7 * i + k) % 2000] for k in range(8))}." if i % 3 == 0 else prose(i, 11) + ".", int(i % 3 == 0)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert np.abs(model.weights).max() > 0
    got = by_id(toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")))
    held = [(t, got[i].predicted) for i, _, t in rows if got[i].held_out]
    assert sum(p for t, p in held if t) >= 0.9 * sum(t for t, _ in held)


def test_toxicity(spark, edge):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got, held = by_id(toxicity(docs, labels)), folds(docs, 4, 2)
    assert all(r.held_out == held[i] and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    known = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if held.get(r.doc_id)]
    toxic = [p for t, p in known if t]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(t == p for t, p in known) >= 0.95 * len(known)
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = by_id(toxicity(docs, labels))
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {i: r.score for i, r in by_id(toxicity(docs, flipped)).items()} == {i: r.score for i, r in got.items()}
    assert all(r.score == 0 for r in toxicity(edge, labels.where("false")).collect())
    model = train_toxicity(docs, labels)
    scored = score_toxicity(edge.unionByName(edge), model, as_col="p").collect()
    assert len(scored) == 2 * edge.count() and all(0 <= r.p <= 1 for r in scored) and len({(r.doc_id, r.p) for r in scored}) == edge.count()
    assert len({r.p for r in scored if r.text in (None, "", " \t\n ")}) == 1
    assert toxicity(docs.where("false"), labels).collect() == []


@pytest.mark.parametrize("insult", ["vile toad", "zog", "rotten old turnip", "ba st ard", "sc um"])
def test_toxicity_beyond_single_words(spark, insult):
    """Insults of ordinary words, of three letters, or cut by spaces; apart, the words are in clean documents too."""
    words, rows = ["apart" if w == insult else w for w in insult.split(" ")], []
    for i in range(900):
        body = prose(i, 40).split(" ")
        if i % 6 == 0:
            body[20:20] = insult.split(" ")
        else:
            for k, w in enumerate(words):
                body.insert(3 + 9 * k + i % 3, w)
        rows.append((i, " ".join(body) + ".", int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = by_id(toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")))
    held = [(t, got[i].predicted) for i, _, t in rows if got[i].held_out]
    assert sum(p for t, p in held if t) >= 0.9 * sum(t for t, _ in held) and sum(p for t, p in held if not t) <= 0.05 * len(held)


def test_toxicity_units_and_scores():
    text = "You vile toad. i d i o t zog! ba st ard\nincomprehensibilities at it"
    (w,) = slices(pa.array([None, text, "ab. cd"]))
    letters, first, last, of, run, sentence = unit_ranges(w)
    named = [("".join(chr(96 + c) for c in letters[a:b]), bool(r)) for a, b, t, r in zip(first, last, of, run) if t == 1]
    assert {("vile", False), ("zog", False), ("idiot", False), ("viletoad", True), ("youviletoad", True), ("bastard", True), ("idiotzog", True)} <= set(named)
    assert not {"toadidiot", "zogba", "ardat"} & {u for u, _ in named} and all(2 <= len(u) <= 24 for u, _ in named)
    assert [letters[a:b].tobytes() for a, b, t in zip(first, last, of) if t == 2] == [b"\1\2", b"\3\4"]
    assert all(set(of[sentence == k]) == {of[sentence == k][0]} for k in set(sentence)) and (np.diff(sentence) >= 0).all() and len(set(sentence[of == 1])) == 4
    a, b = (letter_codes(np.frombuffer(t.encode(), np.uint8)) for t in ("при", "рст"))
    assert a[a > 0].tolist() != b[b > 0].tolist() and (a[a > 0] >= 27).all()
    model = ToxicModel(np.random.default_rng(0).normal(size=1 << 20).astype(np.float32), -0.25, np.zeros(9))
    units = [marked(letters[a:b].tobytes()) for a, b in zip(first, last)]
    want = [sum(model.weights[u[i] << 15 | u[i + a] << 10 | u[i + b] << 5 | u[i + c]] * DECAY ** (c + 1) for i in range(len(u)) for a, b, c in GAPS if i + c < len(u)) / _NORMS[len(u)] - 0.25 for u in units]
    assert np.allclose(model.unit_scores(letters, first, last), want, atol=1e-5)


def test_language(spark, edge):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got, held = by_id(language_id(docs)), folds(docs, 3, 1)
    rows = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if held[r.doc_id] and r.lang is not None and got[r.doc_id].lang_pred != "und"]
    assert sum(a == b for a, b in rows) >= 0.95 * len(rows)
    for r in edge.join(language_id(edge).drop("score"), "doc_id").collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in identify(edge, {}).collect()} == {"und"}
    assert language_id(edge.where("false")).collect() == []


def test_language_of_long_texts_and_ties(spark):
    """A language that has only long texts is learned; equal compressions go to the language with more documents."""
    other = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    rows = [(i, prose(i, 60), "short") for i in range(60)] + [(100 + i, " ".join(other[(i * 7 + k * k) % 12] for k in range(3000)), "long") for i in range(12)]
    rows += [(200, None, "short"), (201, "12 34", "digits"), (202, prose(1, 60), None), (203, prose(2, 60), None), (203, "lorem ipsum dolor sit amet", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in language_id(docs).collect()}
    assert all((i, lang) in got for i, t, lang in rows[:72]) and {(200, "und"), (201, "und"), (202, "short"), (203, "short"), (203, "long")} <= got
    content = dictionaries(spark.createDataFrame([(i, prose(i, 9000), "x") for i in range(40)], "doc_id long, text string, lang string"), dict_bytes=5000, slots=8)
    assert 5000 <= len(content["x"]) <= 10_001
    twins = spark.createDataFrame([(i, prose(7, 40), "ab"[i % 3 == 0]) for i in range(30)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id(twins).collect()} == {"a"}


def test_trained_quality_on_edge_texts(spark, edge):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = train_quality(docs, labels)
    got = by_id(quality(edge, model))
    assert len(got) == edge.count() and all(0 <= r.probability <= 1 for r in got.values())
    twice = quality(edge.unionByName(edge), model).groupBy("doc_id", "probability").count().collect()
    assert len(twice) == len(got) and {r["count"] for r in twice} == {2}


def test_quality_of_a_text_does_not_depend_on_its_neighbours(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = train_quality(docs, labels)
    texts = [r.text for r in docs.select("text").collect()] + [prose(i, 200 + i) for i in range(100)]
    (w,) = slices(pa.array(texts))
    together = model.probability(w, w.hashes())
    for i, text in enumerate(texts):
        (one,) = slices(pa.array([text]))
        assert model.probability(one, one.hashes())[0] == together[i]


def test_character_trigrams_are_code_points():
    for text in ("", "ab", "né你", "a\U0001f600b c", "привет мир"):
        (w,) = slices(pa.array([text, "xyz"]))
        _, grams, first, last = buckets(w, w.hashes())
        assert [last[i] - first[i] for i in (0, 1)] == [max(0, len(text) - 2), 1] and last[0] <= first[1]
    (a,), (b,) = slices(pa.array(["你好吗"])), slices(pa.array(["xx你好吗"]))
    assert buckets(a, a.hashes())[1][0] == buckets(b, b.hashes())[1][2]


def test_samples_are_bounded_and_stable(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 5 = 0 AS INT) AS y").unionByName(spark.range(3000).selectExpr("7L AS doc_id", "0 AS y"))
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id) AS text").unionByName(spark.range(3000).selectExpr("7L AS doc_id", "concat('u', id) AS text"))
    sample = lambda d: labelled_texts(d, labels, "y", {0: 700, 1: 2000}, "x", "doc_id", "text")
    got, counts = sample(docs)
    rows = got.collect()
    n = Counter(r.y for r in rows)
    assert counts == {0: 4000, 1: 1000} and 500 <= n[0] <= 700 and n[1] == 1000 and {r.fold for r in rows} == {0, 1, 2}
    assert sorted(rows) == sorted(sample(docs.repartition(9))[0].collect()) and sample(docs.where("false"))[0].collect() == []


def test_quality_model(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    held = folds(docs, 4, 0)
    model = train_quality(docs, labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 0"))
    got = by_id(quality(docs, model))
    rows = [(r.quality, got[r.doc_id].kept) for r in labels.collect() if held.get(r.doc_id)]
    assert sum(bool(q) == k for q, k in rows) >= 0.8 * len(rows)
    assert quality(docs.where("false"), model).collect() == [] and train_quality(docs, labels.where("false")) is None


def test_url_filter(spark, sf):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x?q#f", "https://example.com/de/1", "ftp://x.org/fr/", "x://y.net", "x://notexample.com/de/", "a://b://c/d", "http://org/fr/é?", "http://cheap-pills.example.com/en/1", "http://library.test/catalog/9"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").unionByName(table(spark, sf, "pages").select("page_id", "url").where("page_id > 100"))
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    model = train_urls(spark)
    got = by_id(filter_urls(pages, model), "page_id")
    for r in pages.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule, g = max(fits, key=len, default=None), got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict == (rules[rule] if rule else "block" if g.probability >= 0.5 else "allow")
    assert got[10].verdict == "block" and got[11].verdict == "allow"
    assert filter_urls(pages.where("false"), model).collect() == []
    clash = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "_b", "_w", "_z", "probability")})
    assert by_id(filter_urls(clash, model), "page_id") == got
    rows = filter_urls(pages.unionByName(pages).withColumn("page_id", F.lit(None).cast("long")), model)
    assert rows.count() == 2 * pages.count()


def test_url_table_with_quotes(spark):
    rows = [("http://o'neil.test/a\\b", 1), ("http://plain.test/'", 0)] * 4
    model = train_urls(spark, rows)
    pages = spark.createDataFrame(list(enumerate(u for u, _ in rows[:2])), "page_id long, url string")
    got = by_id(filter_urls(pages, model), "page_id")
    assert got[0].probability > got[1].probability


def test_url_model_on_words_it_never_saw(spark, sf):
    """Brute-force probabilities of the fitted weights, and held-out words; no judged URL is in the table."""
    learn, held = url_table.split()
    judged = {r.url.split("://")[-1] for r in table(spark, "/root/testdata/sf0.1", "pages").where("url IS NOT NULL").collect()}
    assert len(learn) > 200 and len(held) > 50 and not judged & {u.split("://")[1] for u, _ in url_table.rows()}
    model = train_urls(spark, learn)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    got = by_id(filter_urls(pages, model), "page_id")
    right = sum((got[i].probability >= 0.5) == bool(y) for i, (_, y) in enumerate(held))
    print("held-out URLs right:", right, "of", len(held))
    assert right >= 0.6 * len(held)
    buckets_of = pages.select("page_id", gram_buckets(host_of(pages.url), path_of(pages.url), 11).alias("b")).collect()
    for r in buckets_of:
        z = sum(model[0][b] for b in r.b) / math.sqrt(max(1, len(r.b))) + model[1]
        assert math.isclose(got[r.page_id].probability, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_warc(spark, sf, empty):
    odd = [(1, None, None), (2, "http://x", ""), (3, "http://y\r\nX: z", "same"), (4, "u", "same"), (5, "u", "same"), (6, "u", "é" * 100_000), (7, "", "\r\n\r\n")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    got = by_id(archive_round_trip(pages), "page_id")
    for i, _, html in odd:
        body = (html or "").encode()
        top = max(j for j, _, other in odd if (other or "") == (html or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == top else ("revisit", top))
    index = write_archives(pages, min_bytes=5)
    some = read_archives(index.where("id IN (3, 6)"), gap=0).collect()
    assert {r.id: (r.payload, r.record_type) for r in some} == {3: ("same", "response"), 6: ("é" * 100_000, "response")}
    assert list(ranges([0, 10, 50], [10, 10, 5], 5, 100)) == [(0, 2, 0, 20), (2, 3, 50, 55)]
    assert archive_round_trip(pages.where("false")).collect() == []


def test_warc_rows_of_one_id(spark, edge):
    """One id with different payloads, repeated rows, null ids, columns that clash; no payload is lost."""
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "u", "two"), (2, "u", "two"), (3, "u", "one"), (None, "u", "one"), (None, "u", "own"), (4, "u", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit("clash"), "digest": F.lit("clash"), "file": F.lit(1)}).repartition(3)
    folder = Scratch(spark, "test").path("archives")
    index = write_archives(pages, folder)
    for span in (1 << 20, 100):
        got = sorted(((r.id, r.payload, r.record_type, r.refers_to) for r in read_archives(index, span=span).collect()), key=repr)
        want = [(1, "", "revisit", 3), (1, "", "revisit", 2), (1, "", "revisit", 2), (2, "two", "response", None), (3, "one", "response", None), (None, "one", "response", None), (None, "own", "response", None), (4, "x" * 5000, "response", None)]
        assert got == sorted(want, key=repr)
    (r,) = index.select("file").limit(1).collect()
    lost = open_path(folder)[1] + "/part-lost.warc.gz"
    with open(lost, "wb") as f:
        f.write(b"attempt")
    assert sweep(index, folder) == 1 and sweep(index, folder) == 0 and read_archives(index).count() == len(rows)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = goal / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        for s in full or open_:
            out[s] = cap * sizes[s] if full else weight[s] * level
            goal -= out[s]
        open_ -= full or set(open_)
    return out


@pytest.mark.parametrize("which", ["edge", "given"])
def test_mixing(spark, edge, sf, which):
    docs = edge if which == "edge" else table(spark, sf, "documents")
    rows, got = docs.collect(), by_id(mix_sources(docs))
    sizes, taken = {}, {}
    for r in rows:
        g, n = got[r.doc_id], len(SPACED.findall(r.text or ""))
        assert g["size"] == n and g.taken == g.copies * n and 0 <= g.taken <= 2 * n
        sizes[r.source], taken[r.source] = sizes.get(r.source, 0) + n, taken.get(r.source, 0) + g.taken
    want = brute_targets(sizes)
    for r in rows:
        assert math.isclose(got[r.doc_id].target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and got[r.doc_id].source_size == sizes[r.source]
    for s, n in taken.items():
        # documents are not split: what a single copy more or less of any one document could still mend is mended
        own = [(len(SPACED.findall(r.text or "")), got[r.doc_id].copies) for r in rows if r.source == s]
        gap = want[s] - n
        steps = [k for k, c in own if k and (c < 2 if gap > 0 else c > 0)]
        assert abs(gap) <= max(0.02 * want[s], min((abs(abs(gap) - k) for k in steps), default=abs(gap)) + 1), (s, n, want[s])
    assert by_id(mix_sources(docs.repartition(5))) == got
    assert mix_sources(docs.where("false")).collect() == []


def test_token_count(spark):
    cases = [None, "", " ", "a", " a", "a ", " a  b\n\tc ", "\x1c\x85 x", prose(1, 500)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r.n for r in df.select("i", token_count(df.t).alias("n")).orderBy("i").collect()] == [len(SPACED.findall(t or "")) for t in cases]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs, kept = table(spark, sf, "documents"), None
    out = p.run(spark, sf)
    known = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    for name, stage in p.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(kept.values()), docs.schema)
    got = by_id(out)
    assert set(got) <= set(kept) <= set(known) and len(kept) > len(known) / 2
    assert all(r.text == kept[i].text and r.copies > 0 for i, r in got.items())


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    """The stages on rows without ids and on repeated rows, against brute force."""
    import corpus_pipeline as p

    leak = prose(900, 30)
    rows = [(i, prose(500 + i, 40), "en", "ab"[i % 2]) for i in range(60)] + [(None, prose(600 + i, 40), "en", "a") for i in range(4)]
    rows += [rows[7]] * 3 + [rows[60]] * 2 + [(8, prose(700, 40), "en", "a"), (99, rows[9][1], "en", "b"), (9, prose(701, 40), "en", None), (None, rows[11][1], "en", "a"), (8, rows[3][1], "en", "a")]
    rows += [(70, " ", "en", "a")] * 3 + [(71, None, "en", "a")] * 2 + [(None, "", "en", "a")] * 2 + [(None, prose(800, 20) + " " + leak, "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    groups = {}
    for n, (i, text, _, source) in enumerate(rows):  # equal texts are the only near copies
        words = (text or "").split()
        key = text if words else (i, text) if i is not None else n
        groups.setdefault(key, []).append(((i is None, i or 0), i, text, source))
    want = Counter(min(g, key=lambda r: r[0])[1:] for g in groups.values() if leak not in (g[0][2] or ""))
    for name, stage in p.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
    assert Counter((r.doc_id, r.text, r.source) for r in docs.collect()) == want
    plan = mix_sources(docs).collect()
    taken = p.mix(spark, docs, str(tmp_path)).collect()
    assert sum(want.values()) == len(plan) and all(0 <= r.copies <= 2 for r in plan)
    got = Counter((r.doc_id, r.text, r.source) for r in taken)
    assert not got - want and len(taken) == sum(r.copies > 0 for r in plan)
    sizes, sums = Counter(), Counter()
    for (_, text, source), n in want.items():
        sizes[source] += n * len((text or "").split())
    for r in taken:
        sums[r.source] += r.taken
    assert all(abs(sums[s] - t) <= 40 for s, t in brute_targets(sizes).items())
