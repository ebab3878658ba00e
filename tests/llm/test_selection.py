"""License scans, sharding, toxicity, mixing, search and URL filters."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
import samples
from pyspark.sql import functions as F

from millrace.llm import license_scan, mixing, queries, sharding, topk, toxicity, url_filter

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def brute_license(text: str | None) -> tuple:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i: i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_places(text: str | None, idf: dict[str, float]) -> list[tuple]:
    """Start, label, base and score of every template at every word of a text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), []
    for t in license_scan.TEMPLATES:
        own = t.text.split()
        for start in range(-len(own), len(words)):
            held = lambda i: words[start + i] if 0 <= start + i < len(words) else None  # noqa: B023,E731
            if all(all(held(at + i) == w for i, w in enumerate(key)) for at, key in t.phrases()):
                score = 1.0 if t.base else min(1.0, sum(idf[w] for i, w in enumerate(own) if held(i) == w) / sum(idf[w] for w in own))
                if score >= license_scan.LEAST:
                    found.append((start, t.label, t.base, round(score, 6)))
    return sorted(found)


NOTICES = [
    "Permission is hereby granted, free of charge, to any person", "hereby granted free of charge permission is hereby granted free of charge to any person obtaining a copy of this software",
    "Licensed under the GNU General Public License version 2 or 3; licensed under the GNU General Public License version 3", "released under the MIT license. MIT license mit license released under the mit license",
    "cc by 4 0", "x licensed under CC-BY-SA 4.0", "free and unencumbered software released into the public domain", "this is free and unencumbered software", "mozilla public license v 2 0",
    "redistribution and use in source and binary forms", "Licensed under the Apache License, Version 2.0"]


def test_license_labels_and_scores_equal_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(r[0], r[1]) for r in samples.rows()]
    docs += [(10_000 + i, n) for i, n in enumerate(NOTICES)] + [(20_000, "mit license " * 20_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("places", F.lit(1)).withColumn("_words", F.lit("x"))
    idf = license_scan.document_frequencies(frame, license_scan.TEMPLATES)
    held = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for _, t in docs]
    assert all(idf[w] == pytest.approx(math.log((1 + len(docs)) / (1 + sum(w in h for h in held))) + 1) for w in ("mit", "affero", "public", "2"))
    found = Counter((r.doc_id, tuple((p.start, p.label, p.base, round(p.score, 6)) for p in r.places)) for r in license_scan.scan(frame).collect())
    assert found == Counter((i, tuple(brute_places(t, idf))) for i, t in docs)
    assert len({p[1] for _, places in found for p in places}) > 8
    assert license_scan.digest(license_scan.scan(frame.limit(0))).count() == 0


def test_license_places_equal_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(r[0], r[1]) for r in samples.rows()]
    found = license_scan.digest(license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found)
    assert got == Counter((i, *brute_license(t)) for i, t in docs)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)
    assert any(r.n_base for r in found)


@pytest.mark.parametrize("rows", [0, 1, 7, 200])
def test_shards_are_equal_and_gapless(spark, rows):
    df = spark.range(rows, numPartitions=5).selectExpr("id % 50 AS a", "IF(id % 3 = 0, NULL, 'x') AS _block", "'k' AS _key", "1 AS part", "map('m', id) AS row")
    found = sharding.shuffle_into_shards(df, 24).collect()
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(24)]
    assert sum(sizes) == rows and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.a, r._block, r._key, r.part, tuple(r.row.items())) for r in found) == Counter((r.a, r._block, r._key, r.part, tuple(r.row.items())) for r in df.collect())


def test_shards_do_not_depend_on_shuffle_partitions(spark, sf_dir):
    runs = []
    for n in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(tuple, queries.op2_sharding(spark, sf_dir).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1]


def test_sharding_query_measures_texts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op2_sharding(spark, sf_dir).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs)
    assert {r.shard for r in found} == set(range(24)) and max(Counter(r.shard for r in found).values()) - min(Counter(r.shard for r in found).values()) <= 1


def test_shuffle_is_uniform(spark):
    """Each row is as likely in each shard, whichever partition it lies in, and lands anywhere in it."""
    df, shards, runs, n = spark.range(300, numPartitions=3), Counter(), 8, 300
    moved = []
    for seed in range(runs):
        found = sharding.shuffle_into_shards(df, 3, seed).collect()
        shards.update((r.id // 100, r.shard) for r in found)
        moved.append(np.corrcoef([r.id for r in found], [r.slot for r in found])[0, 1])
    assert sum((shards[p, s] - runs * n / 9) ** 2 / (runs * n / 9) for p in range(3) for s in range(3)) < 30
    assert abs(np.mean(moved)) < 0.1 and len({round(m, 6) for m in moved}) == runs


def test_communication_matrix_margins():
    for rows in ([5, 0, 9, 3], [2 * 10**9, 10**9, 7], [3 * 10**10, 1, 10**10], [0, 0]):
        total = sum(rows)
        capacities = [total // 4 + (s < total % 4) for s in range(4)]
        m = sharding.communication_matrix(rows, capacities, 3)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == capacities and (m >= 0).all()


def test_communication_matrix_follows_the_hypergeometric_law():
    rows, capacities, runs = [4, 3, 2], [3, 3, 3], 20_000
    ways = lambda m: math.prod(math.factorial(x) for x in [*rows, *capacities]) / (math.factorial(9) * math.prod(math.factorial(x) for r in m for x in r))
    found = Counter(tuple(map(tuple, sharding.communication_matrix(rows, capacities, seed).tolist())) for seed in range(runs))
    assert sum(ways(m) for m in found) > 0.99
    chi = sum((n - runs * ways(m)) ** 2 / (runs * ways(m)) for m, n in found.items())
    assert chi < len(found) + 5 * math.sqrt(2 * len(found))


def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in found.items())
    held = [(found[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in found and found[r.doc_id].held_out]
    hit = sum(p and y for p, y in held)
    assert len(held) > 500 and hit / sum(y for _, y in held) >= 0.8 and hit / sum(p for p, _ in held) >= 0.8


def brute_features(text: str | None) -> set[int]:
    s, found = f" {' '.join((text or '').lower().split())} ", set()
    for n in toxicity.ORDERS:
        for i in range(len(s) - n + 1):
            h = ord(s[i]) * 0x9E3779B1 % 2**32
            for c in s[i + 1: i + n]:
                h = (h ^ ord(c)) * (0x85EBCA6B + 2 * n) % 2**32
                h ^= h >> 15
            found.add((h * 0xC2B2AE35 % 2**32) >> (32 - toxicity.BITS))
    return found


def test_features_equal_brute_force(monkeypatch):
    reader = toxicity.Reader()
    for size in (1 << 20, 7):
        monkeypatch.setattr(toxicity, "BLOCK", size)
        for t in [None, "", "a", "Ärger İ straße", "日本 語\U0001f600 \n\n x", "abc " * 50, *samples.texts()[20:40]]:
            got = reader.present(t).tolist()
            assert len(got) == len(set(got)) and set(got) == brute_features(t)


def test_fit_equals_plain_gradient_descent():
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["bad", "vile", "good", "calm", "word", "tree"], 6, p=[0.3, 0.2, 0.1, 0.1, 0.15, 0.15] if i % 3 == 0 else [0.05, 0.05, 0.3, 0.2, 0.2, 0.2])) for i in range(15)]
    y, a, strength = np.array([i % 3 == 0 for i in range(15)], int), 4.0, 0.05
    sets = [brute_features(t) for t in texts]
    names = sorted(set().union(*sets))
    x = np.array([[f in s for f in names] for s in sets], float)
    added = a / len(y)
    ratio = np.log((x[y == 1].mean(axis=0) + added) / (x[y == 0].mean(axis=0) + added))
    z, w = np.column_stack([x * ratio, np.ones(len(y))]), np.zeros(len(names) + 1)
    rate = 1 / (strength + (z**2).sum(axis=1).max() / 4)
    for _ in range(60_000):
        w -= rate * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + strength * w)
    reader = toxicity.Reader()
    model = toxicity.learn([np.sort(reader.present(t)) for t in texts], y, a, strength, (1e12, 1e12), epochs=3000, tolerance=1e-12)
    for t in [*texts, "bad tree", "other things", ""]:
        want = float(sum(w[i] * ratio[i] for i, f in enumerate(names) if f in brute_features(t)) + w[-1])
        assert model.score(t, reader) == pytest.approx(1 / (1 + math.exp(-want)), abs=1e-4)


def test_calibration_shrinks_to_none_without_a_switch():
    """Twice the slope is true: few scores leave it near 1, many find it, and one more never jumps."""
    r = np.random.default_rng(5)
    z = r.normal(0, 2, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * z))).astype(float)
    slopes = np.array([toxicity.calibrate(z[:n], y[:n])[0] for n in [0, 1, *range(2, 80), 4000]])
    assert slopes[0] == 1 and abs(slopes[1] - 1) < 0.2 and slopes[-1] == pytest.approx(2, abs=0.2)
    assert np.abs(np.diff(slopes[:-1])).max() < 0.2


def test_a_bounded_number_of_characters_is_fitted(spark):
    docs = spark.createDataFrame([(i, ("bad vile " if i % 2 else "good calm ") * (10_000 if i == 5 else 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most_chars=2_000)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in toxicity.score(docs, model).collect())
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, labels, most_chars=0)).collect()} == {0.0}


def test_toxicity_without_labels_and_with_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1), (4, None), (7, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(samples.frame(spark), labels)
    assert [r.predicted for r in toxicity.score(samples.frame(spark), model).collect()] == [0] * len(samples.rows())
    assert toxicity.keep_clean(samples.frame(spark), model).count() == len(samples.rows())
    assert toxicity.score(samples.frame(spark, []), model).count() == 0 and toxicity.keep_clean(samples.frame(spark, []), model).count() == 0
    empty = toxicity.fit(samples.frame(spark, []), labels)
    assert [r.predicted for r in toxicity.score(samples.frame(spark), empty).collect()] == [0] * len(samples.rows())


def test_mix_meets_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").unionByName(samples.frame(spark).select("doc_id", "text", "source"))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for r in docs.collect():
        per[r.source] += size(r.text)
    names = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(per.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * per[s]}
        for s in full or open_:
            target[s] = 3.0 * per[s] if full else weight[s] * level
        left -= sum(3 * per[s] for s in full)
        open_ -= full or open_
    rows = mixing.plan(docs).collect()
    want = Counter((r.doc_id, size(r.text), per[r.source], f"{target[r.source]:.6g}") for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.source_size, f"{r.target:.6g}") for r in rows) == want
    took, largest = Counter(), Counter()
    for r in rows:
        took[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r["size"])
        assert 0 <= r.taken <= 3 * r["size"] and len(r.positions) == r.copies
    assert all(abs(took[k] - k[1]) <= largest[k] for k in took)
    assert mixing.plan(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.schedule(mixing.plan(docs.limit(0))).count() == 0


def demand(t: float, slope: float) -> float:
    """Integral of the rate 1 + slope * (2t - 1) by small steps."""
    steps = 2_000
    return sum((1 + slope * (2 * (t * (k + 0.5) / steps) - 1)) * t / steps for k in range(steps))


def test_positions_are_where_the_schedule_has_given_their_share(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.plan(docs).collect()
    of = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    per, names = defaultdict(list), sorted({s for s, _ in of.values()}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    for r in rows:
        per[of[r.doc_id][0]].append(r)
    for source, own in per.items():
        slope, at = 0.5 * (1 - 2 * (weight[source] - 1) / 4), 0
        own.sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
        for r in own:
            for k, position in enumerate(r.positions):
                share = min(1.0, (at + r["size"] / 2 + k * r.source_size) / r.target)
                assert demand(position, slope) == pytest.approx(share, abs=1e-3)
            at += r["size"]
    copies = [(r.position, r.doc_id) for r in mixing.schedule(mixing.plan(docs)).collect()]
    assert copies == sorted(copies)  # collected partition after partition
    assert Counter(i for _, i in copies) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mix_comes_in_order_whatever_the_columns(spark):
    docs = samples.frame(spark).withColumns({"_size": F.lit(1), "_id": F.lit(2), "_copy": F.lit(3), "file": F.lit("f"), "at": F.lit(0), "position": F.lit(9.0), "order": F.lit("o")})
    assert mixing.mix(docs).columns == docs.columns
    mixed = mixing.mix(docs, position="due").collect()
    due = [r.due for r in mixed]
    known = [d for d in due if d is not None]
    assert known == sorted(known) and due[: len(known)] == known
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.text) for r in mixed if size(r.text) == 0) == Counter((r.doc_id, r.text) for r in docs.collect() if size(r.text) == 0)
    want = Counter()
    for r in mixing.plan(docs).collect():
        want[r.doc_id, r["size"]] += r.copies
    assert Counter((r.doc_id, size(r.text)) for r in mixed if size(r.text)) == +want


def test_search_equals_brute_force_with_odd_rows(spark):
    r = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in r.normal(size=16)]) for i in range(300)]
    data += [(400, None), (450, [1.0, None] + [0.0] * 14), (500, [math.nan] * 16), (550, [math.inf] * 16), (None, [1.0] * 16), (600, []), (650, [1.0] * 3), (7, data[7][1]), (50, data[50][1])]
    live = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in sorted(set(x for x in live if x[0] % 50 == 0)):
        near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in live if j != i and len(v) == len(q))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(frame, query_cells=3 * 16, candidate_cells=40 * 16).collect())) == sorted(want)
    assert topk.search(frame.limit(0)).count() == 0


def test_url_filter_on_odd_rows(spark, monkeypatch):
    captures = spark.createDataFrame([(1, "https://A.example.com/x/y", "2024-03-01"), (1, "https://A.example.com/x/y", "2024-03-01"), (2, None, "2024-03-01"), (3, "nonsense", None), (4, "http://example.com", "2023-01-01"), (5, "http://example.com/", "2024-06-01")], "page_id long, url string, fetched string")
    captures = captures.withColumn("fetched", captures["fetched"].cast("date"))
    log = [("example.com", "block", "2024-01-01"), ("example.com", "remove", "2024-05-01"), ("a.example.com/x", "allow", "2024-02-01"), ("a.example.com/x", "block", "2024-02-01"), ("a.example.com", "allow", "2024-02-15"), (None, "block", "2024-01-01"), ("example.com", "oops", "2024-05-20"), ("example.com", "block", None)]
    entries = spark.createDataFrame(log, "pattern string, action string, dated string")
    found = sorted((r.page_id, r.n_active, r.rule, r.blocked) for r in url_filter.evaluate(captures, entries.withColumn("dated", entries["dated"].cast("date"))).collect())
    kept = url_filter.keep(captures, entries.withColumn("dated", entries["dated"].cast("date")))
    assert sorted(r.page_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == captures.columns
    dated = entries.withColumn("dated", entries["dated"].cast("date"))
    assert url_filter.evaluate(captures.limit(0), dated).count() == 0
    assert [r.blocked for r in url_filter.evaluate(captures, dated.limit(0)).collect()] == [False] * 6
    monkeypatch.setattr(url_filter, "small", lambda df, rows=0: None)
    monkeypatch.setattr(url_filter, "bounded_share", lambda n: 1)  # each name asked for twice counts as hot
    assert found == sorted((r.page_id, r.n_active, r.rule, r.blocked) for r in url_filter.evaluate(captures, dated).collect())
    assert found == [(1, 3, "a.example.com/x", True), (1, 3, "a.example.com/x", True), (2, 0, None, False), (3, 0, None, False), (4, 0, None, False), (5, 0, None, False)]


def test_search_skips_blocks_and_stays_exact(spark):
    """Norms differ, so envelopes drop blocks; products beyond 2^53 are exact, copies and ties count."""
    r = np.random.default_rng(6)
    data = [(int(i), [float(x) for x in r.normal(size=8) * 10.0 ** (i % 4)]) for i in range(400)] + [(1000 + i, [3e6 + i % 2] * 8) for i in range(60)] + [(7, data_) for data_ in [[5e3] * 8] * 90]
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in data]
    want = []
    for i, q in live:
        if i % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in live if j != i)[:5]
            want += [(i, k + 1, j, max(-(2**63) + 1, min(2**63 - 1, -s))) for k, (s, j) in enumerate(near)]
    found = topk.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), query_cells=16, candidate_cells=30 * 8)
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert oracle.of_frame(queries.QUERIES[name](spark, sf_dir)) == oracle.of_sql(oracle.connect(sf_dir), queries.ORACLES[name])


def test_long_texts_full_of_places_take_linear_time(spark):
    """Twice 40,000 places: quadratic work took a minute for the first and four for both."""
    df = spark.createDataFrame([(1, "mit license " * 40_000), (2, "general public license; " * 40_000)], "doc_id long, text string")
    license_scan.digest(license_scan.scan(df)).collect()
    began = time.time()
    found = license_scan.digest(license_scan.scan(df)).orderBy("doc_id").collect()
    assert time.time() - began < 20
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in found] == [(80_000, 40_000, 0, 79_998, "mit"), (120_000, 40_000, 0, 119_997, "gpl")]


def test_the_training_order_is_written_and_read(spark):
    docs = samples.frame(spark).withColumns({"order": F.lit("o"), "place": F.lit(1), "copy": F.lit(2), "position": F.lit(0.5)})
    rows = mixing.scheduled(docs).collect()
    plan = mixing.plan(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken)
    assert sorted(map(str, map(key, rows))) == sorted(map(str, map(key, plan)))
    copies = sum(r.copies for r in plan)
    places = [p for r in rows if r.taken for p in {r.first_place, r.last_place}]
    assert len(places) == len(set(places)) and min(places) == 0 and max(places) == copies - 1
    ends = sorted((p, x) for r in rows if r.taken for p, x in ((r.first_place, r.first_position), (r.last_place, r.last_position)))
    assert [x for _, x in ends] == sorted(x for _, x in ends)
    assert all(r.first_place is None for r in rows if not r.taken) and mixing.scheduled(docs.limit(0)).count() == 0
