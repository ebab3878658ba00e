"""Exact and SimHash deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import samples
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import exact_dedup, simhash


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@given(st.sets(st.integers(0, 2**48 - 1), min_size=1, max_size=300))
def test_golomb_round_trip(values):
    sorted_ = np.array(sorted(values), np.uint64)
    k, unary, low = exact_dedup.golomb_encode(sorted_)
    assert (exact_dedup.golomb_decode(len(sorted_), k, unary, low) == sorted_).all()


@pytest.mark.parametrize("bits", [8, 48])  # with 8 bits most fingerprints collide
def test_exact_duplicates_equal_brute_force(spark, bits):
    data = samples.rows()
    groups = defaultdict(list)
    for r in data:
        groups[normal(r[1])].append(r[0])
    found = exact_dedup.duplicates(samples.frame(spark), bits).collect()
    assert len(found) == len(data)
    by_hash = defaultdict(list)
    for r in found:
        by_hash[r.text_sha256].append(r)
    assert len(by_hash) == len(groups)
    for text, ids in groups.items():
        got = by_hash[hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert sorted(r.doc_id is None or r.doc_id for r in got) == sorted(i is None or i for i in ids)
        assert {(r.keep_id, r.group_size) for r in got} == {(least, len(ids))}
        assert [r.doc_id for r in got if r.kept] == [least]


def test_deduplicate_keeps_one_row_of_each_text_and_its_columns(spark):
    kept = exact_dedup.deduplicate(samples.frame(spark))
    assert kept.columns == samples.frame(spark).columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(r[1]) for r in samples.rows()})


def test_repeated_ids_and_clashing_columns(spark):
    data = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c"), (None, "c"), (3, "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "'mine' AS _sha", "1 AS _nth", "'s' AS sender", "true AS suspect", "'r' AS row", "7 AS id")
    verdict = sorted((r.doc_id is None, r.doc_id or 0, r.kept, r.group_size) for r in exact_dedup.duplicates(docs).collect())
    assert verdict == [(False, 1, False, 3), (False, 1, True, 2), (False, 1, True, 3), (False, 2, False, 3), (False, 3, False, 2), (True, 0, False, 3), (True, 0, False, 3), (True, 0, True, 3)]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.text, r._sha, r.row) for r in kept.collect()) == [(False, "a", "mine", "r"), (False, "b", "mine", "r"), (True, "c", "mine", "r")]


def test_suspects_whatever_the_senders_and_owners(spark):
    r = np.random.default_rng(2)
    prints = [int(x) for x in r.integers(0, 1 << 20, 3000)]
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fingerprint long, row long").repartition(4)
    found = exact_dedup.find_suspects(frame, len(prints), 20, sender_rows=100, owner_prints=70).collect()
    assert sorted((x.row, x.suspect) for x in found) == [(i, prints.count(p) > 1) for i, p in enumerate(prints)]


def brute_fingerprint(text: str | None, width: int = 4) -> int:
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    n = min(width, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i: i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs: list[tuple[int | None, int]], radius: int) -> dict[int, int | None]:
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for i, p in pairs:
        least[top(p)] = min((x for x in (i, least.get(top(p))) if x is not None), default=None)
    return {p: least[top(p)] for p in prints}


def brute_parts(text: str | None, width: int, parts: int) -> tuple[int, ...]:
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    n = min(width, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i: i + n]), 42) for i in range(len(words) - n + 1)] if words else []

    def again(x: int, part: int) -> int:
        x = (x + part * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    hs = [h, *[[again(x, p) for x in h] for p in range(1, parts)]]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in each) > len(each)) for each in hs)


def brute_wide(pairs: list[tuple[int | None, tuple[int, ...]]], radius: int, within: int) -> dict[tuple[int, ...], int | None]:
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            apart = [(x ^ y).bit_count() for x, y in zip(a, b, strict=True)]
            if min(apart) <= radius and sum(apart) <= within:
                root[top(a)] = top(b)
    least = {}
    for i, p in pairs:
        least[top(p)] = min((x for x in (i, least.get(top(p))) if x is not None), default=None)
    return {p: least[top(p)] for p in prints}


def test_fingerprint_in_pieces(monkeypatch):
    r = np.random.default_rng(4)
    texts = [None, "", " ", "a", " A b\t", "x" * 300, *[" ".join(f"W{x}" for x in r.integers(0, 90, n)) + "  \n" for n in (3, 4, 5, 6, 7, 50, 400)]]
    for piece in (1, 7, 100, 1 << 18):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for width in (4, 5):
            assert [tuple(simhash.fingerprint(None if t is None else t.encode(), width, 4)) for t in texts] == [brute_parts(t, width, 4) for t in texts]


def test_parts_equal_brute_force(spark):
    r, data = np.random.default_rng(3), []
    for g in range(12):  # near copies of every similarity, null ids and texts, repeated rows among them
        base = [f"w{x}" for x in r.integers(0, 5000, int(r.integers(5, 160)))]
        for c in range(12):
            words = [w if r.random() > c / 300 else f"other{g}" for w in base]
            data.append((100 * g + c, " ".join(words)))
    data += [(None, None), (5000, ""), (5001, "a"), (5002, "A"), (None, data[3][1]), data[7], data[7]]
    frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS part_1")
    pairs = [(i, brute_parts(t, 5, 4)) for i, t in data]
    want = brute_wide(pairs, 8, 44)
    found = simhash.near_duplicates(frame, 8, 5, 4, 44).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], -9 if x[2] is None else x[2])
    assert sorted(((f.doc_id, f.fingerprint, f.component_id) for f in found), key=key) == sorted(((i, f"{p[0]:016x}", want[p]) for i, p in pairs), key=key)
    assert simhash.near_duplicates(frame.limit(0), 8, 5, 4, 44).count() == 0
    kept = simhash.keep_representatives(frame, 8, 5, 4, 44)
    assert kept.columns == frame.columns and kept.filter("doc_id = 703").count() == (want[brute_parts(data[87][1], 5, 4)] == 703)


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(r[0], r[1]) for r in samples.rows()]
    pairs = [(i, brute_fingerprint(t)) for i, t in docs]
    want = brute_components(pairs, 4)
    found = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=key) == sorted(((i, f"{p:016x}", want[p]) for i, p in pairs), key=key)


def test_links_hold_when_buckets_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            p = int(b)
            for bit in r.choice(63, r.integers(0, 7), replace=False):
                p ^= 1 << int(bit)
            prints.add(p)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 4, len(prints))).collect()}
    want = brute_components([(p, p) for p in prints], 4)
    assert {p: roots.get(p, p) for p in prints} == want


def test_representatives_stay_with_their_columns(spark):
    kept = simhash.keep_representatives(samples.frame(spark))
    assert kept.columns == samples.frame(spark).columns
    found = [r.doc_id for r in kept.collect()]
    component = simhash.near_duplicates(samples.frame(spark)).collect()
    assert {r.component_id for r in component if r.component_id is not None} == {i for i in found if i is not None}


def test_empty_tables(spark):
    nothing = samples.frame(spark, [])
    assert exact_dedup.duplicates(nothing).count() == 0 and exact_dedup.deduplicate(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_representatives(nothing).count() == 0
