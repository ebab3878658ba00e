"""Byte-level BPE against tiktoken, the token store against tokenizers."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import samples
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, token_store

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(RANKS).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_as_the_library_does(text):
    enc = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    ids = enc.encode(text)
    assert enc.decode(ids) == text.encode()
    again = [i for p in enc.pattern.findall(text) for i in enc.piece(p.encode())]
    assert ids == again
    assert ids == [i for p in enc.pattern.findall(text) for i in ([enc.ranks[p.encode()]] if p.encode() in enc.ranks else enc.merged(p.encode()))]


def test_round_trip_equals_the_library(spark, sf_dir, reference):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(r[0], r[1]) for r in samples.rows()]
    found = byte_bpe.round_trip(spark.createDataFrame(docs, "doc_id long, text string"), Path(RANKS).read_bytes(), public_tokenizers.PATTERN).collect()
    want = []
    for i, t in docs:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_another_pattern_cuts_as_it_says(reference):
    pattern = r"\s?[a-z]+\s?|[^a-z]+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    for text in ("some words stand here ", "x  y\nz 12 a", ""):
        assert byte_bpe.encoder(RANKS, pattern).encode(text) == other.encode_ordinary(text)


def test_encode_then_decode(spark):
    rank_file = Path(RANKS).read_bytes()
    back = byte_bpe.decode(byte_bpe.encode(samples.frame(spark), rank_file, public_tokenizers.PATTERN), rank_file, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r[1] or "").encode() for r in samples.rows())


def test_store_equals_the_library(spark, sf_dir, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(r[0] + 1_000_000, r[1]) for r in samples.rows(1) if r[0] is not None]
    docs += [(None, "a b"), (None, None)]
    path = str(tmp_path / "store")
    found = token_store.store_and_check(spark.createDataFrame(docs, "doc_id long, text string"), Path(WORDS), 1, path)
    tokenizer = Tokenizer.from_file(WORDS)
    arrays = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs if i is not None}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found.collect() if r.doc_id is not None}
    at = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs if i is None)
    want = {}
    for i in sorted(arrays):
        want[i] = (at, len(arrays[i]), zlib.crc32(arrays[i].tobytes()))
        at += len(arrays[i])
    assert got == want
    ids = {r.doc_id: r.ids for r in token_store.read(spark, path).collect()}
    assert all(ids[i] == a.tolist() for i, a in arrays.items())


@pytest.mark.parametrize("text", [
    "a <|endoftext|> b", "foo<|endoftext|>bar", "<|startoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>", "A <|EndOfText|> B", "<|STARTOFTEXT|>",
    "Straße<|endoftext|>\u00a0日本 x\x85y", "é <|StartOfText|> z", "<|endoftext| >", "\n<|endoftext|>\t ", "<|endoftext|>" * 3])
def test_added_tokens_are_read_as_the_library_does(text):
    enc = token_store.word_encoder(Path(WORDS).read_text())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_added_tokens_in_the_store(spark, tmp_path):
    texts = ["a <|endoftext|> b", "foo<|endoftext|>bar", "plain words", "<|STARTOFTEXT|> x<|startoftext|>"]
    found = token_store.store_and_check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Path(WORDS), 1, str(tmp_path / "added"))
    want, at, tokenizer = [], 0, Tokenizer.from_file(WORDS)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found.collect())) == want


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aBc zÉß0 1\t.,!-'ÿ÷×", max_size=60)))
def test_any_text_is_stored_as_the_library_encodes_it(text):
    enc = token_store.word_encoder(Path(WORDS).read_text())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_another_definition_takes_the_whole_path():
    held = json.loads(Path(WORDS).read_text())
    held["normalizer"] = {"type": "NFC"}
    enc = token_store.WordEncoder(json.dumps(held))
    for text in ("Some WORDS stand Here", "a  b", "Straße"):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == Tokenizer.from_str(json.dumps(held)).encode(text, add_special_tokens=False).ids


def test_roots_are_folded_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FOLD", 4)
    roots = [token_store.digest(bytes([i])) for i in range(75)]
    recipes = spark.createDataFrame([(i % 2, i // 2, 10 * i, 10, r) for i, r in enumerate(roots)], "part int, nth long, start long, n_tokens long, root binary")
    found = sorted((r.part, r.documents, r.start, r.n_tokens, bytes(r.root)) for r in token_store._part_roots(recipes).collect())
    assert found == [(p, len(roots[p::2]), 10 * p, 10 * len(roots[p::2]), token_store.merkle(roots[p::2])) for p in (0, 1)]


def test_a_missing_chunk_is_noticed(spark, tmp_path):
    path, changed = str(tmp_path / "store"), str(tmp_path / "lacking")
    token_store.write(spark.createDataFrame([(1, "some words stand here"), (2, "others")], "doc_id long, text string"), Path(WORDS).read_text(), 1, path)
    spark.read.parquet(f"{path}/raw").filter("n > 3").write.partitionBy("kind").parquet(f"{changed}/raw")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{changed}/recipes")
    for read in (token_store.read_digests, token_store.read):
        with pytest.raises(Exception, match="verified"):
            read(spark, changed).collect()


def test_changed_chunks_are_noticed(spark, tmp_path):
    path, changed = str(tmp_path / "store"), str(tmp_path / "changed")
    token_store.write(spark.createDataFrame([(1, "some words stand here")], "doc_id long, text string"), Path(WORDS).read_text(), 1, path)
    raw = spark.read.parquet(f"{path}/raw")
    raw.withColumn("payload", F.concat(F.lit(bytearray([7])), F.expr("substring(payload, 2)"))).write.partitionBy("kind").parquet(f"{changed}/raw")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{changed}/recipes")
    for read in (token_store.read_digests, token_store.read):
        with pytest.raises(Exception, match="verified"):
            read(spark, changed).collect()


def test_empty_tables(spark, tmp_path):
    nothing = samples.frame(spark, [])
    assert byte_bpe.round_trip(nothing, Path(RANKS).read_bytes(), public_tokenizers.PATTERN).count() == 0
    assert token_store.store_and_check(nothing, Path(WORDS), 1, str(tmp_path / "empty")).count() == 0
