"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Senders (runs of the documents' rows, as they lie) sort the fingerprints of their
documents and send each owner of a fingerprint range one Golomb-Rice coded block. The
owner sees which fingerprints occur twice anywhere and answers with a bitmap per block, by which
the sender marks its rows, which never move.
Only documents whose bit is set - the suspects - have their texts shuffled, and those
texts are compared byte by byte. A fingerprint collision therefore costs a comparison,
never a document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_share, discard, lookup, materialise, partitions, semi, shared_dir, squeeze

BLOCK = "owner long, sender long, n int, k int, unary binary, low binary, repeated binary"
#: Rows of a sender and fingerprints of an owner, about: what one group holds in memory.
SENDER_ROWS, OWNER_PRINTS = 500_000, 2_000_000


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary stream and remainder stream of sorted distinct uint64 values."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / len(values)))))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(values), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    rest = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) | rest, dtype=np.uint64)


def _slices(fingerprints: np.ndarray, owners: int, bits: int):
    """Sorted distinct fingerprints, which of them repeat, and where each owner's range begins."""
    values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
    owner = (values * np.uint64(owners)) >> np.uint64(bits)
    starts = np.flatnonzero(np.diff(owner, prepend=owner[:1] + np.uint64(1)))
    return values, counts > 1, owner, starts


def find_suspects(prints: DataFrame, n: int, bits: int, sender_rows: int = SENDER_ROWS, owner_prints: int = OWNER_PRINTS) -> DataFrame:
    """prints(fingerprint, ...), n rows, with a column suspect: its fingerprint occurs again.

    A sender is a run of at most `sender_rows` rows as they lie in a partition of prints. The rows are written
    once, bucketed by sender, and stay there: tasks read a sender's bucket to make its blocks, and read it again
    to mark its rows. Only blocks (by owner) and bitmaps (by sender) are exchanged. An owner has the share of the
    fingerprint range that holds `owner_prints` rows or so, hence senders and owners both grow with n.
    Another column named sender or suspect is refused.
    """
    if {"sender", "suspect"} & {c.lower() for c in prints.columns}:
        raise ValueError("the prints have a column sender or suspect already")
    spark, owners = prints.sparkSession, min(1 << 64 - bits, max(1, -(-n // owner_prints)))  # their product with a fingerprint fits 64 bits
    place, name = F.monotonically_increasing_id(), f"millrace_prints_{uuid.uuid4().hex}"
    sender = F.shiftright(place, 33) * (1 << 20) + (place.bitwiseAND((1 << 33) - 1) / sender_rows).cast("long")
    buckets = max(partitions(spark), -(-n // sender_rows))
    prints.withColumn("sender", sender).write.bucketBy(min(buckets, 100_000), "sender").option("path", f"{shared_dir(spark)}/prints").saveAsTable(name)
    table = spark.table(name)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        values, repeats, owner, starts = _slices(pdf["fingerprint"].to_numpy(), owners, bits)
        sender, out = pdf["sender"].iat[0], []
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            k, unary, low = golomb_encode(values[a:b])
            out.append((int(owner[a]), sender, b - a, k, unary, low, np.packbits(repeats[a:b]).tobytes()))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "k", "unary", "low", "repeated"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [golomb_decode(r.n, r.k, r.unary, r.low) for r in pdf.itertuples()]
        here = [np.unpackbits(np.frombuffer(r.repeated, np.uint8), count=r.n).astype(bool) for r in pdf.itertuples()]
        values, counts = np.unique(np.concatenate(blocks), return_counts=True)
        twice = np.union1d(values[counts > 1], np.concatenate([b[h] for b, h in zip(blocks, here, strict=True)]))
        maps = [np.packbits(np.isin(b, twice)).tobytes() for b in blocks]
        return pd.DataFrame({"owner": pdf["owner"], "sender": pdf["sender"], "bitmap": maps})

    columns = list(prints.columns)

    def mark(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        values, _, owner, starts = _slices(pdf["fingerprint"].to_numpy(), owners, bits)
        maps, twice = dict(zip(replies["owner"], replies["bitmap"], strict=True)), []
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            twice.append(np.unpackbits(np.frombuffer(maps[int(owner[a])], np.uint8), count=b - a))
        at = np.searchsorted(values, pdf["fingerprint"].to_numpy().astype(np.uint64))
        return pdf[columns].assign(suspect=np.concatenate(twice)[at].astype(bool))

    blocks = table.select("sender", "fingerprint").groupBy("sender").applyInPandas(send, BLOCK)
    replies = blocks.groupBy("owner").applyInPandas(answer, "owner long, sender long, bitmap binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prints.schema) + ", suspect boolean"
    marked = materialise(table.groupBy("sender").cogroup(replies.groupBy("sender")).applyInPandas(mark, schema), "marked")
    discard(table)
    spark.sql(f"DROP TABLE {name}")
    return marked


def duplicates(docs: DataFrame, bits: int = 48) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after runs of ASCII white space became one space.
    Null texts count as empty. Of equal texts the row with the smallest doc_id stays; a null
    doc_id counts as largest, and of rows that repeat both doc_id and text one stays. Columns
    beside doc_id and text are ignored. An empty table gives an empty result.
    """
    if not 8 <= bits <= 48:
        raise ValueError("bits must lie between 8 and 48")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), squeeze(F.col("text")).alias("norm"))
    slim = materialise(docs.select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits).alias("fingerprint"),
        F.monotonically_increasing_id().alias("row")), "prints")  # row is fixed from here on
    n = slim.count()
    marked = find_suspects(slim, n, bits).drop("fingerprint")
    discard(slim)

    suspects = marked.filter("suspect")
    texts = semi(docs, suspects.select("doc_id"), "doc_id")
    groups = (
        texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size", F.col("group_size").alias("weight")))
    groups = materialise(groups, "groups")
    found = materialise(lookup(suspects, groups, "sha", "weight", bounded_share(n)), "found")
    # of rows that repeat the kept doc_id and text the first stays: one such row per group
    first = found.filter("group_size IS NOT NULL AND doc_id <=> keep_id").groupBy("sha").agg(F.min("row").alias("stays"), F.first("group_size").alias("weight"))
    found = lookup(found, first, "sha", "weight", bounded_share(n)).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("stays"))).alias("kept"),
        "sha")
    alone = marked.filter("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return found.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only the ids of dropped rows travel. A doc_id of which one row stays and another goes
    (it is repeated) is settled by its texts: of its rows with one text that with the smallest other columns stays.
    Nulls and empty tables as in duplicates().
    """
    verdict = materialise(duplicates(docs), "verdict")
    gone, kept = verdict.filter("NOT kept").select("doc_id"), verdict.filter("kept")
    both = materialise(gone.distinct().join(kept.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id"), "both")
    stay = semi(docs, gone, "doc_id", "left_anti")
    if both.isEmpty():
        return stay
    rows = semi(docs, both, "doc_id").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.sha2(squeeze(F.col("row.text")), 256).alias("sha"))
    # rows alike in everything are one and the same, so the least of each text can be found by aggregation
    least = rows.groupBy("id", "sha").agg(F.min("row").alias("row"))
    wanted = kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_want")).distinct()
    least = least.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_want")), "left_semi")
    return stay.unionByName(least.select("row.*"))
