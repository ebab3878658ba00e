"""Merkle manifest of a dataset, with a proof for every document.

Each document is a leaf. Per source the leaves ascend by doc_id; level by level, runs of three consecutive
nodes become one hash until one is left, and the sources' roots give the dataset's root in the same way. In a level,
windows over aligned blocks give each node the nodes at fixed offsets, two behind and two ahead; its slot in the run and the
run's length mask those that belong to it. They are its siblings, and the row of the first child hashes the parent. Runs never
cross a block, so no window holds more than a block, whatever a source holds. Proofs then come down from the roots: a node's
siblings, followed by the proof of its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_share, lookup, materialise, small
from millrace.operators.numbering import numbered

#: Nodes that share a parent, and nodes of a window: a power of ARITY.
ARITY, BLOCK = 3, 3**5
STEP = "struct<before:binary,after:binary>"


def field(value: Column) -> Column:
    """A value as text: "-" if null, else its UTF-8 byte count, ":" and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    """SHA-256 (binary) of texts one after another."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(doc: dict[str, Column]) -> Column:
    return hashed(*[field(doc[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes(tree, pos, n, digest): each as (tree, pos, n, digest, step, parent), written.

    tree says which tree a node is of (not null), pos its place in the level from 0, n how many there are. step is a node's siblings, those
    before and those after it; parent is filled on first children. A level of one node is a tree's last.
    """
    def masked(node: Column, there: Column) -> Column:
        return F.when(there, node).otherwise(F.lit(b""))

    span = Window.partitionBy("tree", F.expr(f"pos div {BLOCK}")).orderBy("pos")
    slot = F.col("pos") % ARITY
    run = F.least(F.lit(ARITY), F.col("n") - (F.col("pos") - slot))
    behind = [masked(F.lag("digest", k).over(span), slot >= k) for k in (2, 1)]
    ahead = [masked(F.lead("digest", k).over(span), slot + k < run) for k in (1, 2)]
    found, now = [], nodes
    while True:
        step = F.struct(F.concat(*behind).alias("before"), F.concat(*ahead).alias("after")).alias("step")
        level = now.select("tree", "pos", "n", "digest", step)
        parent = F.when((slot == 0) & (F.col("n") > 1), hashed(digits(F.col("digest")), digits(F.col("step.after"))))
        found.append(materialise(level.withColumn("parent", parent), f"level-{len(found)}"))
        now = found[-1].filter("parent IS NOT NULL").select("tree", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.col("parent").alias("digest"))
        if now.isEmpty():
            return found


def proofs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, roots) of the trees over nodes(tree, pos, n, digest).

    paths has tree, pos and path, the siblings of each node and of its ancestors, lowest first; roots has tree and root.
    """
    above, roots = None, None
    for level in reversed(levels(nodes)):
        last = level.filter("n = 1").select("tree", F.col("digest").alias("root"))
        roots = last if roots is None else roots.unionByName(last)
        own = level.filter("n = 1").select("tree", "pos", F.array().cast(f"array<{STEP}>").alias("path"))
        if above is not None:
            parents = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_path"))
            lower = level.filter("n > 1").join(small(parents) or parents, (F.col("tree") == F.col("_tree")) & (F.expr(f"pos div {ARITY}") == F.col("_pos")))
            own = own.unionByName(lower.select("tree", "pos", F.concat(F.array("step"), "_path").alias("path")))
        above = materialise(own, "paths")
    return above, roots


def fold(start: Column, path: Column) -> Column:
    """The root (binary) that a node and its path give."""
    return F.aggregate(path, start, lambda node, s: hashed(digits(s["before"]), digits(node), digits(s["after"])))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source, n_chars): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    subroot is the root over the row's source, root that of the dataset, proof_sha256 the hash of all siblings from the
    leaf to the root. folded_root is what the leaf gives with these siblings, after the text was replaced by `tampered` (a
    column over docs; by default nothing is replaced), and verified says whether that is the root. A source's
    leaves ascend by doc_id, null first, then by leaf, so rows that repeat are each a leaf and reruns agree. Null sources are a source of
    their own, before all others; null fields are told from empty ones. A lone leaf is its source's root, a lone source's root the
    dataset's. Columns beside the five are ignored. An empty table gives no rows. Whole texts are hashed where they lie; only digests move.
    """
    doc = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = doc["text"] if tampered is None else tampered
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(doc).alias("digest"), F.when(~changed.eqNullSafe(doc["text"]), leaf(doc | {"text": changed})).alias("tampered"))
    leaves = materialise(leaves, "hashed")  # texts are read once, whatever sorting needs
    leaves = materialise(numbered(leaves, ["source"], ["doc_id", "digest"], nth="pos").withColumn("tree", field(F.col("source"))), "leaves")
    sizes = leaves.groupBy("tree", "source").agg(F.count(F.lit(1)).alias("n"))
    total = leaves.count()
    placed = materialise(lookup(leaves, sizes.select("tree", F.col("n").alias("_weight"), "n"), "tree", "_weight", bounded_share(total)), "placed")
    paths, roots = proofs(placed.select("tree", "pos", "n", "digest"))

    tops = numbered(sizes.select("source", F.col("tree").alias("name"), F.col("n").alias("weight")).join(roots, F.col("name") == F.col("tree")).select("source", "name", "weight", F.col("root").alias("digest")), [], ["source"], nth="pos")
    tops = materialise(tops, "subroots")
    n = tops.count()
    upper, whole = proofs(tops.select(F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("n"), "digest"))
    upper = upper.select(F.col("pos").alias("_pos"), F.col("path").alias("upper"))
    top = whole.first()  # one row, or none over an empty table
    root = F.lit(bytes(top["root"]) if top else None).cast("binary")
    tops = tops.join(small(upper) or upper, F.col("pos") == F.col("_pos"))
    tops = materialise(tops.select(F.col("name").alias("tree"), F.col("weight").alias("_weight"), F.col("digest").alias("subroot"), "upper", root.alias("root")), "sources")

    held = paths.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "path")
    rows = placed.select("tree", "pos", "doc_id", "digest", "tampered").join(held, (F.col("tree") == F.col("_tree")) & (F.col("pos") == F.col("_pos")))
    rows = lookup(rows.drop("_tree", "_pos"), tops, "tree", "_weight", bounded_share(total))
    path = F.concat("path", "upper")
    rows = rows.select(
        "doc_id", digits(F.col("digest")).alias("leaf"), digits(F.col("subroot")).alias("subroot"), digits(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform(path, lambda s: F.concat(digits(s["before"]), digits(s["after"]))), ""), 256).alias("proof_sha256"),
        digits(fold(F.coalesce("tampered", "digest"), path)).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text() -> Column:
    """The text without its line feeds where the CRC-32 of the decimal doc_id is even; others, rows without doc_id and null texts are as they were."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
