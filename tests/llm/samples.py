"""Documents with every awkward case: nulls, empty, very long and repeated texts, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, source string, norm string, sha string, row long, fingerprint string, size long, shard_ int"
WORDS = "the of licence released under mit license apache general public gnu version 2 0 Straße naïve K日本 日本 x1 don't 12 3 ,. --   \x85 \x1c".split(" ")


def texts() -> list[str | None]:
    r = random.Random(7)
    some = [" ".join(r.choices(WORDS, k=r.randrange(1, 60))) for _ in range(60)]
    near = [" ".join(r.choices(WORDS, k=300))] * 3
    near = [near[0], near[1] + " end", "Lead " + near[2]]
    return [None, "", " ", "\t\n", "a", "A", "a  b", "a b", " a b", "MIT License", "mit\nlicense; MIT-LICENSE", "é" * 5000, "x" * 100_000, "word " * 50_000, *some, *some[:10], *near, "\U0001f600 ok", "a\x00b", "K license"]


def rows(copies: int = 2) -> list[tuple]:
    found = [(3 * i - 5, t, [None, "web", "books", "code", "wiki"][i % 5], "n", "s", 1, "f", -1, 0) for i, t in enumerate(texts())]
    found += [(None, "a b", None, None, None, None, None, None, None), (None, None, "web", None, None, None, None, None, None)]
    return found + found[5:9] * (copies - 1) + found[-2:]


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
