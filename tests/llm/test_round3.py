"""Chat formatting, vector codes and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import samples
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat, codes, manifest

ROLES = "conv_id long, turn long, role string, text string"
ODD = st.text(alphabet=st.sampled_from(list("\\<>/turn image12audio)document!]([.png\n é日😀")), max_size=60)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def flat(parts, **options):
    v = chat.Flattener(chat.Expansion(**options))
    return v.flatten(parts), v.attachments


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=4))
def test_whatever_is_said_is_read_back(turns):
    written, attached = "", []
    for role, text in turns:
        body, found = flat(chat.parts_of(text))
        written += f"<turn {chat.ROLE_ESCAPED.sub(lambda m: chr(92) + m[0], role)}>{body}</turn>\n"
        attached += found
        assert chat.unescaped(body, found) == text
    assert list(chat.read_turns(written, attached)) == turns


def test_parts_leave_ordered_placeholders_with_references_and_tokens():
    parts = [
        {"kind": "text", "text": "see <tu"}, {"kind": "text", "text": "rn x>"}, {"kind": "image", "uri": "a.png", "width": 57, "height": 28},
        {"kind": "audio", "uri": "b.wav", "seconds": 1.01}, {"kind": "text", "text": None}, {"kind": "document", "uri": "c.pdf", "pages": 3}, {"kind": "image", "uri": "d.png"}, {"kind": "audio", "seconds": 0.0}]
    body, attached = flat(parts)
    assert body == "see \\<turn x><image 1><audio 2><document 3><image 4><audio 5>"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in attached] == [("image", "a.png", 3), ("audio", "b.wav", 26), ("document", "c.pdf", 1536), ("image", "d.png", 256), ("audio", None, 0)]
    with pytest.raises(ValueError, match="video"):
        flat([{"kind": "video"}])


@pytest.mark.parametrize("bad", ["<turn a>x", "x</turn>\n", "<turn a><turn b></turn>\n", "<turn a></turn>\ntail"])
def test_damaged_output_is_refused(bad):
    with pytest.raises(ValueError):
        list(chat.read_turns(bad, []))


def test_conversations_equal_brute_force(spark):
    r = random.Random(3)
    says = [None, "", "\\", "</turn>", "<turn user>", "![x](a/b.PNG) and ![](c.mp3)", "\\### Assistant: </turn> ok", "é" * 3000, "x" * 100_000, "😀\x00"]
    data = [(c, t, r.choice(["user", "assistant", "system", None, "odd>\\role"]), r.choice(says)) for c in [1, 2, None] for t in range(5)]
    data += [(7, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(900)] + [data[0], data[0], (9, None, "assistant", "first"), (9, 1, "user", "then"), (8, 0, "user", "")]
    df = spark.createDataFrame(data, ROLES).selectExpr("*", "1 AS nth", "'s' AS start", "'t' AS tie", "2 AS row").repartition(5)
    formatted = chat.format_turns(df)
    rows = sorted(formatted.collect(), key=lambda x: (x.conv_id is not None, x.conv_id or 0, x.nth))
    whole, at = defaultdict(str), {}
    for x in rows:
        assert x.start == len(whole[x.conv_id])
        whole[x.conv_id] += x.formatted
        assert (x.loss is None) or x.formatted[x.loss.start - x.start: x.loss.end - x.start] in x.formatted
    held = defaultdict(list)
    for c, t, role, text in data:
        held[c].append((t, role, text))
    found = {x.conv_id: x for x in chat.format_and_read(df).collect()}
    assert set(found) == set(held)
    for c, turns in held.items():
        if len({(t, role) for t, role, _ in turns}) == len(turns):
            turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0))
            assert found[c].turns_sha256 == sha("".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns))
            loss = "".join(text or "" for _, role, text in turns if role == "assistant")
            assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), sha(loss))
        assert (found[c].n_turns, found[c].formatted_chars) == (len(turns), len(whole[c]))
    assert found[7].n_turns == 900
    assert chat.format_and_read(df.limit(0)).collect() == []


def test_typed_parts_are_formatted_without_reading_links(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "![x](a.png)", None, None, None, None, None), ("image", None, "u", 28, 28, None, None), None]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = sorted(chat.format_turns(df).collect(), key=lambda x: x.nth)
    assert (a.formatted, a.tokens, a.loss) == ("<turn user>![x](a.png)<image 1></turn>\n", 1, None)
    assert (b.formatted, b.loss.start, b.loss.end) == ("<turn assistant></turn>\n", len(a.formatted) + 16, len(a.formatted) + 16)


def brute_codes(rows, entries, rounds, parts=16):
    kept = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // parts)) * parts
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    cut = lambda v: [tuple(v[p * width // parts:(p + 1) * width // parts]) for p in range(parts)]
    exact = {id(k): v for k, v in zip(kept, (v for _, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), strict=True)}
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, exact[id(k)]))[:entries]
    books = [[cut(v)[p] for *_, v in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for *_, v in kept:
            for p, x in enumerate(cut(v)):
                groups[p, near(p, x)[1]].append(x)
        books = [[tuple(sum(c) // len(c) for c in zip(*groups[p, j], strict=True)) if (p, j) in groups else e for j, e in enumerate(book)] for p, book in enumerate(books)]
    out, per = [], defaultdict(int)
    for i, label, v in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label))
        per[label] += out[-1][2]
    digest = sha(",".join(str(c) for book in books for e in book for c in e))
    return sorted(((i, c, e, per[label], digest) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("side", [1, 16, 1000])
def test_codes_equal_brute_force(spark, side):
    r = random.Random(side)
    centres = [[r.uniform(-1, 1) for _ in range(48)] for _ in range(9)]
    rows = [(r.choice([None, 5, k, k]), [c + r.choice([0, 0, r.uniform(-0.3, 0.3)]) for c in r.choice(centres)], r.choice([None, 0, 1])) for k in range(200)]
    rows += [rows[3], rows[3], (1000, None, 1), (1001, [None] * 48, 1), (1002, [float("nan")] * 48, 2), (1003, [float("inf")] + [0.0] * 47, 2), (1004, [], 2), (1005, [0.5] * 40, None), (1006, [-3.0] * 48, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS slot", "2 AS _n", "'c' AS code").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    found = codes.compress(df, entries=20, side=side).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == brute_codes(exact, 20, 2)


def test_codes_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r)[:4] for r in codes.compress(df).collect()] == [(1, "00" * 16, 0, 0)]
    assert codes.compress(df.limit(0)).collect() == [] == codes.compress(df.selectExpr("vec_id", "CAST(NULL AS ARRAY<FLOAT>) AS embedding", "label")).collect()
    with pytest.raises(Exception, match="components beyond"):
        codes.compress(spark.createDataFrame([(1, [1e7] * 16, 1)], df.schema)).collect()


def test_cells_hold_the_nearest_entry_and_forget_when_full():
    r = np.random.default_rng(0)
    books = r.integers(-60, 60, (3, 30, 2))
    cells = codes.Cells(books, 7, remembered=40)
    for _ in range(5):
        x = r.integers(-100, 100, (50, 6))
        best, distance = cells.nearest(x)
        gaps = ((x.reshape(-1, 3, 1, 2) - books[None]) ** 2).sum(3)
        assert (best == gaps.argmin(2)).all() and (distance == gaps.min(2)).all()


def H(*parts: str) -> str:
    return sha("".join(parts))


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    leaf = lambda d, s, g, n, t: H(*map(field, (d, s, g, n, t)))
    per = defaultdict(list)
    for d, s, g, n, t in rows:
        per[s].append((d, leaf(d, s, g, n, t), leaf(d, s, g, n, t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t)))

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
            levels.append(level)
        return levels

    def path(levels, i):
        steps = []
        for level in levels[:-1]:
            low = i - i % 3
            steps.append(("".join(level[low:i]), "".join(level[i + 1:low + 3])))
            i //= 3
        return steps

    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(per[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for s in order}
    built = {s: tree([x[1] for x in trees[s]]) for s in order}
    top = tree([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (d, own, other) in enumerate(trees[s]):
            steps = path(built[s], i) + path(top, k)
            now = other
            for a, b in steps:
                now = H(a, now, b)
            out.append((d, own, built[s][-1][0], top[-1][0], H(*[a + b for a, b in steps]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["hot", "hot", "hot", "b", "É", "z", None, ""]), r.choice([None, "en", ""]), r.choice([None, k]), r.choice(["one\ntwo", "plain", "", "\n", None])) for k in range(700)]
    rows += [(3000 + i, "texts", None, None, t) for i, t in enumerate(samples.texts())] + [(None, "b", None, 1, "a\nb"), (None, "b", None, 1, "a\nb"), (5, "lone", "x", 1, "a\n"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS pos", "'t' AS tree", "2 AS n", "'d' AS digest", "'r' AS root").repartition(5)
    found = manifest.manifest(df, manifest.tampered_text())
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(x[c] for c in names) for x in found.collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_one_document_and_of_none(spark):
    df = spark.createDataFrame([(2, None, None, None, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    (only,) = manifest.manifest(df).collect()
    assert only.leaf == only.subroot == only.root == H("1:2", "-", "-", "-", "1:x") and only.verified and only.proof_sha256 == sha("")
    assert manifest.manifest(df.limit(0)).collect() == []
