"""License scans with a positional index of rare words.

Every template is a run of words with key phrases that must stand in it. Document frequencies of the templates' words over the whole
corpus give their IDF. A template may stand in a file only if the file holds all words of its key phrases; of the file's licence words, the two of
highest IDF of each such template are looked up in an index of postings (template, place in it). Each place of a word in the file, less the
posting's, is one where the template could begin; the two posting lists are intersected, as whole numbers that hold template and
start. What is left is verified: the key phrases must stand there word by word, and the share of the template's IDF that stands at its relative
positions is the score of the place. DataFrame functions only; the corpus-wide counts are one row per template word. Work grows with a text's length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between words: ASCII that is neither digit nor letter, of text whose A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template whose postings are intersected, and the least score of a place that gives a label.
RARE, LEAST = 2, 0.6
#: A posting list holds template * SPAN + start + SHIFT; starts may lie before the text.
SPAN, SHIFT = 1 << 40, 1 << 20


@dataclass(frozen=True)
class Template:
    """A licence notice: label, words, and the key phrases that must stand in it."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def phrases(self) -> list[tuple[int, list[str]]]:
        """Offset and words of each key phrase."""
        words, found = self.words, []
        for key in map(str.split, self.keys):
            found.append((next(i for i in range(len(words)) if words[i: i + len(key)] == key), key))
        return found


# The base phrases of the contract and notices of common public licences.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("mit-notice", "released under the mit license", ("released under the mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ("permission to use copy modify and or distribute this software",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
)


def lowered(text: Column) -> Column:
    """Text in lower case for words of ASCII; null as empty.

    lower() maps one other character to an ASCII letter, the Kelvin sign; it is put out of its reach.
    """
    text = F.coalesce(text, F.lit(""))
    return F.lower(F.when(F.contains(text, F.lit("K")), F.replace(text, F.lit("K"), F.lit("ǩ"))).otherwise(text))


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """IDF of each word of the templates, counted over all of docs(text)."""
    words = sorted({w for t in templates for w in t.words})
    own = F.array_intersect(_texts(words), F.split(lowered(F.col("text")), GAP))
    counts = docs.select(F.explode(F.array_append(own, F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per template word
    n = {r["word"]: r["n"] for r in counts}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) + 1 for w in words}


def rarest(t: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The RARE highest-IDF words of a template's key phrases, each with its first offset in the template.

    Only words of key phrases qualify: a place may lack other words of the template.
    """
    first: dict[str, int] = {}
    for at, key in t.phrases():
        for i, w in enumerate(key):
            first[w] = min(at + i, first.get(w, at + i))
    return sorted(first.items(), key=lambda p: (-idf[p[0]], p[0]))[:RARE]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs(doc_id, text) with n_words and places: array of (label, base, start, score), by start and label.

    A place must hold its template's key phrases, which are looked for where the postings of their two rarest words agree; its score is the share of
    the template's IDF that stands where it should, 1 for base templates. The expressions are as many for one template as for hundreds.

    Each row of docs is returned once, whatever repeats. Null texts count as empty. Columns beside the
    two are dropped. An empty table gives no rows. Templates' words are ASCII.
    """
    idf = document_frequencies(docs, templates)
    ranked = [rarest(t, idf) for t in templates]
    lists: list[dict[str, list[int]]] = [{}, {}]  # word to postings, of the rarest word of each template and of the one after it
    for number, found in enumerate(ranked):
        for held, (word, at) in zip(lists, (found * 2)[:2], strict=True):
            held.setdefault(word, []).append(number * SPAN + SHIFT - at)
    index = [F.create_map(*[c for w, codes in held.items() for c in (F.lit(w), F.array(*[F.lit(k).cast("long") for k in codes]))]) for held in lists]
    anchors = sorted({w for held in lists for w in held})
    needs = F.array(*[F.struct(_texts(sorted({w for _, key in t.phrases() for w in key})).alias("words"), _texts([w for w, _ in found]).alias("rare")) for t, found in zip(templates, ranked, strict=True)])
    licence_words = _texts(sorted({w for t in templates for _, key in t.phrases() for w in key}, key=lambda w: (-idf[w], w)))
    keys = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), _texts(key).alias("words")) for at, key in t.phrases()]) for t in templates])
    worth = F.array(*[F.array(*[F.struct(F.lit(w).alias("word"), F.lit(idf[w] / sum(idf[v] for v in t.words)).alias("share")) for w in t.words]) for t in templates])
    labels, bases = _texts([t.label for t in templates]), F.array(*[F.lit(t.base) for t in templates])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text")).alias("_text"))
    may = F.lit(False)
    for a in sorted({w for w in lists[0]}):
        may = may | F.contains("_text", F.lit(a))
    rows = rows.select("doc_id", F.regexp_count("_text", F.lit(WORD)).cast("long").alias("n_words"), F.when(may, F.array_remove(F.split("_text", GAP), "")).alias("_words"))
    words, own = F.col("_words"), F.col("_own")
    rows = rows.withColumn("_own", F.array_intersect(licence_words, words))
    rows = rows.withColumn("_look", F.flatten(F.transform(F.filter(needs, lambda t: F.forall(t["words"], lambda w: F.array_contains(own, w))), lambda t: t["rare"])))
    rows = rows.withColumn("_hits", F.when(F.size("_look") > 0, F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(anchors) & F.array_contains("_look", w), i)))))
    starts = lambda held: F.flatten(F.array_compact(F.transform("_hits", lambda i: F.transform(F.try_element_at(held, F.get(words, i)), lambda k: k + i))))
    rows = rows.withColumn("_starts", F.array_intersect(starts(index[0]), starts(index[1])))
    place = lambda k: F.struct((k / SPAN).cast("int").alias("template"), (k % SPAN - SHIFT).cast("int").alias("start"))
    stands = lambda c: F.forall(F.get(keys, c["template"]), lambda k: F.when(c["start"] + k["at"] >= 0, F.slice(words, F.greatest(c["start"] + k["at"], F.lit(0)) + 1, F.size(k["words"])) == k["words"]).otherwise(False))
    rows = rows.withColumn("_starts", F.filter(F.transform("_starts", place), stands))

    def score(c: Column) -> Column:
        shares = F.transform(F.get(worth, c["template"]), lambda w, i: F.when(F.when(c["start"] + i >= 0, F.get(words, c["start"] + i)) == w["word"], w["share"]).otherwise(0.0))
        return F.when(F.get(bases, c["template"]), 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)))

    found = F.transform("_starts", lambda c: F.struct(c["start"].cast("long").alias("start"), F.get(labels, c["template"]).alias("label"), F.get(bases, c["template"]).alias("base"), score(c).alias("score")))
    places = F.transform(F.array_sort(F.filter(found, lambda p: p["score"] >= LEAST)), lambda p: F.struct(p["label"].alias("label"), p["base"].alias("base"), p["start"].alias("start"), p["score"].alias("score")))
    empty = F.array().cast("array<struct<label:string,base:boolean,start:bigint,score:double>>")
    return rows.select("doc_id", "n_words", F.coalesce(places, empty).alias("places"))


def digest(scanned: DataFrame) -> DataFrame:
    """Per row of scan(): doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest
    start (null without any). Labels are distinct, sorted and comma-joined; score is that of the best place, 0 without any.
    Rows are kept as they come, repeated ones and null doc_ids too.
    """
    base = F.filter("places", lambda p: p["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"), F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))
