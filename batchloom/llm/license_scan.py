"""License scans by a positional index of rare words.

Which licence words are rare is counted over all files. Each template is looked up by its own words that have
the highest inverse document frequency; each place of such a word in a file votes for the relative position
of the two. A template whose rare words agree on a position is a candidate there; it is found if its
mandatory phrase stands at that place too and at least half of its words stand where the template has them.
A template leaves out only so many words that any place with half of them still gets its votes, so nothing
that would be found at some place is missed. Phrases of the base list count at every place.

DataFrame functions only, and no shuffle but that of the word counts (one row per licence word).
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# all ASCII but digits and letters; A-Z are lower-cased apart from this
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE_WORDS = 6
VOTES = 2
SLACK = 2
LEAST = 0.5

PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


class Template(NamedTuple):
    label: str
    text: str
    phrase: str


TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted",
    ),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template(
        "gpl",
        "this work is licensed under the gnu general public license version 3",
        "general public license",
    ),
    Template("cc-by", "licensed under cc by nc 4 0", "cc by"),
    Template("cc-by", "licensed under the creative commons attribution license", "creative commons"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license",
        "mozilla public license",
    ),
)

ADDED = (
    "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans",
)


def normal(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by one space."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.btrim(F.regexp_replace(lower, _BETWEEN, " "))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column, phrase: Column, size: Column) -> Column:
    """Where the phrase (an array of words) stands, from 0."""
    return F.when(
        F.size(words) >= size,
        F.filter(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: (F.get(words, i) == F.get(phrase, F.lit(0)))
            & (F.slice(words, i + 1, size) == phrase),
        ),
    ).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _looked_up(own: Sequence[str], by_rarity: Sequence[str]) -> list[int]:
    """The places of a template's rarest words, so many that a place with `LEAST` of all has `VOTES` of these."""
    needed = max(VOTES, math.ceil(LEAST * len(own)))
    order = sorted(range(len(own)), key=lambda j: by_rarity.index(own[j]))
    return order[: max(RARE_WORDS, len(own) - needed + VOTES)]


def _found(words: Column, by_rarity: Sequence[str], templates: Sequence[Template]) -> Column:
    """(template, place, score) of the verified templates."""
    split = [t.text.split() for t in templates]
    # a vote is one number: the place, counted from before the text, and the template
    kinds, before = len(split), max(len(own) for own in split)
    votes_of: dict[str, list[int]] = {}
    for t, own in enumerate(split):
        for j in _looked_up(own, by_rarity):
            votes_of.setdefault(own[j], []).append((before - j) * kinds + t)
    postings = F.create_map(
        *[x for word, own in votes_of.items() for x in (F.lit(word), F.array(*map(F.lit, own)))]
    )
    texts = F.array(*[_strings(own) for own in split])
    phrases = F.array(*[_strings(t.phrase.split()) for t in templates])

    def votes(rare):
        hits = F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i"))),
            lambda x: F.array_contains(rare, x["word"]),
        )
        return F.flatten(
            F.transform(
                hits,
                lambda x: F.transform(
                    F.element_at(postings, x["word"]), lambda p: x["i"].cast("bigint") * kinds + p
                ),
            )
        )

    def score(found):
        own = F.get(texts, found["template"])
        same = F.filter(
            F.sequence(F.lit(0), F.size(own) - 1),
            lambda j: (found["place"] + j >= 0)
            & F.coalesce(F.get(words, found["place"] + j) == F.get(own, j), F.lit(False)),
        )
        return F.size(same) / F.size(own)

    def verified(found):
        own, phrase = F.get(texts, found["template"]), F.get(phrases, found["template"])
        begin = F.greatest(found["place"] - SLACK, F.lit(0))
        near = F.slice(words, begin + 1, found["place"] + F.size(own) + SLACK - begin)
        return F.size(_places(near, phrase, F.size(phrase))) > 0

    def candidates(cast):
        often = F.filter(cast, lambda v, i: F.coalesce(F.get(cast, i + VOTES - 1) == v, F.lit(False)))
        return F.transform(
            F.array_distinct(often),
            lambda v: F.struct(
                F.pmod(v, F.lit(kinds)).cast("int").alias("template"),
                (F.floor(v / kinds) - before).cast("int").alias("place"),
            ),
        )

    rare = F.array_intersect(_strings(list(votes_of)), words)
    agreed = _let(rare, lambda r: _let(F.array_sort(votes(r)), candidates))
    scored = F.transform(
        F.filter(agreed, verified),
        lambda c: F.struct(c["template"].alias("template"), c["place"].alias("place"), score(c).alias("score")),
    )
    return F.filter(scored, lambda c: c["score"] >= LEAST)


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """`docs` with what licences its texts name; input columns named as the new ones are replaced.

    n_words: words of the text; n_base: places of all base phrases; first_word, last_word: the smallest
    and largest start of such a place (words from 0), null if there is none; base_labels, labels: distinct,
    sorted, joined by commas, `labels` with the labels of found templates too; score: the largest share of a
    template that stands at one place, 1 if only a base phrase was found, 0 if nothing; spans: (label, place,
    score) of the found templates. A null or empty text has no words. Rows stay as they are.
    An empty table gives an empty one.
    """
    docs = docs.drop(*[name for name in ADDED if name != text_col])
    columns = docs.columns
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    text = F.col(f"`{text_col}`")
    present = F.array_intersect(F.split(normal(text), " "), _strings(vocabulary))
    counted = (
        docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    )
    # at most one row per licence word
    files = {row["word"]: row["files"] for row in counted.collect()}
    by_rarity = sorted(vocabulary, key=lambda w: (files.get(w, 0), w))

    labels = sorted({*phrases.values(), *(t.label for t in templates)})
    kinds = _strings([t.label for t in templates])
    asked = sorted({*phrases, *(t.phrase for t in templates)})
    base = F.array(
        *[
            F.struct(_strings(p.split()).alias("words"), F.lit(label).alias("label"))
            for p, label in phrases.items()
        ]
    )

    def scan(words):
        per_phrase = F.transform(
            base,
            lambda b: F.struct(
                b["label"].alias("label"), _places(words, b["words"], F.size(b["words"])).alias("at")
            ),
        )
        return F.struct(per_phrase.alias("base"), _found(words, by_rarity, templates).alias("templates"))

    normed = docs.withColumn("_normal", normal(text))
    padded = F.concat(F.lit(" "), "_normal", F.lit(" "))
    # no template without its phrase, so other texts need no closer look
    scanned = normed.withColumn(
        "_scan",
        F.when(padded.rlike(f" (?:{'|'.join(asked)}) "), _let(F.split("_normal", " "), scan)),
    )
    spaces = F.length("_normal") - F.length(F.replace("_normal", F.lit(" "), F.lit("")))
    at = F.flatten(F.transform("_scan.base", lambda b: b["at"]))
    base_labels = F.transform(
        F.filter("_scan.base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]
    )
    found = F.transform("_scan.templates", lambda c: F.get(kinds, c["template"]))
    best = F.array_max(F.transform("_scan.templates", lambda c: c["score"]))
    listed = lambda found: F.array_join(F.array_sort(F.array_distinct(found)), ",")
    assert all("," not in label for label in labels)
    made = {
        "n_words": F.when(F.col("_normal") == "", 0).otherwise(spaces + 1).cast("long"),
        "n_base": F.coalesce(F.size(at), F.lit(0)).cast("long"),
        "first_word": F.array_min(at).cast("long"),
        "last_word": F.array_max(at).cast("long"),
        "base_labels": F.coalesce(listed(base_labels), F.lit("")),
        "labels": F.coalesce(listed(F.concat(base_labels, found)), F.lit("")),
        "score": F.coalesce(best, F.when(F.size(at) > 0, 1.0), F.lit(0.0)).cast("double"),
        "spans": F.transform(
            "_scan.templates",
            lambda c: F.struct(
                F.get(kinds, c["template"]).alias("label"), c["place"].alias("place"), c["score"].alias("score")
            ),
        ),
    }
    return scanned.select(
        *[F.col(f"`{c}`") for c in columns], *[made[name].alias(name) for name in ADDED]
    )
