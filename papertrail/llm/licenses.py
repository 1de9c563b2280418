"""License scan: phrases and an exact set-similarity join of text blocks with license notices.

A text block is a line of a document or, if ``wrapped``, a run of lines, so that notices broken over lines are met: a line that
holds words, with the lines behind it until these hold as many words as the longest template lacks after one. A template is a
notice below; both are sets of words. A block meets a template if
it holds at least ``threshold`` of the template's words. The join is exact and looks at few blocks: words are
ordered by the number of documents that hold them, over all documents, and a block that meets a template of n words
with need = ceil(threshold * n) must hold one of its n - need + 1 rarest words (prefix filter), at least ``need``
template words in all (length filter), and enough of them behind the matched word in the order (positional filter).
What remains is verified. Everything is column expressions; what reaches the driver is one count for each
template word.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import SEPARATORS, lower_ascii

# Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices as words, with their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("epl", "made available under the terms of the eclipse public license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"



def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` (``text``) with n_words, n_base, first_word, last_word and ``__base`` (labels of the phrases found).

    Places are counted in the words of the whole text, each written between two blanks of its own, so that
    neighbouring places share no character. Texts without any phrase skip that step.
    """
    text = F.coalesce("text", F.lit(""))
    maybe = text.rlike("(?i)" + "|".join(f"{_GAP}+".join(p.split()) for p in phrases))
    padded = F.when(maybe, F.concat(F.lit(" "), F.regexp_replace(lower_ascii(text), SEPARATORS, "  "), F.lit(" ")))
    out = docs.withColumns({"n_words": F.regexp_count(text, F.lit(_WORD)).cast("long"), "__padded": padded})
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        wrapped = "".join(f" {w} " for w in phrase.split())
        rest = F.length(F.replace("__padded", F.lit(wrapped), F.lit("")))
        n = F.coalesce(((F.length("__padded") - rest) / len(wrapped)).cast("long"), F.lit(0).cast("long"))
        before = F.regexp_count(F.substring_index("__padded", wrapped, 1), F.lit("[^ ]+"))
        behind = F.regexp_count(F.substring_index("__padded", wrapped, -1), F.lit("[^ ]+"))
        counts.append(n)
        firsts.append(F.when(n > 0, before.cast("long")))
        lasts.append(F.when(n > 0, F.col("n_words") - behind - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    return out.withColumns({
        "n_base": sum(counts[1:], counts[0]), "first_word": F.least(*firsts) if len(firsts) > 1 else firsts[0],
        "last_word": F.greatest(*lasts) if len(lasts) > 1 else lasts[0],
        "__base": F.array_compact(F.array(*labels))}).drop("__padded")


def word_order(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words from rare to common, by the number of documents (all of them) that hold the word; equal
    counts in order of the word."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    held = F.array_intersect(F.split(lower_ascii(F.col("text")), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = {r.word: r.n for r in counts.collect()}  # at most one row per template word
    return sorted(vocabulary, key=lambda w: (known.get(w, 0), w))


def _runs(text: Column, ranks: Callable[[Column], Column], behind: int) -> Column:
    """Per line that holds words its place (``line``) and the ranks in the run that starts there, which goes on until the
    lines behind the first hold ``behind`` words; as each of them holds one, so many lines always do."""
    described = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("line"), F.regexp_count(x, F.lit(_WORD)).alias("n"), ranks(x).alias("ranks"))), lambda x: x["n"] > 0)

    def run(every: Column) -> Column:
        return F.transform(every, lambda x, i: F.struct(x["line"].alias("line"), F.array_sort(F.array_distinct(F.aggregate(
            F.slice(every, i + 2, F.lit(behind)), F.struct(x["ranks"].alias("ranks"), F.lit(0).alias("n")),
            lambda a, y: F.when(a["n"] >= behind, a).otherwise(
                F.struct(F.concat(a["ranks"], y["ranks"]).alias("ranks"), (a["n"] + y["n"]).alias("n"))))["ranks"])).alias("ranks")))

    return F.transform(F.array(described), run)[0]  # the lines are described once


def matching_blocks(docs: DataFrame, keys: list[str], templates: list[tuple[str, str]] = TEMPLATES,
                    threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """Every (document, line, template) with at least ``threshold`` of the template's words in the line, or in the run
    of lines that starts there: the columns ``keys`` of ``docs``, line (from 0), template (its place in the list), label and
    containment."""
    order = word_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    index, sets = [], []
    for k, (label, text) in enumerate(templates):
        ranks = sorted(rank[w] for w in set(text.split()))
        need = math.ceil(threshold * len(ranks) - 1e-9)
        sets.append((k, label, need, ranks))
        index += [(r, k, i) for i, r in enumerate(ranks[:len(ranks) - need + 1])]
    spark = docs.sparkSession
    prefixes = sorted({order[r] for r, _, _ in index})

    def table(rows: list[str], names: str) -> DataFrame:  # of a size that the template list fixes
        return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})"))

    by_word = table([f"({r}, {k}, {i})" for r, k, i in index], "rank, template, place")
    by_template = table([f"({k}, '{label}', {need}, array({', '.join(map(str, ranks))}))" for k, label, need, ranks in sets],
                        "template, label, need, wanted")
    any_prefix = f"(?i)(^|{_GAP})({'|'.join(prefixes)})($|{_GAP})"
    numbers = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])

    def ranks_of(block: Column) -> Column:
        held = F.array_intersect(F.split(lower_ascii(block), SEPARATORS), F.array(*map(F.lit, order)))
        return F.array_sort(F.transform(held, lambda w: F.element_at(numbers, w)))

    maybe = docs.filter(F.col("text").rlike(any_prefix))
    if wrapped:
        longest = max(len(text.split()) for _, text in templates)
        ranked = (maybe.select(*keys, F.explode(_runs(F.col("text"), ranks_of, longest - 1)).alias("run"))
                  .select(*keys, "run.line", "run.ranks"))
    else:
        lines = maybe.select(*keys, F.posexplode(F.split("text", "\n")).alias("line", "block")).filter(F.col("block").rlike(any_prefix))
        ranked = lines.select(*keys, "line", ranks_of(F.col("block")).alias("ranks"))
    found = (ranked.select("*", F.posexplode("ranks").alias("at", "rank")).join(by_word, "rank").join(by_template, "template")
             .filter(F.size("ranks") >= F.col("need"))
             .filter(1 + F.least(F.size("wanted") - F.col("place") - 1, F.size("ranks") - F.col("at") - 1) >= F.col("need")))
    shared = F.array_intersect("ranks", "wanted")
    # A pair met through several prefix words counts once: through the first word the two share.
    return (found.filter((F.array_min(shared) == F.col("rank")) & (F.size(shared) >= F.col("need")))
            .select(*keys, "line", "template", "label", (F.size(shared) / F.size("wanted")).alias("containment")))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                 phrases: dict[str, str] = PHRASES, wrapped: bool = False) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``; other columns are left out) with doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels and score.

    score is 1 where a phrase stands, else the largest containment of a matching template, else 0. Notices over several lines are found if
    ``wrapped``, else only those within a line. A null or
    empty text has no words and no labels; ``doc_id`` may be null or repeated (blocks are joined by document id and
    a hash of the text); texts of any length are scanned whole; an empty table gives an empty one.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__key"), "text")
    matches = (matching_blocks(keyed, ["__key"], templates, threshold, wrapped).groupBy("__key")
               .agg(F.collect_set("label").alias("__own"), F.max("containment").alias("__best")))
    base = phrase_places(keyed, phrases).drop("text")
    joined = base.join(matches, "__key", "left")
    listed = F.array_sort(F.array_union("__base", F.coalesce("__own", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("__base")), ",").alias("base_labels"),
        F.array_join(listed, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__best", F.lit(0.0))).alias("score"))
