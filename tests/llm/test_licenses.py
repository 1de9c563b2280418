"""License scan against plain loops."""

import random
import re

from pyspark.sql import types as T

from papertrail.llm import licenses

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("labels", T.StringType())])


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text):
    ws, places = words_of(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws)) if ws[i:i + len(p)] == p]
    base = {label for _, label in places}
    own, best = set(), 0.0
    for line in (text or "").split("\n"):
        held = set(words_of(line))
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            share = len(t & held) / len(t)
            if share >= licenses.THRESHOLD - 1e-9:
                own.add(label)
                best = max(best, share)
    return (len(ws), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else best)


def corpus():
    rng = random.Random(2)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["und", "mit", "Élan", "x"]
    texts = [None, "", "...", "MIT License", "mit license mit license, MIT-LICENSE", "cc\nby cc  by", "Licensed under CC BY-NC 4.0.", "mİt license",
             "Apache License apache license.", "This work is licensed under the GNU General Public License, version 3.", "general public license " * 3000,
             "licensed under\ncc by nc 4 0", "no licenſe of KIT mit licenKe", "Elan mit license", "emit license", "mit licenses"]
    for _, t in licenses.TEMPLATES:
        ws = t.split()
        rng.shuffle(ws)
        texts += [t.upper(), " ".join(ws), " ".join(ws[1:]), " ".join(ws[:-2]) + "\n" + ws[-1], "x, " + ", ".join(ws) + "! y\nz"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(80)]
    return [(None if i % 11 == 3 else i % 50, t, "clash") for i, t in enumerate(texts)] + [(7, "MIT license", "clash")] * 3


def test_scan_matches_plain_loops(spark):
    rows = corpus()
    out = licenses.license_scan(spark.createDataFrame(rows, DOCS)).collect()
    got = sorted(map(str, map(tuple, out)))
    assert got == sorted(str((d, *plain(t))) for d, t, _ in rows)


def test_main_path_is_native(spark):
    plan = licenses.license_scan(spark.createDataFrame(corpus(), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan.replace("ExistingRDD", ""))


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], DOCS)).count() == 0


def plain_wrapped(text):
    """Labels and largest containment over runs of lines."""
    lines = [w for w in map(words_of, (text or "").split("\n")) if w]
    behind, own, best = max(len(t.split()) for _, t in licenses.TEMPLATES) - 1, set(), 0.0
    for i in range(len(lines)):
        held, n = set(lines[i]), 0
        for line in lines[i + 1:]:
            if n >= behind:
                break
            held |= set(line)
            n += len(line)
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            if len(t & held) / len(t) >= licenses.THRESHOLD - 1e-9:
                own.add(label)
                best = max(best, len(t & held) / len(t))
    return own, best


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n#\n# modification, are permitted provided that",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy of it",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided",
    "unlicense": "this\nis\nfree\nand\n\n\nunencumbered\nsoftware\nreleased\ninto\nthe\npublic\ndomain",
}


def test_wrapped_notices_are_found(spark):
    rows = [(i, f"some code\n\n{t}\nmore of it", label) for i, (label, t) in enumerate(WRAPPED.items())]
    out = licenses.license_scan(spark.createDataFrame(rows, DOCS), wrapped=True).collect()
    assert {r.doc_id: r.labels for r in out} == {i: label for i, label in enumerate(WRAPPED)}


def test_wrapped_scan_matches_plain_loops(spark):
    rng, rows = random.Random(3), corpus()
    texts = [*(t for _, t, _ in rows), *("\n".join(" ".join(rng.choices(t.split(), k=rng.randint(0, 9))) for _ in range(9)) for _, t in licenses.TEMPLATES),
             *(t.replace(" ", "\n") for _, t in licenses.TEMPLATES), *("filler words\n" * 30 + t for t in WRAPPED.values())]
    out = licenses.license_scan(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS), wrapped=True).collect()
    assert len(out) == len(texts)
    for row in out:
        base, (own, best) = plain(texts[row.doc_id]), plain_wrapped(texts[row.doc_id])
        assert tuple(row)[1:6] == base[:5]
        assert row.labels == ",".join(sorted({*filter(None, base[4].split(",")), *own})) and row.score == (1.0 if base[1] else best)
