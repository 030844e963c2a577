import random
import re

from cargoledger.llm import licenses

TEXTS = [
    None, "", "Licensed under the MIT License", "licensed UNDER the, mit-license! Under The MIT License", "under the mit licenses",
    "Apache License, Version 2.0 and CC BY-NC 4.0.", "cc by", "cc by nc cc by nc", "É under the mit license é",
    "GNU General Public License, and then version 3 of the License",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    " (the \"Software\"), to deal in the Software without restriction, including",
    "Redistribution and use in source and binary forms, with or without changes", "words " * 3000 + "Licensed under CC BY-NC 4.0.",
    "This is free and unencumbered software released into the public domain.", "Key under the mit license",
]


def plain(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    labels, score = {label for _, label in places}, 0.0
    for label, notice, keys in licenses.TEMPLATES:
        n = notice.split()
        for start in range(-len(n), len(words)):
            same = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(n)]
            if all(any(n[i : i + len(k)] == k and all(same[i : i + len(k)]) for i in range(len(n))) for k in (x.split() for x in keys)):
                labels.add(label)
                score = max(score, sum(same) / len(n))
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9))


def run(spark, texts):
    rows = [(i if i % 5 else None, t, 3) for i, t in enumerate(texts)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    return sorted(((r[0], (*r[1:7], round(r[7] + 0.0, 9)) if len(r) > 8 else (*r[1:7], round(r[7], 9))) for r in out), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    pieces = [w for _, notice, _ in licenses.TEMPLATES for w in notice.split()] + ["x", "y"]
    notices = [n for _, n, _ in licenses.TEMPLATES]
    texts = list(TEXTS)
    for _ in range(120):
        parts = [rng.choice(notices) if rng.random() < 0.3 else rng.choice(pieces) for _ in range(rng.randrange(12))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    want = sorted(((i if i % 5 else None, plain(t)) for i, t in enumerate(texts)), key=repr)
    assert run(spark, texts) == want


def test_empty_table(spark):
    assert run(spark, []) == []
