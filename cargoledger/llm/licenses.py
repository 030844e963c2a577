"""License scans with a positional rare-token index.

Texts have A-Z lower-cased; words are runs of ASCII digits and letters and of everything beyond
ASCII. The base counts places where the words of a base phrase stand one after the other.

Method. Each licence template is a short notice with mandatory key phrases, all of which lie in the
notice. The document frequency of every template word is counted over all documents. A template is
indexed by its highest-IDF words (`RARE` of the notice, and the highest of each key phrase): word ->
(template, position). A file's words are looked up in this index only; each hit says where the
template would start, hits are intersected by that start, and where the indexed words of the key
phrases agree on a start, the key phrases are verified word by word. The score is the greatest share
of a verified template's words that stand in their places.

* Frequencies are partial counts per task, added in one aggregate of at most the templates' words.
* The scan is one pass without a shuffle; a task holds one block of texts at a time.

Rows. Null text: no words. Ids are only carried, nulls and repeats included. Empty input gives empty
output. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm import common
from cargoledger.llm.words import NOT_ALPHANUMERIC, Block, blocks

RARE = 3
#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as their licences word them (label, notice, mandatory key phrases).
TEMPLATES = (
    ("mit", "licensed under the mit license", ("under the mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    (
        "cc-by-nc",
        "creative commons attribution noncommercial 4 0 international",
        ("creative commons attribution noncommercial",),
    ),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "gpl-2",
        "under the terms of the gnu general public license as published by the free software foundation"
        " either version 2 of the license",
        ("gnu general public license", "version 2 of the license"),
    ),
    (
        "gpl-3",
        "under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license",
        ("gnu general public license", "version 3 of the license"),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without"
        " fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, as `Block.word_hashes` gives them."""
    (block,) = blocks(pa.array([" ".join(words)]), NOT_ALPHANUMERIC, lower=True)
    return block.word_hashes()


class Lookup:
    """Which of a few known words stand where in a block: a small table first, then exactly."""

    def __init__(self, words: list[str]):
        self.words = words
        self.hashes = hash_words(words) if words else np.zeros(0, np.uint64)
        self.order = np.argsort(self.hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes & np.uint64(0xFFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block, and the number of the word at each."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        sorted_hashes = self.hashes[self.order]
        slot = np.minimum(np.searchsorted(sorted_hashes, hashes[at]), max(len(self.words) - 1, 0))
        same = sorted_hashes[slot] == hashes[at] if len(self.words) else np.zeros(0, bool)
        return at[same], self.order[slot[same]]


def _frequency_task(words: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(words), np.zeros(len(words), np.int64)
        for batch in batches:
            for block in blocks(batch["text"], NOT_ALPHANUMERIC, lower=True):
                at, word = lookup.find(block.word_hashes())
                row = np.searchsorted(block.first, at, side="right") - 1
                pairs = np.unique(row * len(words) + word)
                counts += np.bincount(pairs % len(words), minlength=len(words))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in used], pa.string()), pa.array(counts[used])], ["word", "n"]
        )

    return task


def document_frequencies(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows each word occurs; at most one row per word comes to the driver."""
    rows = texts.select("text").mapInArrow(_frequency_task(words), "word string, n long")
    found = rows.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in found}


class Index:
    """Postings of the templates' rare words: word -> (template, position)."""

    def __init__(self, templates, frequency: dict[str, int], rare: int = RARE):
        self.templates = [(label, notice.split(), [k.split() for k in keys]) for label, notice, keys in templates]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        #: per template: (places of the rare words of its key phrases, spans of the key phrases)
        self.needs = []
        for number, (_, words, keys) in enumerate(self.templates):
            common_first = lambda i, w=words: (frequency.get(w[i], 0), i)
            chosen = set(sorted(range(len(words)), key=common_first)[:rare])
            spans, rarest = [], set()
            for key in keys:
                start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
                spans.append((start, start + len(key)))
                rarest.add(min(range(start, start + len(key)), key=common_first))
            chosen |= rarest
            for i in chosen:
                self.postings[words[i]].append((number, i))
            self.needs.append((rarest, spans))

    def match(self, hits: list[tuple[int, str]], word_at, n_words: int) -> tuple[set[str], float]:
        """Labels and score of one file from its (place, indexed word) hits."""
        starts: dict[tuple[int, int], set[int]] = defaultdict(set)
        for place, word in hits:
            for template, position in self.postings[word]:
                starts[template, place - position].add(position)
        labels, score = set(), 0.0
        for (template, start), positions in starts.items():
            label, words, _ = self.templates[template]
            rarest, spans = self.needs[template]
            if not rarest <= positions:
                continue
            same = [0 <= start + i < n_words and word_at(start + i) == w for i, w in enumerate(words)]
            if all(all(same[a:b]) for a, b in spans):
                labels.add(label)
                score = max(score, sum(same) / len(words))
        return labels, score


def base_places(block: Block, hashes: np.ndarray, word_at) -> list[tuple[int, str]]:
    """(place in the block, label) wherever a base phrase stands inside one row."""
    out = []
    row_end = None
    for phrase, label in BASE.items():
        words = phrase.split()
        wanted = hash_words(words)
        n = len(hashes) - len(words) + 1
        if n <= 0:
            continue
        same = hashes[:n] == wanted[0]
        for k in range(1, len(words)):
            same &= hashes[k : n + k] == wanted[k]
        for at in np.flatnonzero(same).tolist():
            row_end = block.first[np.searchsorted(block.first, at, side="right")]
            if at + len(words) <= row_end and all(word_at(at + k) == w for k, w in enumerate(words)):
                out.append((at, label))
    return out


def _scan_task(index: Index):
    words = sorted(index.postings)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(words)
        for batch in batches:
            for block in blocks(batch["text"], NOT_ALPHANUMERIC, lower=True):
                hashes = block.word_hashes()

                def word_at(i: int, block: Block = block) -> str:
                    return block.data[block.start[i] : block.end[i]].tobytes().decode("utf-8", "replace")

                base: dict[int, list[tuple[int, str]]] = defaultdict(list)
                for at, label in base_places(block, hashes, word_at):
                    row = int(np.searchsorted(block.first, at, side="right")) - 1
                    base[row].append((at - int(block.first[row]), label))
                hits: dict[int, list[tuple[int, str]]] = defaultdict(list)
                at, number = lookup.find(hashes)
                rows = np.searchsorted(block.first, at, side="right") - 1
                for r, p, w in zip(rows.tolist(), at.tolist(), number.tolist(), strict=True):
                    if word_at(p) == words[w]:
                        hits[r].append((p - int(block.first[r]), words[w]))
                out = []
                for r in range(block.rows):
                    first, n = int(block.first[r]), int(block.first[r + 1] - block.first[r])
                    labels, score = (
                        index.match(hits[r], lambda i, first=first: word_at(first + i), n) if r in hits else (set(), 0.0)
                    )
                    places = [p for p, _ in base.get(r, ())]
                    own = {label for _, label in base.get(r, ())}
                    out.append(
                        (n, len(places), min(places, default=None), max(places, default=None),
                         ",".join(sorted(own)), ",".join(sorted(own | labels)), score)
                    )
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(block.row, block.rows),
                        *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                    ],
                    ["doc_id", *NAMES],
                )

    return task


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(
    docs: DataFrame,
    templates=TEMPLATES,
    rare: int = RARE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    texts = common.id_and_text(docs, id_column, text_column)
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    index = Index(templates, document_frequencies(texts, vocabulary), rare)
    index.postings = dict(index.postings)
    schema = T.StructType().add("doc_id", texts.schema["doc_id"].dataType)
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType()]
    for name, kind in zip(NAMES, kinds, strict=True):
        schema = schema.add(name, kind)
    return texts.mapInArrow(_scan_task(index), schema)
