"""Benchmark decontamination by latent semantic retrieval.

Texts have A-Z lower-cased; words are runs of ASCII digits and letters and of everything beyond
ASCII. Passages are windows of `PASSAGE` words, each half overlapping the next; a longer benchmark
item is cut into passages as well.

Method.
1. Terms are all words of the corpus and the benchmark, in `BUCKETS` buckets of their hash. A term's frequency is counted over the
   cells of half a passage of all documents; its weight is tf * (1 + log(cells / df)), so no word is without weight.
2. A randomised SVD of TF-IDF rows, of corpus cells and of benchmark passages (of unit length, so that each counts alike, with `SHARE`
   of the energy). Tasks add up A'(A R) for their rows and a fixed random matrix R; the sums give, by Nystroem's
   method, the leading right singular vectors: half as many axes as there are passages, `AXES` at most. Words that occur in the same
   contexts share axes, so a passage whose telling words were replaced by words of the same contexts stays close. All cells of all
   documents are rows of it.
3. Windows of documents are projected, and their cosine with a benchmark passage taken in that space; pairs of
   `COSINE` or more are candidates.
4. A candidate is verified on the words around: the longest common subsequence must cover `EXACT` of
   the benchmark passage, or, for a paraphrase, `NEAR` of it while the answer is found too. The
   answer is the answer column, if one is named, else the item's last sentence; it is found
   if `ANSWER` of its words stand in the same window in order.

* What step 4 could never verify is not projected. A passage of n words shares at least NEAR * n with a leak of it; so of
  its rarest n - NEAR * n + t words t at least stand in the window's surroundings. An inverted list of those words counts them per
  window and passage; the rest has too few. No leak is lost by it, whatever the frequencies.
* Passages are cut in Spark, stored, and searched in blocks of about `ITEMS`, each over all documents; frequencies and basis are
  worked out once for all blocks. What goes to the driver and to every task is bounded by `BUCKETS`, `AXES` and `ITEMS`.
* Documents are never shuffled. The sums of steps 1 and 2 travel as `SLICES` rows per task; a task of step 2 reads about `FITTED` bytes.

Rows. Null text: no words. Null id: hits carry it as null. Repeated rows: hits of each. Benchmark rows
without words are never found; ids of items can be of any type. An empty benchmark or empty input gives no hits. Extra columns are
ignored by `find_leaks`, and carried by `remove_leaks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm import common
from cargoledger.llm.words import NOT_ALPHANUMERIC, Block, blocks, mix

PASSAGE = 64
CELL = PASSAGE // 2
COSINE = 0.35
EXACT, NEAR, ANSWER = 0.8, 0.6, 0.8
SHARE = 0.5
AXES, SPARE = 64, 16
BUCKETS = 1 << 15
SLICES = 64
#: Tasks that the rows of the SVD are dealt to at least, and bytes of text that one of them reads: each sends one matrix of sums.
FITTING, FITTED = 16, 64 << 20
#: Rows that are added up one by one at most, and such sums worked out side by side.
PIECE, GATHERED = 32, 2048
#: Words of documents whose rows are added at a time.
WORDS = 1 << 20
#: Passages searched at a time.
ITEMS = 4096
#: Pairs of word and passage looked at together.
PAIRS = 1 << 21
#: Terms are found by this many low bits of their hash.
BITS = 20


@dataclass
class Passage:
    key: int
    words: np.ndarray  # hashes
    answer: np.ndarray

    @property
    def need(self) -> int:
        """Words that a leak shares with it at least."""
        return ceil(NEAR * len(self.words))

    @property
    def hits(self) -> int:
        """How many of its rarest words are asked for near a window."""
        return max(1, self.need // 3)


def word_lists(texts: list[str]) -> list[np.ndarray]:
    out = []
    for block in blocks(pa.array(texts, pa.string()), NOT_ALPHANUMERIC, lower=True):
        hashes = block.word_hashes()
        out += [hashes[a:b] for a, b in zip(block.first, block.first[1:], strict=False)]
    return out


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"[.!?\n]+", text or "") if re.search(r"\w", p)]
    return parts[-1] if parts else ""


def _passage_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, own = batch["text"].to_pylist(), batch["answer"].to_pylist()
        answers = word_lists([a if a is not None else last_sentence(t) for a, t in zip(own, texts, strict=True)])
        rows, words_of, answer_of = [], [], []
        for r, words in enumerate(word_lists([t or "" for t in texts])):
            for k in range(0, max(len(words) - CELL, 1), PASSAGE):
                rest = len(words) - k <= PASSAGE + CELL
                part = words[k:] if rest else words[k : k + PASSAGE]
                if len(part):
                    rows.append(r)
                    words_of.append(part.tobytes())
                    answer_of.append(answers[r].tobytes())
                if rest:
                    break
        yield pa.RecordBatch.from_arrays(
            [batch["item"].take(pa.array(rows, pa.int64())), pa.array(words_of, pa.binary()), pa.array(answer_of, pa.binary())],
            ["item", "words", "answer"],
        )


def benchmark_passages(
    benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", answer_column: str | None = None
) -> DataFrame:
    """key, item, words and answer (hashes, as bytes) of every passage; written, so that keys stay."""
    answer = F.col(answer_column) if answer_column else F.lit(None)
    named = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).alias("text"), answer.cast("string").alias("answer"))
    schema = T.StructType().add("item", named.schema["item"].dataType).add("words", T.BinaryType()).add("answer", T.BinaryType())
    cut = named.mapInArrow(_passage_task, schema)
    return common.stored(cut.withColumn("key", F.monotonically_increasing_id()), "passages")


def read_passages(rows: DataFrame) -> list[Passage]:
    """A block of passages, on the driver."""
    found = rows.select("key", "words", "answer").collect()
    words = [Passage(r["key"], *(np.frombuffer(r[c], np.uint64) for c in ("words", "answer"))) for r in found]
    return sorted(words, key=lambda p: p.key)


class Terms:
    """Numbers of known words, by the low bits of their hash and then exactly."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)

    def table(self) -> np.ndarray:
        table = np.full(1 << BITS, -1, np.int32)
        low = (self.hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)
        table[low] = np.arange(len(self.hashes))
        self.clash = np.flatnonzero(table[low] != np.arange(len(self.hashes)))
        return table

    def numbers(self, table: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Term of each word, -1 for others."""
        number = table[(words & np.uint64((1 << BITS) - 1)).astype(np.int64)]
        wrong = (number >= 0) & (self.hashes[number] != words)
        number[wrong] = -1
        if len(self.clash) and wrong.any():
            at = np.flatnonzero(wrong)
            slot = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
            same = self.hashes[slot] == words[at]
            number[at[same]] = slot[same]
        return number


def cells_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each word, and the first cell of each row (and the end)."""
    per_row = -(-np.diff(block.first) // CELL)
    first = np.concatenate([[0], np.cumsum(per_row)])
    counts = np.diff(block.first)
    place = np.arange(block.first[-1]) - np.repeat(block.first[:-1], counts)
    return np.repeat(first[:-1], counts) + place // CELL, first


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """Term of each word."""
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _sliced(values: np.ndarray, name: str, end: int) -> pa.RecordBatch:
    """An array by buckets as `SLICES` rows, and a number `end` in a row of its own."""
    parts = [p.tobytes() for p in np.split(values, SLICES)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(SLICES + 1), pa.int32()), pa.array([*parts, np.array([end], values.dtype).tobytes()], pa.binary())],
        ["slice", name],
    )


def _sum_task(name: str, kind: str):
    """Adds up rows of equal slice as they stream by."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in zip(batch["slice"].to_pylist(), batch[name], strict=True):
                values = np.frombuffer(part.as_buffer(), kind)
                total[number] = total[number] + values if number in total else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", name]
        )

    return task


def _added(parts: DataFrame, name: str, kind: str) -> tuple[np.ndarray, float]:
    """Sums of all tasks: the whole array, and that of the numbers `end`."""
    rows = parts.repartition("slice").mapInArrow(_sum_task(name, kind), f"slice int, {name} binary").collect()
    found = {r["slice"]: np.frombuffer(r[name], kind) for r in rows}
    if not found:
        return np.zeros(0, kind), 0
    return np.concatenate([found[k] for k in range(SLICES)]), float(found[SLICES][0])


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, cells = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for block in blocks(batch["text"], NOT_ALPHANUMERIC, lower=True):
            cell, first = cells_of(block)
            cells += int(first[-1])
            pairs = np.sort(cell * BUCKETS + buckets_of(block.word_hashes()))
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            counts += np.bincount(pairs[new] % BUCKETS, minlength=BUCKETS)
    yield _sliced(counts, "counts", cells)


def term_weights(texts: DataFrame) -> np.ndarray:
    """1 + log(cells / df) per term, never 0, over all rows."""
    df, cells = _added(texts.select("text").mapInArrow(_count_task, "slice int, counts binary"), "counts", "i8")
    if not len(df):
        df = np.zeros(BUCKETS, np.int64)
    return (1 + np.log((max(cells, 1) + 1) / np.maximum(df, 1))).astype(np.float32)


def random_matrix(columns: int) -> np.ndarray:
    """Fixed signs, one row per term."""
    terms = np.arange(BUCKETS, dtype=np.uint64)
    bits = [mix(mix(terms + np.uint64(1)) + np.uint64(k)) for k in range(-(-columns // 64))]
    signs = np.unpackbits(np.stack(bits, 1).view(np.uint8), axis=1)[:, :columns]
    return signs.astype(np.float32) * 2 - 1


def gathered(values: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[at] over the runs of `at` that begin at `first`.

    Runs are cut into pieces of `PIECE` at most. Pieces of like length are added up side by side, some hundred at a time, so
    that their sums stay in the cache."""
    length = np.diff(first, append=len(at))
    pieces = -(-length // PIECE)
    head = np.cumsum(pieces) - pieces
    skipped = PIECE * (np.arange(pieces.sum()) - np.repeat(head, pieces))
    start, size = np.repeat(first, pieces) + skipped, np.minimum(np.repeat(length, pieces) - skipped, PIECE)
    order = np.argsort((PIECE - size).astype(np.uint8), kind="stable")
    sums = np.empty((len(size), values.shape[1]), values.dtype)
    room = np.empty((2, min(GATHERED, len(size)), values.shape[1]), values.dtype)
    for k in range(0, len(size), GATHERED):
        some = order[k : k + GATHERED]
        begin, shorter = start[some], -size[some]
        total = np.take(values, at[begin], axis=0, out=room[0, : len(some)], mode="clip")
        for step in range(1, -int(shorter[0])):
            n = int(np.searchsorted(shorter, -step))
            total[:n] += np.take(values, at[begin[:n] + step], axis=0, out=room[1, :n], mode="clip")
        sums[some] = total
    return np.add.reduceat(sums, head, axis=0) if len(sums) > len(first) else sums


class Sketch:
    """A'(A R) of TF-IDF rows as they come, and their energy."""

    def __init__(self, weights: np.ndarray, columns: int):
        self.weights, self.weighted = weights, random_matrix(columns) * weights[:, None]
        self.total, self.energy = np.zeros((BUCKETS, columns), np.float32), 0.0

    def add(self, term: np.ndarray, row: np.ndarray, unit: bool = False) -> None:
        """Words with their term and their row, rows ascending; of unit length if asked for.

        A word that a row has twice counts twice in the product on either side, so words need not be counted for that."""
        if not len(term):
            return
        first = np.flatnonzero(np.diff(row, prepend=-1))
        sums, at = gathered(self.weighted, term, first), np.repeat(np.arange(len(first)), np.diff(first, append=len(row)))
        order = np.argsort(term.astype(np.uint16), kind="stable")
        term, at = term[order].astype(np.int64), at[order]
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
        squares = (np.diff(new, append=len(term)) * self.weights[term[new]]) ** 2
        if unit:
            length = np.bincount(at[new], squares, len(first))
            sums /= length[:, None].astype(np.float32)
            squares = squares / length[at[new]]
        self.energy += float(squares.sum())
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.total[term[first]] += gathered(sums, at, first) * self.weights[term[first], None]


def _sketch_task(weights: np.ndarray, columns: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(weights, columns)
        term, row, words, rows = [], [], 0, 0
        for batch in batches:
            for block in blocks(batch["text"], NOT_ALPHANUMERIC, lower=True):
                cell, first = cells_of(block)
                term.append(buckets_of(block.word_hashes()).astype(np.uint16))
                row.append(cell + rows)
                words, rows = words + len(cell), rows + int(first[-1])
                if words >= WORDS:  # the more at once, the fewer sums of a few rows
                    sketch.add(np.concatenate(term), np.concatenate(row))
                    term, row, words, rows = [], [], 0, 0
        if words:
            sketch.add(np.concatenate(term), np.concatenate(row))
        yield _sliced(sketch.total, "sums", sketch.energy)

    return task


def _passage_sketch_task(weights: np.ndarray, columns: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(weights, columns)
        for batch in batches:
            words = [np.frombuffer(w, np.uint64) for w in batch["words"].to_pylist()]
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            sketch.add(buckets_of(np.concatenate(words)) if words else row, row, unit=True)
        yield _sliced(sketch.total, "sums", sketch.energy)

    return task


def latent_basis(texts: DataFrame, passages: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the stacked rows, a column each."""
    axes = max(1, min(AXES, ceil(passages.count() / 2)))
    columns, schema = axes + SPARE, "slice int, sums binary"
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = texts.select("text").coalesce(max(FITTING, ceil(size / FITTED)))
    corpus, energy = _added(rows.mapInArrow(_sketch_task(weights, columns), schema), "sums", "f4")
    own, own_energy = _added(
        passages.repartition(FITTING).mapInArrow(_passage_sketch_task(weights, columns), schema), "sums", "f4"
    )
    # in place where it can be: the driver holds few matrices of BUCKETS rows at once
    sketch = own.reshape(BUCKETS, columns) * (SHARE / max(own_energy, 1.0))
    if len(corpus) and energy:
        sketch += corpus.reshape(BUCKETS, columns) * ((1 - SHARE) / energy)
    del own, corpus
    # Nystroem: M ~ Y (R'Y)^-1 Y', made safe by a small shift
    matrix = random_matrix(columns).astype(np.float64)
    sketch = sketch.astype(np.float64)
    sketch += 1e-7 * np.linalg.norm(sketch) * matrix
    core = matrix.T @ sketch
    del matrix
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 0) * 1e-10
    factor = sketch @ (vectors[:, keep] / np.sqrt(values[keep]))
    # its left singular vectors, by way of the small product of its columns
    squares, right = np.linalg.eigh(factor.T @ factor)
    first = [k for k in np.argsort(-squares)[:axes] if squares[k] > squares.max() * 1e-12]
    return (factor @ (right[:, first] / np.sqrt(squares[first]))).astype(np.float32)


def common_subsequence(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of the first."""
    masks: dict[int, int] = {}
    for k, word in enumerate(one.tolist()):
        masks[word] = masks.get(word, 0) | 1 << k
    row = every = (1 << len(one)) - 1
    for word in two.tolist():
        if mask := masks.get(word):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & every
    return len(one) - row.bit_count()


def verify(passage: Passage, region: np.ndarray) -> tuple[bool, int, bool]:
    """Whether a region holds a benchmark passage; length of the subsequence; answer found."""
    length = common_subsequence(passage.words, region)
    answered = len(passage.answer) > 0 and common_subsequence(passage.answer, region) >= ANSWER * len(passage.answer)
    share = length / len(passage.words)
    return share >= EXACT or (share >= NEAR and answered), length, answered


class Search:
    """A block of passages, made ready to be looked for in blocks of texts."""

    def __init__(self, passages: list[Passage], weights: np.ndarray, basis: np.ndarray):
        self.passages, self.weights = passages, weights
        self.projected = basis * weights[:, None]
        queries = [self.projected[buckets_of(p.words)].sum(0) for p in passages]
        self.queries = np.array([q / max(np.linalg.norm(q), 1e-30) for q in queries], np.float32)
        self.hits = np.array([p.hits for p in passages])
        # the rarest words of each passage, and for each such word the passages it is one of
        rare = [self._rarest(p) for p in passages]
        word = np.concatenate(rare)
        who = np.repeat(np.arange(len(passages)), [len(r) for r in rare])
        self.terms = Terms(word)
        self.table = self.terms.table()
        order = np.argsort(word, kind="stable")
        self.lists = who[order]
        self.at = np.concatenate([np.searchsorted(word[order], self.terms.hashes), [len(word)]])

    def _rarest(self, passage: Passage) -> np.ndarray:
        """Words of which a leak holds `hits` or more."""
        words = passage.words[np.lexsort((passage.words, -self.weights[buckets_of(passage.words)]))]
        return np.unique(words[: len(words) - passage.need + passage.hits])

    def windows(self, hashes: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows (their first cell) and passages with enough of the rare words around: a cell before to one behind."""
        number = self.terms.numbers(self.table, hashes)
        held = np.flatnonzero(number >= 0)
        count = self.at[number[held] + 1] - self.at[number[held]]
        total = np.cumsum(count)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ends = np.searchsorted(total, np.arange(PAIRS, total[-1] + PAIRS, PAIRS)) + 1 if len(held) else []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            own, size = number[held[a:b]], count[a:b]
            flat = np.arange(size.sum()) + np.repeat(self.at[own] - (np.cumsum(size) - size), size)
            parts.append(np.unique(self.lists[flat] * (cells + 4) + np.repeat(cell[held[a:b]], size) + 2, return_counts=True))
        pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([c for _, c in parts]), len(pairs)).astype(np.int64)
        most = np.concatenate([[0], np.cumsum(n)])
        # the cells of a passage's pairs stand next to each other, so the counts around a window are a difference of sums
        around = np.sort((pairs[:, None] + np.arange(-2, 2)).ravel())
        around = around[np.diff(around, prepend=-1) != 0]
        low, high = np.searchsorted(pairs, around - 1), np.searchsorted(pairs, around + 3)
        passage, window = around // (cells + 4), around % (cells + 4) - 2
        enough = (most[high] - most[low] >= self.hits[np.minimum(passage, len(self.hits) - 1)]) & (window >= 0) & (window < cells)
        return window[enough], passage[enough]

    def cosines(self, hashes: np.ndarray, block: Block, first: np.ndarray, window: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Cosine of each window with its passage in the latent space."""
        own, which = np.unique(window, return_inverse=True)
        row = np.searchsorted(first, own, side="right") - 1
        # a window is a cell and, if its row has one, the next
        more = own + 1 < first[row + 1]
        needed = np.zeros(int(first[-1]) + 1, bool)
        needed[own] = needed[own[more] + 1] = True
        cells = np.flatnonzero(needed)
        row = np.searchsorted(first, cells, side="right") - 1
        start = block.first[row] + (cells - first[row]) * CELL
        size = np.minimum(start + CELL, block.first[row + 1]) - start
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(start - begin, size)
        sums = gathered(self.projected, buckets_of(hashes[at]), begin)
        place = np.cumsum(needed) - 1
        out = sums[place[own]]
        out[more] += sums[place[own[more] + 1]]
        length = np.maximum(np.linalg.norm(out, axis=1), 1e-30)
        return np.einsum("ij,ij->i", out[which], self.queries[passage]) / length[which]


FOUND = ("text_hash", "key", "cosine", "common_words", "item_words", "answered", "start")


def _search_task(passages: list[Passage], weights: np.ndarray, basis: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(passages, weights, basis)
        for batch in batches:
            for block in blocks(batch["text"], NOT_ALPHANUMERIC, lower=True):
                hashes = block.word_hashes()
                cell, first = cells_of(block)
                window, passage = search.windows(hashes, cell, int(first[-1]))
                if not len(window):
                    continue
                cosine = search.cosines(hashes, block, first, window, passage)
                best: dict[tuple[int, int], tuple] = {}
                for i in np.flatnonzero(cosine >= COSINE).tolist():
                    c, q = int(window[i]), int(passage[i])
                    row = int(np.searchsorted(first, c, side="right")) - 1
                    start = int(block.first[row]) + (c - int(first[row])) * CELL
                    begin = max(start - CELL, int(block.first[row]))
                    region = hashes[begin : min(start + PASSAGE + CELL, int(block.first[row + 1]))]
                    ok, length, answered = verify(passages[q], region)
                    if ok and ((row, q) not in best or best[row, q][1] < length):
                        best[row, q] = (
                            float(cosine[i]), length, len(passages[q].words), answered, begin - int(block.first[row])
                        )
                if not best:
                    continue
                keys = sorted(best)
                rows = pa.array([block.row + r for r, _ in keys], pa.int64())
                found = list(zip(*(best[k] for k in keys), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(rows),
                        batch["text_hash"].take(rows),
                        pa.array([passages[q].key for _, q in keys], pa.int64()),
                        pa.array(found[0], pa.float64()),
                        pa.array(found[1], pa.int64()),
                        pa.array(found[2], pa.int64()),
                        pa.array(found[3], pa.bool_()),
                        pa.array(found[4], pa.int64()),
                    ],
                    ["doc_id", *FOUND],
                )

    return task


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    answer_column: str | None = None,
) -> DataFrame:
    """A row per document row and benchmark passage that it holds: doc_id, text_hash, item, cosine,
    common_words (of item_words), answered, and the word at which the window starts."""
    texts = common.id_and_text(docs, id_column, text_column).withColumn("text_hash", F.xxhash64("text"))
    schema = (
        T.StructType()
        .add("doc_id", texts.schema["doc_id"].dataType)
        .add("text_hash", T.LongType())
        .add("key", T.LongType())
        .add("cosine", T.DoubleType())
        .add("common_words", T.LongType())
        .add("item_words", T.LongType())
        .add("answered", T.BooleanType())
        .add("start", T.LongType())
    )
    passages = benchmark_passages(benchmark, item_column, item_text_column, answer_column)
    n = ceil(passages.count() / ITEMS)
    out = docs.sparkSession.createDataFrame([], schema)
    if n:
        weights = term_weights(texts)
        basis = latent_basis(texts, passages, weights)
    for k in range(n):
        block = read_passages(passages.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k))
        if block:
            out = out.union(texts.mapInArrow(_search_task(block, weights, basis), schema))
    items = passages.select("key", "item")
    return out.join(items, "key").select("doc_id", "text_hash", "item", *FOUND[2:])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that hold no benchmark passage, with all their columns."""
    leaks = find_leaks(docs, benchmark, id_column, text_column)
    bad = common.stored(leaks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    same = docs[id_column].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_column]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
