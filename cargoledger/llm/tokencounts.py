"""Token counts behind a digest cache.

The cache is a written folder: per tokenizer version, the SHA-256 of a text's normal form and its number
of tokens. A run joins the digests of all rows to the stored counts, encodes each distinct text that
the cache lacks once, appends those counts, and joins the counts to all rows. A version is the digest of
the tokenizer's file, its library and the library's version, so none of them can change unnoticed.

The normal form is what a text may be changed to without a change of its count: null becomes empty, and
for sentencepiece models, which write a space as U+2581, that character becomes a space.

* Digests, byte lengths, the misses and the final join are built-in expressions; only texts that
  miss reach Python. Of equal texts the row with the least id brings the text, by a join on id and digest, so a
  hot text neither fills a task nor is encoded per copy; with few misses the planner broadcasts them and
  no text is shuffled.
* A long text is cut before spaces into parts of about `PART` code points wherever no piece of the
  model could span the cut (`cuts_at_spaces`); counts add up to those of the whole text, and memory stays
  bounded but for a single word's length.
* The cache is only ever appended to. A digest written twice (two runs at once) holds the same count.

Rows. Null text: empty, no bytes, no tokens. Null and repeated ids are rows like any other; every row of the
table is in the result. An empty table gives an empty result and an empty cache. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger.llm import common

#: A count above this is over the limit, if no other is given.
LIMIT = 4096
#: Code points of a part of a long text; results do not depend on it.
PART = 1 << 16
#: Raise it when the normal form changes.
NORMAL_FORM = "1"
COUNTS = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Hex digest of everything that decides a count besides the text."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    parts = (Path(path).read_bytes(), library.__name__.encode(), library.__version__.encode(), NORMAL_FORM.encode())
    return hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()


def normal_form(text: Column, path: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.translate(text, "▁", " ") if path.endswith(".model") else text


def cuts_at_spaces(model) -> bool:
    """Whether no piece holds a space behind another character, so that none can span a cut before a space."""
    pieces = (model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return not any("▁" in p for p in pieces)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Pieces of a text, cut at a space that follows another character.

    The space at a cut is left out: the model puts one before whatever it encodes.
    """
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and text[cut - 1] == " ":  # a run of spaces stays together
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 == len(text):  # nor is a last space left out
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts by the library that the file belongs to; loaded once per worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        cut = cuts_at_spaces(model)

        def by_pieces(texts: list[str]) -> list[int]:
            found = []
            for text in texts:
                each = list(parts(text)) if cut and len(text) > PART else [text]
                found.append(sum(map(len, model.encode(each, num_threads=1))))
            return found

        return by_pieces
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(x, add_special_tokens=False)) for x in texts]


def _encode_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counter(path), None
        for batch in batches:
            digests = batch["digest"].to_pylist()
            # rows repeated as a whole stand side by side after a sorted join
            new = [k for k, d in enumerate(digests) if d != (digests[k - 1] if k else last)]
            last = digests[-1] if digests else last
            counts: list[int] = []
            for at in range(0, len(new), 64):
                counts += count([batch["text"][k].as_py() for k in new[at : at + 64]])
            yield pa.RecordBatch.from_arrays(
                [batch["digest"].take(pa.array(new, pa.int64())), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return task


def read_cache(like: DataFrame, folder: str, version: str) -> DataFrame:
    """Stored counts of a tokenizer version, one per digest; an empty frame where there are none."""
    spark, path = like.sparkSession, f"{folder}/{version}"
    known = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def addressed(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text in normal form, its digest, and the bytes of the text as given."""
    rows = common.id_and_text(docs, id_column, text_column)
    bytes_ = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = rows.select("doc_id", bytes_.alias("n_bytes"), normal_form(F.col("text"), path).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct digests that the cache lacks, each with the least id that has it."""
    each = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return each.join(cache, "digest", "left_anti")


def update_cache(
    docs: DataFrame, folder: str, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, int]:
    """Append the counts the cache lacks; returns doc_id, digest and n_bytes of all rows, and the number encoded."""
    version = tokenizer_version(path)
    texts = addressed(docs, path, id_column, text_column)
    rows = common.stored(texts.drop("text"), "digests")
    wanted = common.stored(misses(rows, read_cache(docs, folder, version)), "misses")
    n = wanted.count()
    t, w = texts.alias("t"), wanted.alias("w")
    same = (F.col("t.digest") == F.col("w.digest")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    found = t.join(w, same).select("t.digest", "t.text").mapInArrow(_encode_task(path), COUNTS)
    if n:
        found.write.mode("append").parquet(f"{folder}/{version}")
    return rows, n


def count_tokens(
    docs: DataFrame,
    folder: str,
    path: str,
    limit: int = LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, digest, n_bytes, n_tokens, over_limit for every row; the cache in `folder` is brought up to date."""
    rows, _ = update_cache(docs, folder, path, id_column, text_column)
    # as a stored table, so that adaptive execution can split the rows of a hot text in the join
    counts = common.stored(read_cache(docs, folder, tokenizer_version(path)), "counts")
    return rows.join(counts, "digest").select(
        "doc_id", "digest", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
