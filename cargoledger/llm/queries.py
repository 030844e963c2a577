"""The registered queries of this subpackage, and their check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger.llm import (
    chat,
    common,
    filteraudit,
    latent,
    licenses,
    negatives,
    packing,
    quality,
    secrets,
    shards,
    simhash,
    substrings,
    tokencounts,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """File of a public tokenizer; installed with its library on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    archives = common.scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), archives)
    records = warc.read_archives(spark, archives, with_payload=False)
    return warc.resolve_revisits(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of the table: rows up to the middle id, then all, of which only unseen blobs are scanned."""
    docs, path = table(spark, folder, "documents"), common.scratch_path(spark, "ledger")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        secrets.update_ledger(docs.where(F.col("doc_id") <= (low + high) // 2), path)
    paths, ledger = secrets.update_ledger(docs, path)
    found = secrets.findings(paths, ledger)
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in secrets.BASE_RULES]))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(r.kind) for r in secrets.BASE_RULES),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("found")).alias("spans"),
    )


def op3_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    leaks = latent.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select(
        "doc_id", F.col("item").alias("item_id"), "common_words", "item_words", "answered"
    )


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op8_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(table(spark, folder, "documents"))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    path = tokenizer("byte_bpe_50k.json")
    return chat.digest(chat.store_formatted(given.union(more), path), path)


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(table(spark, folder, "embeddings")))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of the table: rows up to the middle id, then all, which finds the counts of the first."""
    docs, cache = table(spark, folder, "documents"), common.scratch_path(spark, "token-counts")
    path = tokenizer("piece_bpe_32k.model")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        tokencounts.update_cache(docs.where(F.col("doc_id") <= (low + high) // 2), cache, path)
    return tokencounts.count_tokens(docs, cache, path).drop("digest")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    "op1_warc_salvage": op1_warc_salvage,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_latent_decontamination": op3_latent_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_balanced_shards": op8_balanced_shards,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_warc_salvage": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html,
                   octet_length(encode(coalesce(html, ''))) AS n
            FROM pages
        ), h AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS head FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to
        FROM h
    """,
    "op5_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
        ),
        least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
        hits AS (SELECT doc_id, i FROM windows JOIN least USING (k) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + s AS i FROM hits, range(50) t(s)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_quality_rules": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10))
                    IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
            FROM documents
        ),
        windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n
            FROM (
                SELECT doc_id, i, w[i:i + 4] AS k
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
            )
        ),
        repeats AS (
            SELECT doc_id, count(DISTINCT i + s) AS n
            FROM windows, range(5) t(s) WHERE n > 1 GROUP BY doc_id
        ),
        m AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(n, 0)::BIGINT AS n_repeat_words,
                   len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '[0-9]')) AS digits
            FROM d LEFT JOIN repeats USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
                    OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 2 * capitals > word_chars OR 2 * digits > word_chars) AS kept
        FROM m
    """,
    "op9_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        e AS (
            SELECT *, length(regexp_replace(role, '(\\*)(<turn>|<say>|</turn>)', '\1\1\\\2', 'g'))
                    + length(regexp_replace(text, '(\\*)(<turn>|<say>|</turn>)', '\1\1\\\2', 'g'))
                    + length('<turn><say></turn>') AS n
            FROM c
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                                          ORDER BY turn, role, text), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same,
                   list_inner_product(a.v, e.v)::BIGINT AS score
            FROM e JOIN e a ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
        ),
        p AS (
            SELECT * FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ),
        n AS (
            SELECT anchor_id, p.other_id AS positive_id, s.other_id AS negative_id,
                   p.score AS positive_score, s.score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS r
            FROM p JOIN s USING (anchor_id)
            WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
        )
        SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM n WHERE r <= 5
    """,
    "op13_filter_audit": f"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
        ),
        f AS (
            SELECT doc_id, part, concat(
                CASE WHEN len(w) < 50 THEN 'A' END,
                CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
                CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS mask
            FROM d
        ),
        l AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
            FROM labels GROUP BY doc_id
        ),
        m AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
            FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
        ),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ),
        s AS (
            SELECT filter_order, k::INTEGER AS step, filter_order[k] AS own, substr(filter_order, 1, k - 1) AS earlier
            FROM o, range(1, 6) r(k)
        ),
        c AS (
            SELECT *, contains(mask, own) AS fails, length(translate(mask, earlier, '')) < length(mask) AS gone
            FROM m, s
        ),
        g AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n_good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
                   coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
            FROM c GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM g
    """,
}
