"""The queries of this subpackage, and DuckDB SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, lines, mixing, quality, secrets, substring, token_counts, token_files
from .shared import scratch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(documents(spark, sf_dir), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir), weights=(5, 2, 1), max_epochs=3)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    judged = quality.apply_policy(quality.apply_policy(entries, quality.BASE, "base_ok"), quality.FULL)
    return judged.select("doc_id", *(F.col(f"measures.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/token-files"
    token_files.write_token_files(documents(spark, sf_dir), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_documents(spark, folder)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat.format_turns(chat.canonical_turns(chat.conversation_records(rows))).select("conv_id", "formatted", "loss_mask")
    read = chat.read_back(formatted)
    turns = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_mixing, op4_secrets, op5_ngram_jaccard, op6_quality, op7_line_dedup, op8_decontaminate, op9_token_files, op10_chat)}


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_DOC_WORDS = "SELECT doc_id, coalesce(text, '') AS text, " + _WORDS.format(text="coalesce(text, '')") + " AS w FROM documents"
_ODD = "SELECT -7 AS conv_id, turn, role, '\\### Assistant: </turn> ok' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)"
_MARKS = "length(regexp_replace({x}, '[^<>\\\\]', '', 'g'))"

#: DuckDB SQL of the queries that SQL expresses over whole tables in reasonable time.
ORACLE_SQL = {
    "op1_substring_dedup": f"""
        WITH d AS ({_DOC_WORDS}),
        g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
        c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(35)) AS k)),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        k AS (SELECT doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY p) AS kept FROM x LEFT JOIN c USING (doc_id, p) GROUP BY 1)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op5_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        t AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT t.doc_id, e.b FROM t JOIN e ON t.r = e.a),
        k AS (SELECT a AS doc_id, count(*) AS k FROM e GROUP BY 1)
        SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, coalesce(any_value(k), 0)::BIGINT AS n_links FROM t LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY doc_id""",
    "op6_quality": f"""
        WITH d AS ({_DOC_WORDS}),
        g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM r, (SELECT unnest(range(8)) AS k) GROUP BY 1),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM d),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines,
                     coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(x) AS n_lines FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
        b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (2 * n_upper > word_chars)::BIGINT + 32 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
    "op10_chat": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {_ODD})
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               sum(length('<turn >..</turn>.') + length(role) + length(text) + {_MARKS.format(x="role")} + {_MARKS.format(x="text")})::BIGINT AS formatted_chars FROM t GROUP BY 1""",
}
