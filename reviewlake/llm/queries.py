"""The operators over the given tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import (bpe_lexicon, chat_log, cover_dedup, entropy_mix, language_kernel, merkle_manifest, minmax_dedup,
                            path_ranks, prefix_forest, pseudonyms, secret_ledger, simhash, warc_archive)
from reviewlake.llm.common import ranked, stored
from reviewlake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NEAR_BITS = 3
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, oracle: str | None = None):
    """Register a query, with its SQL if there is one."""
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_kernel.learn(docs, ~language_kernel.held_out())
    rows = docs.select("doc_id", language_kernel.held_out().alias("held_out"), "text")
    return language_kernel.predict(rows, model).drop("text")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe_lexicon.tokenized(docs, TOKENIZER, decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = stored(docs.select("doc_id", "source", entropy_mix.words_in(F.col("text")).alias("size")), "sizes")
    rows = entropy_mix.mixed(sizes, F.col("source"), F.col("size"), F.col("doc_id"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_pseudonyms")
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonyms.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", F.size("private").cast("long").alias("n_private"),
                       F.array_join("private", ",").alias("kinds"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited, links = simhash.edited_texts(docs)
    both = edited.select("id", "hash", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
    both = both.select("id", "hash", "edited_sha256", "v.which", "v.text")
    prints = simhash.fingerprints(both, ["id", "hash", "edited_sha256", "which"], "text")
    of = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    prints = stored(prints.groupBy("id", "hash", "edited_sha256").agg(
        of(0, "high").alias("high"), of(0, "low").alias("low"), of(1, "high").alias("high_e"), of(1, "low").alias("low_e")),
        "fingerprints")
    near = simhash.near_pairs(prints.select("high", "low"), radius=NEAR_BITS)
    ends = near.select(F.explode(F.array(F.struct(F.col("high_a").alias("h"), F.col("low_a").alias("l")),
                                         F.struct(F.col("high_b").alias("h"), F.col("low_b").alias("l")))).alias("p"))
    counts = ends.groupBy(F.col("p.h").alias("near_h"), F.col("p.l").alias("near_l")).agg(F.count("*").alias("n_near"))
    after = prints.select(F.col("id").alias("to_id"), F.col("hash").alias("to_hash"), F.col("high").alias("high_n"),
                          F.col("low").alias("low_n"))
    like = lambda h, l: simhash.likeness(F.col("high"), F.col("low"), F.col(h), F.col(l))
    found = (
        prints.join(links.withColumnsRenamed({"id": "k_id", "hash": "k_hash"}),
                    F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
        .join(after, F.col("next_id").eqNullSafe(F.col("to_id")) & (F.col("next_hash") == F.col("to_hash")))
        .join(counts, (F.col("high") == F.col("near_h")) & (F.col("low") == F.col("near_l")), "left")
        .select(F.col("id").alias("f_id"), F.col("hash").alias("f_hash"), F.col("n_chars").cast("long").alias("n_chars"),
                "edited_sha256", simhash.hexed(F.col("high"), F.col("low")).alias("fingerprint"),
                simhash.hexed(F.col("high_e"), F.col("low_e")).alias("edited_fingerprint"),
                like("high_e", "low_e").alias("near_edited"), like("high_n", "low_n").alias("near_next"),
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash"))).drop(
        "f_id", "f_hash", "hash")


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scratch_path(spark, "secret-ledger")
    secret_ledger.create_ledger(spark, ledger)
    secret_ledger.scan(docs, ledger)
    rows = secret_ledger.report(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, secret_ledger.BASE),
                       F.sha2(secret_ledger.joined("spans", secret_ledger.BASE), 256).alias("base_sha256"),
                       secret_ledger.joined("spans").alias("spans"))


@query("op8_warc", """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                      sha256(coalesce(html, '')) AS payload_digest FROM pages),
         g AS (SELECT *, CASE WHEN payload_bytes >= 100
                              THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
           CAST(NULL AS VARCHAR) AS problem
    FROM g""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_archive.write_archives(table(spark, sf_dir, "pages"), path)
    rows = warc_archive.read_archives(spark, path)
    whole = F.col("record_type") == "response"
    return rows.select(
        warc_archive.page_of(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc_archive.page_of(F.col("refers_to")).alias("refers_to"), "problem")


@query("op5_nearest")
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_repeats")
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cover_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


# A CRC-32 table, then the remainder bytewise: DuckDB has no such function.
CRC_SQL = """
    crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
    crcs AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                        lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc
             FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""


def leaf_sql(text: str) -> str:
    """SQL of a leaf of ``documents``."""
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op12_merkle_manifest", f"""
    WITH RECURSIVE {CRC_SQL},
    leaves AS (SELECT d.doc_id, coalesce('=' || lang, '') AS k, {leaf_sql('text')} AS leaf,
                      CASE WHEN crc % 3 = 0 THEN {leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf_sql('text')} END AS altered,
                      row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
               FROM documents d JOIN crcs USING (doc_id)),
    up AS (SELECT k, 0 AS lvl, i, n, leaf AS d FROM leaves
           UNION ALL
           SELECT k, lvl + 1, i // 8, max((n + 7) // 8), sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, lvl, i // 8),
    subs AS (SELECT k, lvl AS height, d AS subroot, row_number() OVER (ORDER BY k) - 1 AS j, count(*) OVER () AS m FROM up WHERE n = 1),
    top AS (SELECT 0 AS lvl, j AS i, m AS n, subroot AS d FROM subs
            UNION ALL
            SELECT lvl + 1, i // 8, max((n + 7) // 8), sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 8),
    mates AS (SELECT l.doc_id, u.lvl AS step,
                     coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i < l.i // (8 ** u.lvl)::BIGINT), '') AS before,
                     coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i > l.i // (8 ** u.lvl)::BIGINT), '') AS after
              FROM leaves l JOIN up u ON u.k = l.k AND u.n > 1 AND u.i // 8 = l.i // (8 ** (u.lvl + 1))::BIGINT GROUP BY ALL
              UNION ALL
              SELECT l.doc_id, s.height + t.lvl,
                     coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < s.j // (8 ** t.lvl)::BIGINT), ''),
                     coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > s.j // (8 ** t.lvl)::BIGINT), '')
              FROM leaves l JOIN subs s USING (k) JOIN top t ON t.n > 1 AND t.i // 8 = s.j // (8 ** (t.lvl + 1))::BIGINT GROUP BY ALL),
    fold AS (SELECT doc_id, 0 AS step, altered AS d FROM leaves
             UNION ALL
             SELECT f.doc_id, f.step + 1, sha256(m.before || f.d || m.after) FROM fold f JOIN mates m ON m.doc_id = f.doc_id AND m.step = f.step),
    proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM mates GROUP BY doc_id),
    ends AS (SELECT doc_id, max_by(d, step) AS folded_root FROM fold GROUP BY doc_id)
    SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
           folded_root = (SELECT d FROM top WHERE n = 1) AS verified
    FROM leaves JOIN subs USING (k) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in merkle_manifest.FIELDS} | {"text": F.translate("text", UPPER, LOWER)}
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle_manifest.leaf_digest(list(values.values())))
    rows = merkle_manifest.manifest(docs, carry={"altered": altered})
    mates = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(mates, 256).alias("proof_sha256"),
                       merkle_manifest.folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


# Fixed rows of the contract: a conversation whose texts are full of control strings.
PLANTED = "SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"


@query("op13_chat_format", rf"""
    WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                  UNION ALL {PLANTED.replace('-7L', '-7').replace('0L', '0').replace('1L', '1')}),
         sizes AS (SELECT *, length(regexp_replace(text, '{chat_log.ESCAPE}', '\1\\\2', 'g'))
                             + length(regexp_replace(role, '{chat_log.ESCAPE}', '\1\\\2', 'g'))
                             + {len(chat_log.TURN + chat_log.TEXT + chat_log.END)} AS chars FROM rows)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sizes GROUP BY conv_id""")
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PLANTED))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    messages = ranked(rows, order, "message").select(F.col("conv_id").alias("conv"), "message", "role", "text")
    log = stored(chat_log.logged(messages), "chat-log")
    output = stored(chat_log.rendered(chat_log.reconstructed(log)), "chat-output")
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    parts = chat_log.read_back(output).select(
        "conv", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.struct("part", F.array_join(F.transform("turns", line), "").alias("text")).alias("turns"),
        F.struct("part", F.array_join("learned", "").alias("text")).alias("learned"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda p: p["text"]), "")
    rows = parts.groupBy("conv").agg(F.sum("n").alias("n_turns"), whole("turns").alias("turns"), whole("learned").alias("learned"),
                                     F.sum("chars").alias("formatted_chars"))
    return rows.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


@query("op11_structure_repair")
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_ranks.report(table(spark, sf_dir, "conversations"))
