"""The queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprints, licenses, neardup, packing, quality, secrets, spm, warc
from .common import new_folder


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; another folder can be given to the operators themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.cut_documents(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return packing.pack(cut.select("doc_id", "draw", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archive")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    captures = warc.resolve_revisits(warc.assemble(warc.read_records(spark, folder, with_payload=False)))
    number = lambda c: F.try_cast(warc.field(F.col(c), "capture-id"), "long") if hasattr(F, "try_cast") else warc.field(F.col(c), "capture-id").try_cast("long")
    return captures.select(
        number("fields").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_fields")).alias("refers_to"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False))  # a null doc_id is not held out
    weights = quality.train(docs, labels.filter(quality.fold(F.col("doc_id")) != 0))
    score = quality.score_column(weights)
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spm.count_documents(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), budget=4096)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "budget_chars")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = spm.encode_documents(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(_documents(spark, sf_dir))
    kinds = [r.kind for r in secrets.BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secret_scan": op9_secret_scan,
    "op10_fingerprints": op10_fingerprints,
    "pipeline": pipeline,
}

_GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _license_sql() -> str:
    """The scan without filters: every block against every template and its rivals, and every place of every phrase."""
    phrases = ", ".join(f"({words.split()!r}, '{label}')" for words, label in licenses.PHRASES)
    templates = ", ".join(f"({i}, '{label}', {sorted(set(words.split()))!r}, {licenses.half_window(words)})" for i, (words, label) in enumerate(licenses.TEMPLATES))
    need = "CAST(ceil(0.8 * len({0}) - 1e-9) AS INT)"
    common = "len(list_intersect({0}, {1}))"
    share = "CASE WHEN len({0}) = 0 THEN 0.0 ELSE len(list_intersect(ws, {0})) / len({0}) END"
    return f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_GAP}') AS ws FROM documents),
        ph AS (SELECT * FROM (VALUES {phrases}) v(p, label)),
        tp AS (SELECT * FROM (VALUES {templates}) v(t, label, tokens, half)),
        rival AS (
            SELECT a.t, b.t AS r, [x FOR x IN a.tokens IF NOT list_contains(b.tokens, x)] AS own, [x FOR x IN b.tokens IF NOT list_contains(a.tokens, x)] AS others
            FROM tp a JOIN tp b ON a.label <> b.label AND {common.format('a.tokens', 'b.tokens')} >= ceil(0.8 * least(len(a.tokens), len(b.tokens)) - 1e-9)),
        word AS (SELECT doc_id, ws, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
        hit AS (SELECT doc_id, pos, label FROM word JOIN ph ON word = p[1] AND ws[pos + 1 : pos + len(p)] = p),
        base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list(DISTINCT label)) AS labels FROM hit GROUP BY doc_id),
        tok AS (SELECT DISTINCT half, unnest(tokens) AS word FROM tp),
        held AS (
            SELECT doc_id, half, b AS block, list(DISTINCT word) AS ws
            FROM (SELECT doc_id, half, word, unnest([pos // half, pos // half - 1]) AS b FROM word JOIN tok USING (word)) WHERE b >= 0 GROUP BY ALL),
        met AS (
            SELECT held.*, t, label, {common.format('ws', 'tokens')} / len(tokens) AS share FROM held JOIN tp USING (half) WHERE {common.format('ws', 'tokens')} >= {need.format('tokens')}
            AND NOT EXISTS (SELECT 1 FROM rival WHERE rival.t = tp.t AND {common.format('held.ws', 'own')} < ceil(0.8 * len(own) - 1e-9))),
        lost AS (
            SELECT a.doc_id, a.half, a.block, a.t FROM met a JOIN met b ON a.doc_id = b.doc_id AND a.half = b.half AND a.block = b.block JOIN rival ON rival.t = a.t AND rival.r = b.t
            WHERE {share.format('others').replace('ws', 'a.ws')} > {share.format('own').replace('ws', 'a.ws')}),
        best AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS found FROM met ANTI JOIN lost USING (doc_id, half, block, t) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(labels, ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ','), '') AS labels,
            CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
        FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN best ON best.doc_id = w.doc_id
    """


def _warc_sql() -> str:
    """What the archive has to give back, from the pages themselves. SHA-1 goes to base32 forty bits at a time."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(p.h, {at}, 10) AS BIGINT) >> {shift}) & 31) AS INT) + 1, 1)"
    digest = " || ".join(digit.format(at=1 + 10 * i, shift=35 - 5 * j) for i in range(4) for j in range(8))
    return f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY h, n ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY h, n) AS keeper FROM p)
        SELECT page_id, p.n AS payload_bytes, {digest} AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN keeper END AS refers_to
        FROM k AS p
    """


ORACLE_SQL = {
    "op1_license_scan": _license_sql(),
    "op5_warc": _warc_sql(),
    "op2_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents),
        best AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
            FROM norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM best
    """,
}
