"""op1 to op13 as registered queries with production parameters, and their DuckDB twins where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, divergence, fim, langid, license_scan, linefreq, minhash, mixing, multi_index, multihash, ngram_lm, tokenfile, warc
from sessionloom.llm.common import fresh_dir


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the documents that aren't held out, predict all."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (langid.bucket("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its domain, tokens and the copies that the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "copies"
    )


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8, one row per document."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, threshold=0.8)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = fresh_dir(spark, "token-files")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return tokenfile.read_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and text."""
    done = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base places and licence spans."""
    found = license_scan.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.to_json("spans").alias("spans"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whatever their labels, linked at cosine 0.9."""
    found = multi_index.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    found = linefreq.drop_boilerplate(table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return found.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return multihash.fingerprints(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back through the index."""
    path = fresh_dir(spark, "archives")
    index = warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and each source's own terms."""
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and rearranged; digests of the output and of the text rebuilt from it."""
    done = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", ngram_lm.bucket("doc_id") == 2)
    model = ngram_lm.train(docs, ~F.col("held_out"))
    scored = ngram_lm.score(docs, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mix_sources, op3_minhash_dedup, op4_token_files, op5_bpe, op6_licence_scan, op7_vector_dedup, op8_line_dedup, op9_fingerprints, op10_warc, op11_source_divergence, op12_fill_in_middle, op13_lm_scoring)}
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id OR d.payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first = d.page_id OR d.payload_bytes < 100 THEN NULL ELSE f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
ORACLE_SQL = {"op10_warc": OP10_SQL, "op11_source_divergence": divergence.oracle(), "op12_fill_in_middle": fim.oracle(), "op2_mix_sources": mixing.oracle(), "op8_line_dedup": linefreq.oracle(0.1, 3)}
