"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_tools, cube_mix, decontaminate, embedding_dups, html_extract, license_scan, periodic_runs, quality_cnn, secret_scan, simhash, token_counts, vector_codes
from .storage import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.fingerprint_hex("fp").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    # A cache of a fixed name: what an earlier run over the same shared folder has counted is not encoded again.
    cache = f"{shared_dir(spark)}/orebody-cache/token_counts"
    counts = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache, limit=1024)
    return counts.withColumnRenamed("id", "doc_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_tools.turns_as_messages(_table(spark, sf_dir, "conversations"))
    found = chat_tools.link(chat_tools.calls_of(messages), chat_tools.results_of(messages), chat_tools.sentence_tools(spark))
    return found.withColumnRenamed("conv", "conv_id")


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_cnn.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, net)
    return scored.select(
        "doc_id", quality_cnn.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cube_mix.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_report(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy"
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=13, share=20)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dups.embedding_groups(_table(spark, sf_dir, "embeddings"), least=0.95)
    return found.withColumnsRenamed({"id": "vec_id", "component": "component_id"})


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks), ranks)
    return back.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    return found.select(
        F.col("id").alias("doc_id"), "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return found.withColumnsRenamed({"id": "vec_id", "group_error": "label_error"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_chat_tools": op4_chat_tools,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_cube_mix": op6_cube_mix,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_embedding_dups": op9_embedding_dups,
    "op10_html_extract": op10_html_extract,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_scan.ORACLE_SQL,
    "op4_chat_tools": chat_tools.ORACLE_SQL,
    "op7_secrets": secret_scan.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op9_embedding_dups": embedding_dups.ORACLE_SQL,
    "op10_html_extract": html_extract.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
