"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from certmill.llm import (
    bpe, exact_dedup, jaccard_join, language, lexical, mixing, packing, periodic_runs, pii, quality, secret_scan,
    token_counts, topk,
)

OVER_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern(), [F.col("doc_id")]
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_private(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), [F.col("doc_id")])
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, labels, F.col("source"), F.col("lang"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, [F.col("doc_id"), F.col("held_out")])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_join(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_products(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def repeating(doc_id: Column, text: Column) -> Column:
    """The text, in which every tenth document goes on by repeating a part of its own words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda x, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(x)
        return F.when(n > 0, F.array_join(F.transform(words, word), " ")).otherwise("")

    # The words are bound once, not found again for each word.
    found = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0)))
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(F.transform(found, again), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(docs, keep=["doc_id"])
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    order = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    most = F.array_min(F.transform("runs", order))
    return found.select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), most["s"].alias("start"), (-most["l"]).alias("length"),
        most["p"].alias("period"), F.floor(1000 * -most["l"] / most["p"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_byte_bpe, op3_pii, op4_token_counts, op5_quality, op6_language, op7_secrets,
        op8_jaccard_join, op9_packing, op10_exact_topk, op11_mixing, op12_lexical_search, op13_periodic_runs,
    )
}
