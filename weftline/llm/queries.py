"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, decontam, lines, neighbours, phrases, pieces, pii, quality, simhash, suffixes, urls, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and whether it is kept."""
    got = quality.quality(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a repeated string of 400 bytes, and whether it repeats anything: such bytes, or over 50 words of another document."""
    got = suffixes.without_repeats(table(spark, sf_dir, "documents"), words=suffixes.PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s.b - s.a))
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        "passage", (F.size("spans") > 0).alias("bytes_removed"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and how many spans of it there are in all."""
    got = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return got.select(
        F.col("id").alias("doc_id"), *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)),
        F.sha2(pii.spelled("base"), 256).alias("base_sha256"), pii.spelled("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: s.kind == pii.SECRET)).cast("long").alias("n_secret"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return got.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and those that repeat an earlier line, or nearly."""
    got = lines.removed_lines(table(spark, sf_dir, "documents"), least_words=1)
    return got.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.overlaps(spark, docs, table(spark, sf_dir, "benchmark")).drop("text")
    return found.select(
        "doc_id", F.size("overlaps").cast("long").alias("n_overlaps"), (F.size("overlaps") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o.item_id))).alias("item_ids"),
        F.aggregate("overlaps", F.lit(0).cast("long"), lambda n, o: n + o.same).alias("n_words_same"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, looked up in the index by the key of its url and read back."""
    pages = table(spark, sf_dir, "pages")
    _, directory, folder = warc.archive(pages)
    got = warc.read_records(warc.lookup(pages.select(warc.url_key(F.col("url")).alias("key")), directory, folder), folder)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Verdict, host and path of the rules for pages.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back; conversation -1 says nothing but control strings."""
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    own = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))))).alias("t"))
    talks = table(spark, sf_dir, "conversations")
    kind = talks.schema["conv_id"].dataType, talks.schema["turn"].dataType
    own = own.select(F.lit(-1).cast(kind[0]).alias("conv_id"), F.col("t.turn").cast(kind[1]).alias("turn"), F.col("t.role").alias("role"), said.alias("text"))
    told = chat.digests(chat.format_conversations(talks.select("conv_id", "turn", "role", "text").unionByName(own)))
    return told.select(F.col("id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "violations")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text of every document."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    told = pieces.token_digests(pieces.decode(spark, ids, model))
    return told.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every fiftieth vector."""
    got = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whitened on its first 32 components; a deviation that doesn't fit a long is null."""
    got = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffixes": op2_suffixes,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_lines": op5_lines,
    "op6_warc": op6_warc,
    "op7_decontam": op7_decontam,
    "op8_urls": op8_urls,
    "op9_chat": op9_chat,
    "op10_pieces": op10_pieces,
    "op11_neighbours": op11_neighbours,
    "op12_phrases": op12_phrases,
    "op13_whitening": op13_whitening,
}
