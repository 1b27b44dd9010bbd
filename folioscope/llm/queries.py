"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontam, exactdup, fim, hardneg, neardup, ngramjoin, pii, quality, secrets, sharding, tokenbin, toxicity
from folioscope.llm.common import table

#: Two regions of three racks of four shards: shards 0 to 23.
SHARD_TREE = sharding.ShardTree.even(2, 3, 4)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARD_TREE).select("doc_id", *sharding.OUTPUT)


def _digested(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The digest columns of a scan's spans."""
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[f"n_{k}" for k in kinds], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digested(pii.pii_spans(docs, keep=["doc_id"]), pii.BASE_KINDS)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digested(secrets.secret_spans(docs, keep=["doc_id"]), tuple(r.kind for r in secrets.BASE_RULES))


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, by n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _labelled(spark: SparkSession, sf_dir: str, label: str, learn: Column) -> DataFrame:
    """doc_id, text and y of the labelled rows that may be learned from."""
    rows = table(spark, sf_dir, "labels").filter(learn & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("y"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(rows, "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = quality.fit(_labelled(spark, sf_dir, "quality", _remainder(5) != 0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(_labelled(spark, sf_dir, "toxic", _remainder(4) != 2))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, toxicity_model(spark, sf_dir), keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_groups(docs).select("doc_id", *neardup.OUTPUT)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdup.exact_groups(docs).select("doc_id", *exactdup.OUTPUT)


def ranked_tokenizer(path: str | None = None) -> str:
    """The tokenizers definition of a rank file; read on the driver, and sent with the tasks."""
    return bpe.tokenizer_json_from_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs, ranked_tokenizer(), public_tokenizers.PATTERN, decoded=True, keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenbin.token_files(docs, definition, public_tokenizers.PATTERN, end_id=2)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.fill_in_middle(docs)
    digest = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (fim.restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digest)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngramjoin.ngram_components(docs).select("doc_id", *ngramjoin.OUTPUT)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_pii": op2_pii,
        "op3_secrets": op3_secrets,
        "op4_quality": op4_quality,
        "op5_near_dedup": op5_near_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_token_files": op8_token_files,
        "op9_toxicity": op9_toxicity,
        "op10_decontamination": op10_decontamination,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_ngram_join": op12_ngram_join,
        "op13_hard_negatives": op13_hard_negatives,
    }
