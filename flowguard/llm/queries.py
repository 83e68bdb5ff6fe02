"""The corpus queries on the whole tables, each through its operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm import decontaminate, dialogue, language, mixing, oracle, paragraphs, pii, quality, sharding, simhash, urls, vectors, warc, wrappers
from flowguard.llm.common import table
from flowguard.session import cut_lineage, scratch_folder

#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the labelled rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op2_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`."""
    rows = table(spark, folder, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    return sharding.assign_shards(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The words that the mix takes of every document."""
    words = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    rows = cut_lineage(table(spark, folder, "documents").select("doc_id", "source", words.alias("size")))
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that a window of the benchmark hits."""
    found = decontaminate.find(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op5_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge_pages(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.group(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document, the classifier fitted on labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.train(docs, table(spark, folder, "labels")))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document, by pattern and by what terms reveal."""
    found = pii.detect(table(spark, folder, "documents").select("doc_id", "text"))
    base, added = F.col("base"), F.col("added")
    listed = F.concat_ws(",", F.transform(base, _span_text))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), F.concat_ws(",", F.transform(F.concat(base, added), _span_text)).alias("spans"))


def _span_text(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))


def op9_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that occur earlier, and the spans that were cut."""
    return paragraphs.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


def op10_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.extract_pages(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op11_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors from codebooks trained on all of them."""
    return vectors.compress(table(spark, folder, "embeddings"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    found = dialogue.digests(dialogue.repair(dialogue.damage(table(spark, folder, "conversations"))))
    return found.withColumnRenamed("conversation", "conv_id")


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as an archived record, read back from the archives."""
    with scratch_folder(spark) as archives:
        warc.write_archives(warc.plan_records(table(spark, folder, "pages")), archives)
        found = cut_lineage(warc.read_archives(spark, archives, payloads=False))
    refers = F.regexp_extract("refers_to", "^<urn:page:([^:]*):", 1)
    return found.select(F.col("identity").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
                        F.when(refers != "", refers).cast("bigint").alias("refers_to"))


QUERIES = {f.__name__: f for f in (op1_language, op2_shards, op3_mix, op4_decontaminate, op5_urls, op6_simhash, op7_quality, op8_pii,
                                  op9_passages, op10_pages, op11_codes, op12_conversations, op13_warc)}


def register(catalog) -> None:
    catalog.QUERIES.update(QUERIES)
    catalog.ORACLE.update(oracle.SQL)
