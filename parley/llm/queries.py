"""The queries of this package over the driver tables, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import audio, bpe, contamination, divergence, langid, merkle, mixing, nndescent, scoring, simhash, suffixes, toxicity, warc
from .common import remainder, remove_folder, shared_folder, table
from ..session import cut_lineage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


@query()
def op1_language(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(remainder(F.col("doc_id"), 5) != 0))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "distance", "rejected")


@query()
def op2_simhash(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op3_toxicity(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, toxicity.labelled(docs, labels))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("evidence").alias("n_evidence"))


@query()
def op4_audio(spark, folder) -> DataFrame:
    clips = audio.as_clips(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    clips = clips.withColumns({"media_bytes": F.octet_length("clip").cast("long"), "media_sha256": F.sha2("clip", 256)})
    return audio.features(clips).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
                                        "media_sha256", "feature")


@query(mixing.SQL)
def op5_mixing(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.curriculum(docs).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_bpe(spark, folder) -> DataFrame:
    import public_tokenizers as public

    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path, pattern).drop("text"), path, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op7_nndescent(spark, folder) -> DataFrame:
    found = nndescent.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept", "recall")


@query(warc.SQL)
def op8_warc(spark, folder) -> DataFrame:
    archive, parsed = shared_folder(spark), shared_folder(spark)
    warc.write(table(spark, folder, "pages"), archive)
    found = warc.records(spark, archive)
    page = F.regexp_extract(F.col("payload").cast("string"), r"page_id: (-?\d+)", 1)
    found = found.select("type", "record_id", "concurrent_to", "refers_to", F.octet_length("payload").cast("long").alias("n"),
                         F.sha1("payload").alias("digest"), F.when(F.col("type") == "metadata", page).alias("page"))
    found.write.parquet(parsed)
    c = warc.resolved(spark.read.parquet(parsed))
    number = lambda x: F.when(x != "", x).cast("long")
    full = F.coalesce(F.col("original.response"), F.col("response"))
    out = c.select(number(F.col("metadata.page")).alias("page_id"), full["n"].alias("payload_bytes"), full["digest"].alias("payload_digest"),
                   F.col("type").alias("record_type"), number(F.col("original.metadata.page")).alias("refers_to"))
    out = cut_lineage(out)
    remove_folder(spark, archive)
    remove_folder(spark, parsed)
    return out


@query()
def op9_mixing_scores(spark, folder) -> DataFrame:
    return scoring.scored(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op10_suffixes(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffixes.without_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(merkle.SQL)
def op11_merkle(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select(*merkle.COLUMNS)
    # a null id is never tampered with
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                      merkle.leaf_of([F.col(c) for c in merkle.COLUMNS[:-1]] + [merkle.lower_ascii(F.col("text"))]))
    found = merkle.manifest(docs, carry={"tampered": tampered})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


@query(divergence.SQL)
def op12_divergence(spark, folder) -> DataFrame:
    return divergence.divergences(table(spark, folder, "documents").select("lang", "source", "text"))


@query(contamination.SQL)
def op13_contamination(spark, folder) -> DataFrame:
    found = contamination.matches(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
