"""The operators as registered queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm import (
    bpe,
    clustering,
    decontamination,
    jaccard_join,
    language,
    line_dedup,
    pii,
    secrets,
    spotsigs,
    suffix_dedup,
    toxicity,
    unit_dedup,
    vector_codes,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", "text")


def _sha256(value: Column) -> Column:
    return F.sha2(F.encode(value, "utf-8"), 256)


def _joined(values: str) -> Column:
    return F.array_join(F.col(values).cast("array<string>"), ",")


def _crc(modulus: int) -> Column:
    """The remainder of the id's checksum; a row without an id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1))


def language_model(spark: SparkSession, folder: str) -> language.LanguageModel | None:
    rows = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.train(language.training_sample(rows.where(_crc(3) != 1)))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    found = language.identify(docs, language_model(spark, folder))
    return docs.select("doc_id", (_crc(3) == 1).alias("held_out"), found.alias("found")).select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.accepted").alias("accepted"),
    )


def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprints(_documents(spark, folder)).select(
        "doc_id",
        "n_chars",
        _sha256(F.col("edited")).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("signatures")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def tokenizer_path() -> str:
    """The public byte-level vocabulary, where the environment installs it on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path()
    encoded = bpe.encode(_documents(spark, folder), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256(_joined("ids")).alias("ids_sha256"),
        "ids",
    )
    return bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", "ids_sha256", _sha256(F.col("decoded")).alias("decoded_sha256")
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(
        _documents(spark, folder), _table(spark, folder, "benchmark")
    )
    named = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        _sha256(named).alias("items_sha256"),
        "contaminated",
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.drop_common_lines(_documents(spark, folder))
    return found.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, folder))


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.ToxicityModel | None:
    labels = _table(spark, folder, "labels").where(_crc(5) != 0)
    return toxicity.fit(_documents(spark, folder), labels)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    score = toxicity.score(docs, toxicity_model(spark, folder))
    return docs.select("doc_id", (_crc(5) == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def _cut_spans(found: DataFrame) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["stop"]))
    return found.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed"),
        _sha256(F.col("kept")).alias("kept_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _cut_spans(unit_dedup.remove_repeated_units(_documents(spark, folder)))


def op8_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _cut_spans(unit_dedup.remove_repeated_passages(_documents(spark, folder)))


def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, folder)).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """The counts are of base spans, as the base digest; ``spans`` also has those that the method adds."""
    found = pii.personal_data(_documents(spark, folder))
    base = F.filter("spans", lambda s: s["base"])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, _sha256(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(_table(spark, folder, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", _sha256(F.col("centroid")).alias("centroid_sha256")
    )


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(_table(spark, folder, "embeddings")).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256"
    )


def op13_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """The counts are of base spans; spans that the randomness tests add are of a kind of their own."""
    found = secrets.secrets(_documents(spark, folder))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in secrets.KINDS[:3]]
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *counts, _sha256(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_spotsigs": op2_spotsigs,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_pii": op10_pii,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scans": op13_secret_scans,
}
