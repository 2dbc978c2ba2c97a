"""The thin queries over the training-data operators, with their results as the contracts name them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam, dedup_spans, html, langid, lm, mix, quality, resample, rules, sessions, simhash, tokens
from lodestone.llm.common import id_mod, table


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (id_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.KEEP_SCORE).cast("int").alias("predicted"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(spark, tokens.write(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans.deduplicate(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.filter(langid.training_fold()))
    return found.select("doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(r"SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.parse(chat.render(chat.reconstruct(chat.turn_events(rows))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_versions(sessions.turn_events(table(spark, sf_dir, "conversations")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_shards": op3_token_shards,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_language": op7_language,
    "op8_maxent_lm": op8_maxent_lm,
    "op9_chat_format": op9_chat_format,
    "op10_simhash": op10_simhash,
    "op11_late_sessions": op11_late_sessions,
    "op12_resample": op12_resample,
    "op13_main_text": op13_main_text,
}
