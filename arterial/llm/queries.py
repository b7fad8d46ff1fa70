"""Registered queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from arterial.llm import bagminhash, decontam, html_extract, packing, quality_clf, quality_rules, repair, secrets, tokencount, toxicity


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontam.find_leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_pack_power_of_two(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op3_repair_token_ids(spark, sf_dir):
    return repair.round_trip(spark, _table(spark, sf_dir, "documents"))


def op4_section_token_counts(spark, sf_dir):
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op5_bagminhash_near_duplicates(spark, sf_dir):
    return bagminhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_nb_svm_quality(spark, sf_dir):
    return quality_clf.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_boosted_toxicity(spark, sf_dir):
    return toxicity.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_block_rules_text(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_decontaminate, op2_pack_power_of_two, op3_repair_token_ids, op4_section_token_counts, op5_bagminhash_near_duplicates,
             op6_secret_scan, op7_nb_svm_quality, op8_boosted_toxicity, op9_block_rules_text, op10_quality_rules, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_rules": quality_rules.oracle_sql()}
