"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Toxic documents go; one document of each near-duplicate class stays; documents that hold a benchmark item go; secrets are
replaced by marks; what is left is packed into sequences. Clean documents pass every filtering stage unchanged.

Edge cases: rows with a null doc_id or text, repeated rows and texts of any length pass as the stages' operators define;
extra columns are kept up to packing; empty documents give an empty result; without labels of both classes or without
benchmark items the stage that needs them drops nothing.
"""

from __future__ import annotations

from arterial.llm import bagminhash, decontam, packing, secrets, toxicity
from arterial.llm.common import discard, materialize, release


def _read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark, docs, sf_dir):
    return toxicity.filter_toxic(spark, docs, _read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    return bagminhash.keep_one(spark, docs)


def drop_leaks(spark, docs, sf_dir):
    return decontam.remove_leaks(spark, docs, _read(spark, sf_dir, "benchmark"))


def mask_secrets(spark, docs, sf_dir):
    return secrets.redact(docs)


def pack_documents(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_documents),
]

#: SQL can express none of the stages: learned models, signatures and tokenizers decide. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = _read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        written = materialize(spark, found, f"stage-{name}")
        release(spark, found)
        if k:
            discard(spark, docs)  # the stage before is spent
        docs = written
    return docs
