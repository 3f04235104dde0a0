"""The corpus pipeline: documents in, token ids of what is fit for training out.

Each stage gets all that the one before kept, and its decisions take effect. All but
the last keep the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import functions as F

from folioscope.llm import byte_pairs, decontaminate, near_dup, quality, queries, surrogates
from folioscope.llm.shared import stored

#: no stage but the last could be put into SQL; tests hold each against a brute-force version
ORACLE_SQL = None


def _documents(rows, like):
    return rows.select(*[F.col(f"`{c}`") for c in like.columns])


def quality_rules(spark, docs, sf_dir):
    """Documents that the repetition rules reject go."""
    return quality.passing(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents that share 80 % of their five-word shingles the one with the smallest id stays."""
    return near_dup.representatives(docs, width=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark, docs, sf_dir):
    """Personal data give way to surrogates; the length is that of the new text."""
    out = _documents(surrogates.pseudonymised(docs, queries.SECRET_KEY), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def byte_pair_ids(spark, docs, sf_dir):
    """Token ids of every text that is left."""
    codec = byte_pairs.Codec(byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    ids = byte_pairs.encode(docs, codec)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", private_data),
    ("byte pairs", byte_pair_ids),
]


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
