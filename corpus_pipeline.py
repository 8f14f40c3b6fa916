"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; `run` writes each result as Parquet
to the shared folder and reads it back as the next one's documents.  All but the last return the
columns of `documents`; the stages use every row and the whole text of what they are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import decontaminate, packing, secrets, simhash, toxicity
from meterline.llm.common import materialise, steps, tables
from meterline.llm.queries import TOXICITY_CHAIN, toxicity_labels


def _set_aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`docs` with other names for its columns but doc_id and text, so that none clashes with what a
    stage adds, and the columns that bring the names back."""
    names = {c: c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(own).alias(c) for c, own in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    docs, back = _set_aside(docs)
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), TOXICITY_CHAIN, balance="toxic", sample_rows=6000)
    return toxicity.predict(docs, chain).where("not is_toxic").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are similar by 0.8 or more: the smallest doc_id.

    Repeated rows leave one; rows with a null id are groups of their own.
    """
    groups = simhash.similar_groups(docs.where("doc_id is not null"), similarity=0.8, words=5)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs, back = _set_aside(docs)
    found = decontaminate.decontaminate(docs, tables(spark, sf_dir, "benchmark"), least=5, threshold=0.6)
    return found.where(F.size("hits") == 0).select(*back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted anew."""
    schema, counted = docs.schema, f"own_{docs.columns.index('n_chars')}"
    docs, back = _set_aside(docs)
    found = secrets.scan(docs.select("doc_id", "text"), ["doc_id"]).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("of"), "blob", "spans").dropDuplicates(["of", "blob"])
    hit = docs.join(found, (secrets.blob() == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select(*docs.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            text, n = b.column("text").to_pylist(), b.column(counted).to_pylist()
            for i, found in enumerate(b.column("spans").to_pylist()):
                if found:
                    text[i] = secrets.redact(text[i], [(s["start"], s["end"]) for s in found])
                    n[i] = len(text[i])
            new = {"text": text, counted: n}
            columns = [pa.array(new[c], b.schema.field(c).type) if c in new else b.column(c) for c in b.schema.names if c != "spans"]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return hit.mapInArrow(run, schema)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token ids in padded sequences of at most 1024."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Classifiers, fingerprints and tokenisers have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
