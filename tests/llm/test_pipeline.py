"""The pipeline's stages against brute force on a small corpus."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterline.llm import packing, secrets
from meterline.llm.common import scratch

from .conftest import prose
from .test_tokens import BYTE, check_packed, whole


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and what each stage should do."""
    rnd, rows = random.Random(4), []
    item = prose(900, 40, 9000)
    for i in range(300):
        words = prose(i, 80 + i % 60, 9000).split()
        rows.append([i, " ".join(words), i % 10 == 3, "clean"])
        if i % 10 == 3:
            words[i % 60] = ("awful", "nasty", "vile")[i // 10 % 3]
            rows[-1][1] = " ".join(words)
    for i in range(1000, 1020):
        rows.append([i, rows[i - 1000][1], rows[i - 1000][2], "copy"])
    for i in range(1100, 1110):
        words = prose(i, 150, 9000).split()
        rows.append([i, " ".join(words), False, "clean"])
        words[70] = "changed"
        rows.append([i + 100, " ".join(words), False, "near"])
    for i in range(1300, 1310):
        rows.append([i, prose(i, 60, 9000) + " " + item + " " + prose(i + 50, 60, 9000), False, "leak"])
    for i in range(1400, 1405):
        rows.append([i, prose(i, 60, 9000) + f" password={rnd.getrandbits(80):020x} " + prose(i + 60, 40, 9000), False, "secret"])
    sf = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(x)) for i, _, x, _ in rows if i < 200], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(901, 30, 9000))], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows


def test_stages(spark, corpus):
    sf, rows = corpus
    toxic = {i for i, _, x, _ in rows if x}
    left = {i for i, *_ in rows}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    stages = dict(corpus_pipeline.STAGES)
    want = {
        "toxicity": lambda ids: ids - toxic,
        "near_duplicates": lambda ids: ids - {i for i, _, x, kind in rows if kind in ("copy", "near") and not x},
        "decontamination": lambda ids: ids - {i for i, _, _, kind in rows if kind == "leak"},
        "secrets": lambda ids: ids,
    }
    for name, expected in want.items():
        after = stages[name](spark, before, sf).cache()
        left = expected(left)
        assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(left), name
        assert after.columns == columns
        before = after
    texts = {r.doc_id: r.text for r in before.collect()}
    original = {i: t for i, t, _, _ in rows}
    for i, t in texts.items():
        spans = secrets.find(original[i])
        assert t == secrets.redact(original[i], [(a, b) for _, a, b in spans])
        assert i < 1400 or "[REDACTED]" in t
    assert before.where("n_chars <> length(text)").count() == 0
    packed = packing.placed(stages["packing"](spark, before, sf)).collect()
    ids = sorted(texts)
    assert check_packed(packed, list(zip(ids, whole(BYTE, 0, [texts[i] for i in ids]))), 1024) < 0.1  # pieces of a third to a half of a window
    run = packing.placed(corpus_pipeline.run(spark, sf))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(tuple(r[k] for k in key) for r in packed)


def test_stages_on_odd_rows(spark, corpus, docs, empty):
    sf, _ = corpus
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        out = stage(spark, docs, sf)
        if name == "toxicity":  # learns from labels that are not about these rows
            assert out.columns == docs.columns and {None, 4, 5, 6} <= {r.doc_id for r in out.collect()}
        elif name in ("decontamination", "secrets"):
            assert out.count() == docs.count() and out.columns == docs.columns, name
        elif name == "near_duplicates":
            kept = [r.doc_id for r in out.orderBy("doc_id").collect()]
            assert kept == [None, 1, 4, 7, 8, 9, 10, 11, 12, 13, 14, 14]
        else:
            assert {i for r in out.collect() for i in r.doc_ids} == {r.doc_id for r in docs.collect()}


def test_stages_keep_the_callers_columns(spark, corpus):
    """Columns named like those that stages add come back as they were, and texts too."""
    sf, rows = corpus
    names = ["spans", "_blob", "blob", "hits", "p_toxic", "is_toxic", "of", "own_0", "lang_2", "node", "label"]
    few = [r for r in rows if r[0] < 60 or r[0] >= 1300]
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in few], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    given = given.select(F.lit("first").alias("hits2"), *given.columns, *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names])
    before = {r.doc_id: r for r in given.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, sf)
        assert out.columns == given.columns, name
        got = out.collect()
        assert len(got) > 30, name
        for r in got:
            old = before[r.doc_id]
            assert all(r[c] == old[c] for c in ["hits2", "lang", "source", *names]), name
            text = secrets.redact(old.text, [(a, b) for _, a, b in secrets.find(old.text)]) if name == "secrets" else old.text
            assert (r.text, r.n_chars) == (text, len(text)), name


def test_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(session, "x")
