"""Merge-type vocabularies against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from meterline.llm import pieces as P
from meterline.llm import queries as Q

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return P.Pieces(PATH)


def encoded(model, texts):
    ids, bounds, agrees = model.encode(pa.array(texts, pa.string()))
    assert agrees.all()
    decoded = model.decode(ids, bounds).to_pylist()
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])], decoded


def test_odd_texts(model, library):
    rng = random.Random(3)
    letters = "aeinst .,\n\t▁é中😀\0'\"<>/s  ing€ 　"
    texts = [None, "", " ", "   ", "▁", " ▁ ", "<s>", "<0x0A>", "\n", "a\0b", "x﻿y", "é", "中文" * 70, " " * 1000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(1500)]
    ids, decoded = encoded(model, texts)
    want = library.encode([t or "" for t in texts])
    assert ids == want and decoded == library.decode(want)


def test_long_segments_take_the_heap(model, library):
    rng = random.Random(4)
    texts = ["a" * 5000, "é" * 3000, "".join(rng.choice("thequickaeins") for _ in range(20_000))]
    texts += ["".join(rng.choice("thequickaeins") for _ in range(n)) for n in range(P._WIDE - 2, P._WIDE + 3)]
    ids, decoded = encoded(model, texts)
    assert ids == library.encode(texts) and decoded == texts


def test_decoding_any_ids(model, library):
    rng = random.Random(5)
    lists = [[rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    lists += [[], [0], [1, 28705, 28705, 5], [1, 1, 28705], [0, 28705], [28705], [3 + 0xC3], [3 + 0xE4, 3 + 0xB8, 300]]
    flat = np.array([i for ids in lists for i in ids], np.int32)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    assert model.decode(flat, bounds).to_pylist() == library.decode(lists)


def test_known_segments_are_bounded_and_wrong_ones_show(library):
    model = P.Pieces(PATH, most_known=50)
    texts = [f"word{i} again" for i in range(400)]
    for at in range(0, 400, 40):
        assert encoded(model, texts[at : at + 40])[0] == library.encode(texts[at : at + 40])
    assert len(model.known) + len(model.older) <= 300
    model.agenda = lambda segments: [b"\0\0\0\0" for _ in segments]
    _, _, agrees = model.encode(pa.array(["zebra crossing", "word1"]))
    assert agrees.tolist()[0] is False


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    proto = ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    other = tmp_path / "unigram.model"
    other.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="not a merge-type vocabulary"):
        P.Pieces(str(other))


def test_frames(spark, library):
    rows = [(None, None, "x"), (1, "", None), (1, "", None), (2, "a text  of\nlines", "y"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids, r.agrees, r.decoded) for r in P.decode(P.encode(docs, PATH), PATH).collect()]
    text = rows[3][1]
    assert sorted(got, key=str) == sorted([(None, [], True, ""), (1, [], True, ""), (1, [], True, ""), (2, library.encode(text), True, text), (3, [], True, "")], key=str)
    assert P.decode(P.encode(docs.where("false"), PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [28705, 5])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in P.decode(nulls, PATH).collect()} == {1: "", 2: library.decode([28705, 5])}


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op11_pieces(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in docs:
        ids = library.encode(text or "")
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True)
