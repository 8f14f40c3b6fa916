import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meterline.llm import packing, token_files
from meterline.llm.common import scratch
from meterline.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, "a  b\n\n c\t\n", "don't we'll I'M 's  　x\x1cy áé ñ  b", "1234 a1b2 ¼½ x² Ⅷ", "\n\nFoo  bar,baz... !?\r\nX\x85Y",
    "中文字符 emoji 😀😀 ok", "İstanbul ΣΑΣ ς ﬁ", "it's,they're.It'S", "×a÷b à×b", " lead  trail ", "<|endoftext|> hi <|startoftext|>", "x<|endoftext|>  y <|endoftext|", "\u2003 a \u00a0\n b\u3000 c", "a" * 5000, " " * 300, "ß ẞ straße.",
]


def whole(path, end, texts):
    t = Tokenizer.from_file(path)
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path, end", [(WORD, 1), (BYTE, 0)])
def test_segments_give_the_ids_of_the_whole(spark, path, end):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    e = Encoder(path, end, most_known=500)  # so that it forgets
    got = []
    for i in range(0, len(texts), 7):
        ids, upto = e(pa.array(texts[: i + 7], pa.string()).slice(i))
        got += [ids[a:b].tolist() for a, b in itertools.pairwise(upto)]
    assert got == whole(path, end, texts)
    assert e.direct


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_random_strings(path):
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "Word", "don't", "'s", "12", "é", "\u0301", "ſ", "中", "😀", "<|endoftext|>", "<|", "###", "...", "_", "\u212a", "\u200b", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    ids, upto = Encoder(path, 9)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(upto)] == whole(path, 9, texts)


def test_files_round_trip(spark, docs, crowded):
    for df in (docs, crowded):
        rows = df.collect()
        manifest = token_files.write(df.repartition(3), scratch(spark, "t"), WORD, 1, length=32, batch_rows=4).collect()
        ids = collections.Counter((r.doc_id, crc(x)) for r, x in zip(rows, whole(WORD, 1, [r.text for r in rows])))
        stream, seen = [], collections.Counter()
        for f in manifest:
            t = token_files.TokenFile(f.uri)
            assert f.first == len(stream)
            own = [t.sequence(i) for i in range(-(-f.n_tokens // 32))]
            real = [x for s, m in own for x, keep in zip(s.tolist(), m.to_pylist()) if keep]
            assert len(real) == f.n_tokens and all(len(s) == 32 for s, _ in own)
            assert not own[0][0].flags.owndata  # a view of the map
            for d in t.docs.to_pylist():
                x = t.tokens(d["start"], d["n_tokens"])
                assert x.tolist() == real[d["start"] : d["start"] + d["n_tokens"]]
                seen[d["doc_id"], crc(x)] += 1
            stream += real
        assert seen == ids
    got = token_files.token_files(spark, docs, scratch(spark, "t"), WORD, 1).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order[:-1]]).tolist()
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda x: (x is not None, x))


def test_empty_tables(spark, empty):
    assert token_files.token_files(spark, empty, scratch(spark, "t"), WORD, 1).count() == 0
    assert packing.packed(empty, BYTE, 0).count() == 0


def check_packed(rows, texts, window):
    """Pieces cover every document once, sequences are gapless; returns the padded share."""
    ids = collections.defaultdict(list)
    for i, x in texts:
        ids[i].append(x)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert any(len(x) == r.doc_tokens and crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, held in ids.items():
        want = collections.Counter()
        for x in held:
            want.update((s, min(window, len(x) - s)) for s in range(0, len(x), window))
        assert collections.Counter(pieces[i]) == want
    pad = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert 0 < at <= window
        pad += window - at
    return pad / (window * len(sequences))


def test_packing(docs, crowded):
    for df in (docs, crowded):
        rows = df.collect()
        texts = list(zip([r.doc_id for r in rows], whole(BYTE, 0, [r.text for r in rows])))
        check_packed(packing.placed(packing.packed(df, BYTE, 0, window=64)).collect(), texts, 64)


def test_sequences_of_a_group_come_in_steps(monkeypatch):
    """No batch holds a whole group's padded ids, and the steps give the sequences of one go."""
    rng = np.random.default_rng(1)
    length = rng.integers(1, 65, 900)
    ids = [rng.integers(1, 60_000, n).astype("<u2").tobytes() for n in length]
    cut = pa.RecordBatch.from_pydict({"doc_id": np.arange(900), "start": np.zeros(900, int), "length": length, "doc_tokens": length, "ids": ids})
    found = []
    for step in (7, 10**6):
        monkeypatch.setattr(packing, "AT_ONCE", step)
        made = list(packing.group_sequences(3, iter([cut[:500], cut[500:]]), 2, 64, 0))
        assert all(b.num_rows <= step for b in made)
        found.append(pa.Table.from_batches(made).combine_chunks())
    assert len(found[0]) > 100 and found[0].equals(found[1])


def test_sequences_hold_their_pieces(docs):
    rows = docs.collect()
    texts = collections.defaultdict(list)
    for r, x in zip(rows, whole(BYTE, 0, [r.text for r in rows])):
        texts[r.doc_id].append(x)
    lengths = set()
    for s in packing.packed(docs, BYTE, 0, window=64).collect():
        at = 0
        for i, start, length, total, offset in zip(s.doc_ids, s.starts, s.lengths, s.doc_tokens, s.offsets):
            assert offset == at
            assert any(len(x) == total and s.ids[at : at + length] == x[start : start + length] for x in texts[i])
            at += length
        assert at == s.length and not any(s.ids[at:])
        assert len(s.ids) == (at if at & (at - 1) == 0 else 64)
        lengths.add(at)
    assert lengths - {64}


def test_equal_rows_spread(spark):
    cut = spark.range(60_000).selectExpr("cast(7 as bigint) doc_id", "0L start", "3L length", "3L doc_tokens", "unhex('010002000300') ids")
    sizes = packing.pack(cut, 2, window=64).selectExpr("sequence_id >> 40 g", "size(starts) n").groupBy("g").sum("n").collect()
    assert len(sizes) == 8 and max(r[1] for r in sizes) < 2 * 8192


def test_query_packs_tightly(spark):
    from meterline.llm.queries import op10_packing

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = list(zip([r.doc_id for r in rows], whole(BYTE, 0, [r.text for r in rows])))
    assert check_packed(op10_packing(spark, "/root/testdata/sf0.001").collect(), texts, 1024) < 0.02


def test_tightest_window_wins():
    rnd = np.random.default_rng(1)
    lengths = np.sort(rnd.integers(1, 65, 500))[::-1]
    windows, offsets = packing.best_fit_decreasing(lengths, 64)
    room: list[int] = []
    for n, w, o in zip(lengths, windows, offsets):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits) and o == 64 - room[w]
        else:
            assert w == len(room) and o == 0
            room.append(64)
        room[w] -= n


def test_query_reads_its_files_back(spark):
    from meterline.llm.queries import op4_token_files

    rows = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    want, at = {}, 0
    for r, x in zip(rows, whole(WORD, 1, [r.text for r in rows])):
        want[r.doc_id] = (at, len(x), crc(x))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op4_token_files(spark, "/root/testdata/sf0.001").collect()} == want
