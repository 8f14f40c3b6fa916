import random
import re

import collections

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from meterline.llm import simhash
from meterline.llm.components import components

from .conftest import prose


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, most=2):
    """Least id that links reach, for each row."""
    rows = list(zip(ids, fps))
    label = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= most:
                    label[i] = label[j] = min(label[i], label[j])
    return [min((ids[j] for j in range(len(rows)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(rows))]


def check(df, most=2):
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = sorted((str(r.doc_id), format(f, "016x"), str(c)) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps, most)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df, max_distance=most).collect())
    assert got == want


def test_edges(docs, crowded, empty):
    check(docs)
    check(crowded)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most, segments", [(0, 2), (1, 2), (2, 2), (2, 3), (3, 2), (4, 2)])
def test_links_equal_all_pairs(spark, most, segments):
    rnd = random.Random(most)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (2**64 - 1) for b in base for _ in range(20)}
    values = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(v,) for v in values], "fp bigint").repartition(5)
    got = {r.node: r.component for r in components(simhash.links(df, most, segments)).collect()}
    unsigned = {v: int(np.int64(v).view(np.uint64)) for v in values}
    label = {v: v for v in values}
    for _ in range(10):
        for a in values:
            for b in values:
                if (unsigned[a] ^ unsigned[b]).bit_count() <= most:
                    label[a] = label[b] = min(label[a], label[b])
    groups = {}
    for v in values:
        groups.setdefault(got.get(v, v), set()).add(v)
    want = {}
    for v in values:
        want.setdefault(label[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_crowded_bucket_is_cut_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rnd = np.random.default_rng(3)
    fp = np.unique(rnd.integers(0, 1 << 11, 600).astype(np.uint64))
    u, v = simhash._bucket_links(np.zeros(len(fp), np.int64), fp, np.ones(len(fp), bool), 2)
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        assert a != b
        root[max(find(a), find(b))] = min(find(a), find(b))
    for a in fp.tolist():
        for b in fp.tolist():
            if (a ^ b).bit_count() <= 2:
                assert find(a) == find(b)
    assert len(u) < len(fp)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (3, 2), (None, 5)], "u bigint, v bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert components(df.where("false")).count() == 0


def test_similar_texts_are_grouped_and_others_stay(spark):
    rows = []
    for k in range(12):
        words = prose(100 + k, 150, 100000).split()
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):  # one or two changed words: similarity over 0.8
            near = list(words)
            for p in range(c if c < 3 else 2):
                near[20 + 50 * p] = f"x{c}{p}"
            rows.append((10 * k + c, " ".join(near)))
        rows.append((10 * k + 9, " ".join(words[:60]) + " " + prose(500 + k, 90, 100000)))  # shares a part only
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert len(got) == len(rows)
    assert all(got[10 * k + c] == 10 * k for k in range(12) for c in range(4))
    assert all(got[10 * k + 9] == 10 * k + 9 for k in range(12))


def test_similar_groups_edges(docs, empty):
    got = simhash.similar_groups(docs.where("doc_id is not null")).collect()
    assert len(got) == 16
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4
    assert simhash.similar_groups(empty).count() == 0


def test_long_text_is_counted_whole():
    long = prose(9, 70000)
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_query_matches_brute_force(spark):
    from meterline.llm.queries import op8_simhash

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (format(f, "016x"), c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_schema(docs):
    assert simhash.near_duplicates(docs).dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert simhash.near_duplicates(docs).where(F.length("fingerprint") != 16).count() == 0


def similar_in_a_bucket(texts, soft=5):
    """Components, by brute force, of the pairs of Jaccard 0.8 or more that meet in a bucket."""
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    balances = [simhash._balance(s) for s in sets]
    fps = [int(np.packbits(b > 0, bitorder="little").view(np.uint64)[0]) for b in balances]
    masks = [simhash._uncertain(b, 3, soft) for b in balances]
    parts = [sum(1 << int(b) for b in bits) for bits in np.array_split(np.arange(64), 3)]
    label = list(range(len(texts)))
    for i, a in enumerate(fps):
        for j in range(i):
            x = a ^ fps[j]
            meet = x.bit_count() <= 14 and any(not x & p & ~(masks[i][k] | masks[j][k]) for k, p in enumerate(parts))
            if meet and (shared := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_links_among_look_alikes_are_kept(spark):
    """Pairs of near copies on one template, whose other texts lie nearer but are not similar."""
    template, texts = prose(1, 240, 100000), []
    for k in range(150):
        own = prose(1000 + k, 60, 100000).split()
        texts.append(" ".join([template, *own]))
        own[20:24] = [f"x{k}a", *own[21:23], f"x{k}b"]
        own[40:41] = [f"y{k}"]
        texts.append(" ".join([template, *own[:55], f"z{k}"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    want = similar_in_a_bucket(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(want[2 * k] == want[2 * k + 1] for k in range(150)) > 120 and len(set(want)) > 100


def test_repeated_lines_neither_join_nor_part_texts(spark):
    """A line that is repeated fixes a fingerprint of all shingles, but not the set of shingles."""
    line, texts = "the same nine words come again on every line\n", []
    for k in range(60):
        own = prose(2000 + k, 40, 100000)
        texts.append(line * 20 + own)
    for k in range(10):
        own = prose(3000 + k, 200, 100000)
        texts += [own + "\n" + line, own + "\n" + line * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert all(got[k] == k for k in range(60))
    assert all(got[60 + 2 * k] == got[61 + 2 * k] == 60 + 2 * k for k in range(10))


def test_sets_under_one_fingerprint_are_compared():
    """Different sets whose fingerprints agree are candidates of each other, not copies."""
    same = np.full(64, 5)
    texts = [prose(4000 + k, 60, 100000) for k in range(6)]
    texts += [texts[0] + " end", texts[1] + " end"]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    node = np.array([simhash._set_name(x) for x in sets], np.uint64).view(np.int64)
    assert len(set(node.tolist())) == len(texts)
    fp = np.packbits(same > 0, bitorder="little").view(np.uint64).repeat(len(texts))
    u, v = simhash._nearest_first(np.zeros(len(texts), np.int64), fp, node, 14)
    assert len(u) == len(texts) - 1 and set(u.tolist()) | set(v.tolist()) == set(node.tolist())


def test_recall_of_similar_pairs():
    """Of all pairs of 0.8 or more in sf0.1, found by comparing every two texts that share one of their
    rarest shingles, nine in ten at least meet in a bucket."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    sets = list({s.tobytes(): s for s in (np.unique(simhash.shingle_hashes(t, 5)) for t in texts)}.values())
    often = collections.Counter(x for s in sets for x in s.tolist())
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in sorted(s.tolist(), key=lambda x: (often[x], x))[: len(s) - -(-len(s) * 4 // 5) + 1]:
            by[x].append(i)
    met = total = 0
    parts = [sum(1 << int(b) for b in bits) for bits in np.array_split(np.arange(64), 3)]
    for a, b in {(a, b) for held in by.values() for k, b in enumerate(held) for a in held[:k]}:
        shared = len(np.intersect1d(sets[a], sets[b]))
        if shared < 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            continue
        total += 1
        balance = [simhash._balance(sets[i]) for i in (a, b)]
        x = int.from_bytes(np.packbits((balance[0] > 0) ^ (balance[1] > 0), bitorder="little").tobytes(), "little")
        soft = [m | n for m, n in zip(*(simhash._uncertain(c, 3, 5) for c in balance))]
        met += x.bit_count() <= 14 and any(not x & p & ~m for p, m in zip(parts, soft))
    assert total > 40 and met >= 0.9 * total
