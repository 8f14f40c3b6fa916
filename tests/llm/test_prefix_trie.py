"""The burst trie against a plain one, built from every prefix."""

import hashlib
import random
import re
import zlib

import pytest

from meterline.llm import prefix_trie as T
from meterline.llm import queries as Q

TURNS = "conv_id long, turn int, role string, text string, note string, ids string"


def plain(rows, rebuild=True):
    """Nodes of (conv_id, turn, role, text) rows."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:] if rebuild else turns
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = set()
    for p, of in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.add((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(kids), len(leaves), saved, sha))
    return out


def built(spark, rows, capacity, rebuild=True):
    convs = T.sequences(spark.createDataFrame(rows, TURNS))
    got = T.prefix_trie(T.with_shared_beginnings(convs) if rebuild else convs, capacity)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def dialogue(conv, texts):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t, "x", "y") for i, t in enumerate(texts)]


@pytest.mark.parametrize("capacity", [1, 12, 4096])
def test_equals_the_plain_trie(spark, capacity):
    rng = random.Random(capacity)
    rows = []
    for c in range(90):
        rows += dialogue(rng.randrange(10**6) * 20 + c % 20 if c % 3 else c, [rng.choice(["a b", "c", "d  e\tf", ""]) for _ in range(rng.randrange(1, 6))])
    rows += [r for c in range(200, 240) for r in dialogue(c, ["same"] * 3)]  # copies
    rows += [r for c in range(300, 312) for r in dialogue(c, ["long"] * (c - 295))]  # each one turn longer than the last
    rng.shuffle(rows)
    assert built(spark, rows, capacity) == plain(rows)


def test_a_long_common_beginning_takes_few_rounds(spark, monkeypatch):
    rounds = []
    burst = T._burst
    monkeypatch.setattr(T, "_burst", lambda *a: rounds.append(1) or burst(*a))
    rows = [r for c in range(40) for r in dialogue(c, ["x"] * 60 + [str(c), "end"])]
    assert built(spark, rows, 100, rebuild=False) == plain(rows, rebuild=False)
    assert len(rounds) <= 3


def test_edges(spark):
    lost = next(c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4)
    rows = [
        (1, None, None, "first", "x", "y"), (1, 3, "user", None, "x", "y"),  # null turn, role and text
        (2, 1, "user", "tie", "x", "y"), (2, 1, "user", "tie", "x", "y"),  # repeated rows are turns of their own
        (None, 0, "user", "no conversation", "x", "y"),
        (lost, 0, "user", "cut away", "x", "y"),  # its base is missing and h takes all: turnless
        (-7, 0, "user", "-", "x", "y"), (40, 0, "user", "w " * 20000, "x", "y"),
        (41, 0, "", "ab", "x", "y"), (42, 0, "a", "b", "x", "y"),  # role and text do not run together
    ]
    others = [r for r in rows if r[0] != -7]
    assert built(spark, others, 4) == plain(others)
    assert {r[0] for r in built(spark, rows, 4)} >= {-7}
    assert built(spark, [], 4) == set()
    assert built(spark, [(None, 0, "a", "b", "x", "y")], 4) == set()


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(5, 1, "user", t, "x", "y") for t in ("b", "a", "c")]
    assert built(spark, rows, 4) == built(spark, rows[::-1], 4)


def test_query_bursts_like_the_sql(spark, monkeypatch):
    """The registered query with small containers against its SQL, over the whole table."""
    import duckdb

    whole = T.prefix_trie
    monkeypatch.setattr(T, "prefix_trie", lambda convs: whole(convs, 64))
    sf = "/root/testdata/sf0.01"
    got = Q.op12_prefix_trie(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(Q.OP12_SQL).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert got.schema["depth"].dataType.simpleString() == "bigint"
