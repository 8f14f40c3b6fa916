"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has bit i set if bit i is set in over half of the XXH64 values (seed 42) of the
text's three-word shingles.  Distinct fingerprints at most `max_distance` bits apart are linked
(Norouzi et al., "Fast Exact Search in Hamming Space with Multi-Index Hashing"): the 64 bits are
cut into `segments` parts; with max_distance = segments * a + b, two linked fingerprints agree
within a bits on one of the first b + 1 parts or within a - 1 bits on one of the others.  Each
fingerprint is put into a table under its parts, probes the small Hamming balls around them, and
every hit is verified over all 64 bits.

Exact copies share a fingerprint and are folded first, so they cost one row.  A bucket never emits
its pairs, only a spanning forest of the verified links; a crowded bucket is cut again by the bits
in which its members still differ, which loses no link.

`similar_groups` looks for texts of a given Jaccard similarity instead, which lie up to a dozen bits
apart.  There fingerprints are of distinct shingles, and only texts with the same set of them are
folded.  A text stands in its segments' tables under all changes of the segment's least certain bits
(those nearest to a tie), so two texts meet where they differ in bits uncertain to one or the other.
The links between texts that agree on a whole segment are compared first, to find most of each group; then
every link within `max_distance` bits between texts of different groups, whatever their number.

Nulls and texts without words have fingerprint 0 and are linked like any other; a text of one or
two words is one shingle; repeated rows and repeated ids are documents of their own; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, steps
from .components import components

#: Comparisons that one block makes at a time, and bucket sizes (table x probes) that are cut again.
BLOCK = 1 << 22


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; of the whole text if it has fewer words."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes: only A-Z changes, only ASCII space splits
    if len(w) < words:
        return np.array([xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, len(w) - words + 1)


def _balance(hashes: np.ndarray) -> np.ndarray:
    """Of each bit, twice the number of ones less the number of hashes."""
    blocks = (hashes[i : i + 65536] for i in range(0, len(hashes), 65536))
    ones = sum((np.unpackbits(b.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for b in blocks), np.zeros(64, np.int64))
    return 2 * ones - len(hashes)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint, unsigned."""
    return int(np.packbits(_balance(shingle_hashes(text, words)) > 0, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            fp = np.fromiter((fingerprint(t, words) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _spread(fps: DataFrame) -> DataFrame:
    """A small table dealt to many tasks, as each row is about to become hundreds."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _ball(seg: int, part: Column, masks: list[int]) -> Column:
    return F.transform(
        F.array(*[F.lit(m).cast("long") for m in masks]),
        lambda m: F.struct(F.lit(seg).alias("seg"), part.bitwiseXOR(m).alias("key"), (m == 0).alias("stored")),
    )


def _indexed(fps: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(seg, key, fp, stored): the parts of a fingerprint (stored) and the balls around them."""
    a, b = divmod(max_distance, segments)
    width = [64 // segments + (i < 64 % segments) for i in range(segments)]
    parts = []
    for i, w in enumerate(width):
        radius = a if i <= b else a - 1
        if radius < 0:
            continue
        masks = [sum(1 << x for x in bits) for r in range(radius + 1) for bits in combinations(range(w), r)]
        part = F.shiftrightunsigned("fp", sum(width[:i])).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1))
        parts.append(_ball(i, part, masks))
    return _spread(fps).select("fp", F.explode(F.concat(*parts)).alias("x")).select("x.seg", "x.key", "fp", "x.stored")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) reduced to (least fingerprint of the group, member)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != label[label]).any():
            label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[label[own]], nodes[own]


def _near(stored: np.ndarray, probes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between `stored` and `probes` (distinct, unsigned), block by block."""
    if len(stored) * len(probes) <= 4 * BLOCK:
        for i in range(0, len(stored), max(1, BLOCK // len(probes))):
            s = stored[i : i + max(1, BLOCK // len(probes))]
            x, y = np.nonzero(np.bitwise_count(s[:, None] ^ probes[None, :]) <= most)
            yield s[x], probes[y]
        return
    everyone = np.concatenate((stored, probes))
    differ = np.bitwise_or.reduce(everyone ^ everyone[0])
    bits = [i for i in range(64) if int(differ) >> i & 1]
    # at most `most` of these bits differ between linked members, so they agree on one of most + 1 parts
    for k in range(most + 1):
        mask = np.uint64(sum(1 << i for i in bits[k :: most + 1]))
        ks, kp = stored & mask, probes & mask
        os, op = np.argsort(ks, kind="stable"), np.argsort(kp, kind="stable")
        for v in np.intersect1d(ks, kp):
            s = stored[os[np.searchsorted(ks[os], v, "left") : np.searchsorted(ks[os], v, "right")]]
            p = probes[op[np.searchsorted(kp[op], v, "left") : np.searchsorted(kp[op], v, "right")]]
            if len(p) > 1 or s[0] != p[0]:
                yield from _near(s, p, most)


def _bucket_links(key: np.ndarray, fp: np.ndarray, stored: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the buckets of sorted `key`."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(starts[1:], len(key))
    held = np.add.reduceat(stored.astype(np.int64), starts)
    left, right = [], []

    def fold() -> None:
        if left:
            r, m = _forest(np.concatenate(left), np.concatenate(right))
            left[:], right[:] = [r], [m]

    waiting = 0
    work = held * (ends - starts)
    live = (held > 0) & (ends - starts > 1)
    for k in np.flatnonzero(live & (work > 4096)):  # crowded buckets one by one
        f, s = fp[starts[k] : ends[k]], stored[starts[k] : ends[k]]
        for x, y in _near(np.unique(f[s]), np.unique(f), most):
            left.append(x), right.append(y)
            waiting += len(x)
            if waiting > BLOCK:
                fold()
                waiting = 0
    small = np.flatnonzero(live & (work <= 4096))
    for part in np.array_split(small, max(1, int(work[small].sum()) // BLOCK + 1)):  # the others together
        if not len(part):
            continue
        size = ends[part] - starts[part]
        rows = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        group = np.repeat(np.arange(len(part)), size)
        own = stored[rows]
        t, tg = fp[rows[own]], group[own]
        n = size[tg]
        at = np.repeat(starts[part][tg] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        x, y = np.repeat(t, n), fp[at]
        near = (x != y) & (np.bitwise_count(x ^ y) <= most)
        left.append(x[near]), right.append(y[near])
    fold()
    return (left[0], right[0]) if left else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def links(fps: DataFrame, max_distance: int = 2, segments: int = 2) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of `fps` (fp): they connect exactly what the
    links of at most `max_distance` bits connect."""
    return _linked(_indexed(fps.select("fp").distinct(), max_distance, segments), max_distance, _bucket_links)


def _linked(indexed: DataFrame, max_distance: int, bucket_links: Callable) -> DataFrame:
    """The links of the buckets of `indexed` (seg, key, fp, stored), each bucket in one piece."""

    def link(bucket: np.ndarray, t: pa.Table) -> list[np.ndarray]:
        u, v = bucket_links(bucket, t["fp"].to_numpy().view(np.uint64), t["stored"].to_numpy(), max_distance)
        return [u.view(np.int64), v.view(np.int64)]

    return _by_bucket(indexed, link, "u bigint, v bigint", ["seg", "key"])


def _by_bucket(indexed: DataFrame, link: Callable, schema: str, bucket: list[str]) -> DataFrame:
    """What `link` finds in the buckets (numbered, and their rows) of `indexed` (*bucket, ...)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, rows
            if not kept:
                return
            t = pa.Table.from_batches(kept).combine_chunks()
            new = np.zeros(t.num_rows - 1, bool)
            for c in bucket:
                x = t[c].to_numpy()
                new |= x[1:] != x[:-1]
            cuts = np.flatnonzero(new) + 1
            upto = t.num_rows if last else int(cuts[-1]) if len(cuts) else 0  # the last bucket may go on in the next batch
            if upto:
                number = np.zeros(t.num_rows, np.int64)
                number[cuts] = 1
                found = link(np.cumsum(number)[:upto], t.slice(0, upto))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)
            rest = t.slice(upto)
            kept, rows = (rest.to_batches() if rest.num_rows else []), 0

        for b in batches:
            if b.num_rows:
                kept.append(b)
                rows += b.num_rows
                if rows >= 1 << 18:
                    yield from flush(False)
        yield from flush(True)

    return indexed.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, max_distance: int = 2, segments: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, itself included; null ids do not count
    (a component of null ids only has none).
    """
    marked = materialise(fingerprints(docs, words), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(distinct, max_distance, segments))
    rooted = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _uncertain(balance: np.ndarray, segments: int, soft: int) -> list[int]:
    """For each segment, its `soft` bits nearest to a tie."""
    out = []
    for bits in np.array_split(np.arange(64), segments):
        nearest = bits[np.argsort(np.abs(balance[bits]), kind="stable")[:soft]]
        out.append(sum(1 << int(b) for b in nearest))
    return out


def _parity(shingles: np.ndarray) -> np.ndarray:
    """256 bits: whether an odd number of the distinct `shingles` fall on each.  Two sets differ by
    at least as many shingles as bits."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _set_name(shingles: np.ndarray) -> int:
    """XXH64 of a sorted set of shingles."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes(), 42)


def _sketches(docs: DataFrame, words: int, segments: int, soft: int) -> DataFrame:
    """(doc_id, node, fp, n, parity, soft): the name of the set of shingles, its fingerprint, number
    and parity, and the uncertain bits of each segment.  Repeats do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
            names = np.array([_set_name(x) for x in sets], np.uint64).view(np.int64)
            balances = [_balance(x) for x in sets]
            fp = np.packbits(np.stack(balances) > 0, axis=1, bitorder="little").view(np.int64).reshape(-1)
            masks = np.array([_uncertain(x, segments, soft) for x in balances], np.uint64).view(np.int64)
            longs = pa.list_(pa.int64())
            columns = [pa.array(names), pa.array(fp), pa.array([len(x) for x in sets], pa.int64()), pa.array([_parity(x) for x in sets], longs), pa.array(list(masks), longs)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "node", "fp", "n", "parity", "soft"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, node bigint, fp bigint, n bigint, parity array<bigint>, soft array<bigint>")


def _soft_indexed(nodes: DataFrame, segments: int) -> DataFrame:
    """(bucket, free, ...) of `nodes` (fp, soft, other longs): all changes of a segment's uncertain
    bits, which are `free`."""
    parts = [sum(1 << int(b) for b in bits) for bits in np.array_split(np.arange(64), segments)]
    carried = [c for c in nodes.columns if c != "soft"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp = b.column("fp").to_numpy().view(np.uint64)
                soft = b.column("soft").flatten().to_numpy().view(np.uint64).reshape(-1, segments)
                for i, part in enumerate(parts):
                    rest, keys = soft[:, i].copy(), (fp & np.uint64(part))[:, None]
                    while rest.any():
                        low = rest & (~rest + np.uint64(1))
                        keys = np.concatenate((keys, keys ^ low[:, None]), axis=1)
                        rest ^= low
                    n = keys.shape[1]
                    rows = np.repeat(np.arange(len(fp)), n)
                    bucket = keys.reshape(-1) // np.uint64(part & -part) * np.uint64(segments) + np.uint64(i)
                    free = np.repeat(soft[:, i], n).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(free), *(b.column(c).take(pa.array(rows)) for c in carried)], ["bucket", "free", *carried])

    return _spread(nodes).mapInArrow(run, "bucket bigint, free bigint, " + ", ".join(f"{c} bigint" for c in carried))


def _plain_indexed(nodes: DataFrame, segments: int) -> DataFrame:
    """(bucket, fp, node) of `nodes`: the segments as they are."""
    parts = [[int(x) for x in bits] for bits in np.array_split(np.arange(64), segments)]
    keys = [F.shiftrightunsigned("fp", bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1)) * segments + i for i, bits in enumerate(parts)]
    return nodes.select(F.explode(F.array(*keys)).alias("bucket"), "fp", "node")


#: Members of a bucket that the first round compares with each other.
_FIRST = 4096


def _bounds(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(starts[1:], len(bucket))
    some = ends - starts > 1
    return zip(starts[some].tolist(), ends[some].tolist())


def _near_pairs(fp: np.ndarray, beyond: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (x, y) of `fp` at most `most` bits apart with y at beyond[x] or later, and their
    distances, block by block; `beyond` ascends."""
    at = 0
    while at < len(fp) and beyond[at] < len(fp):
        first = int(beyond[at])
        upto = at + max(1, BLOCK // (len(fp) - first))
        distance = np.bitwise_count(fp[at:upto, None] ^ fp[None, first:])
        x, y = np.nonzero(distance <= most)
        d, x, y = distance[x, y], x + at, y + first
        later = y >= beyond[x]
        yield x[later], y[later], d[later]
        at = upto


def _nearest_first(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between nodes inside the buckets, a spanning forest of least distances.  In
    larger buckets, of those that stand near each other in the fingerprints' order."""
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(most + 1)]
    waiting = 0

    def fold() -> None:
        nodes = np.unique(np.concatenate([x for level in levels for pair in level for x in pair])) if any(levels) else None
        if nodes is None:
            return
        label = np.arange(len(nodes))
        for level in levels:
            if not level:
                continue
            u, v = (np.searchsorted(nodes, np.concatenate(x)) for x in zip(*level))
            kept = []
            while True:
                p, q = label[u], label[v]
                apart = np.flatnonzero(p != q)
                if not len(apart):
                    break
                hi, lo = np.maximum(p, q)[apart], np.minimum(p, q)[apart]
                once, first = np.unique(hi, return_index=True)  # one link joins each label to a lesser one
                kept.append(apart[first])
                label[once] = lo[first]
                while (label != label[label]).any():
                    label = label[label]
            picked = np.concatenate(kept) if kept else np.empty(0, np.int64)
            level[:] = [(nodes[u[picked]], nodes[v[picked]])]

    for start, end in _bounds(bucket):
        rows = start + np.argsort(fp[start:end], kind="stable")
        for at in range(0, len(rows), _FIRST):
            own = rows[at : at + _FIRST]
            for x, y, d in _near_pairs(fp[own], np.arange(1, len(own) + 1), most):
                for n in np.unique(d):
                    levels[n].append((node[own[x[d == n]]], node[own[y[d == n]]]))
                waiting += len(x)
                if waiting > BLOCK:
                    fold()
                    waiting = 0
    fold()
    pairs = [pair for level in levels for pair in level]
    u, v = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    return np.minimum(u, v), np.maximum(u, v)


def _first_few(u: np.ndarray, v: np.ndarray, lu: np.ndarray, lv: np.ndarray, d: np.ndarray, more: np.ndarray, few: int) -> list[np.ndarray]:
    """The `few` nearest distinct pairs (u, v) of every two labels, and whether there are more."""
    order = np.lexsort((v, u, d, lv, lu))
    u, v, lu, lv, d, more = (x[order] for x in (u, v, lu, lv, d, more))
    if not len(u):
        return [u, v, lu, lv, d, more]
    first = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
    group = np.cumsum(np.concatenate(([False], (lu[1:] != lu[:-1]) | (lv[1:] != lv[:-1]))))
    cut = np.bincount(group, more) > 0
    u, v, lu, lv, d, group = (x[first] for x in (u, v, lu, lv, d, group))
    place = np.arange(len(u)) - np.searchsorted(group, group)
    cut |= np.bincount(group) > few
    kept = place < few
    return [x[kept] for x in (u, v, lu, lv, d)] + [cut[group[kept]]]


def _crossing(bucket: np.ndarray, t: pa.Table, most: int, similarity: float, few: int, segments: int) -> list[np.ndarray]:
    """Of the links between nodes of different labels that may be as similar as asked, the `few`
    nearest of every two labels: u, v, their labels, and whether there are more.

    Sizes and parities leave out only what cannot be as similar.  Two nodes that share several
    buckets of a segment are taken in one of them: where the bits that both may change are as in
    the lesser node.
    """
    parts_of = [sum(1 << int(b) for b in bits) for bits in np.array_split(np.arange(64), segments)]
    named, free = t["bucket"].to_numpy(), t["free"].to_numpy().view(np.uint64)
    fp, node, label, size = t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy(), t["label"].to_numpy(), t["n"].to_numpy()
    parity = [t[f"p{i}"].to_numpy().view(np.uint64) for i in range(4)]  # bits of negative longs are not counted
    parts: list[list[np.ndarray]] = []
    waiting = 0

    def fold() -> None:
        if parts:
            parts[:] = [_first_few(*(np.concatenate(x) for x in zip(*parts)), few)]

    for start, end in _bounds(bucket):
        own = start + np.argsort(label[start:end], kind="stable")
        if label[own[0]] == label[own[-1]]:
            continue
        part = parts_of[int(named[start]) % segments]
        key = np.uint64(int(named[start]) // segments * (part & -part))
        for x, y, d in _near_pairs(fp[own], np.searchsorted(label[own], label[own], "right"), most):
            x, y = own[x], own[y]
            here = (np.where(node[x] < node[y], fp[x], fp[y]) ^ key) & free[x] & free[y] == 0
            x, y, d = x[here], y[here], d[here]
            differ = sum((np.bitwise_count(p[x] ^ p[y]).astype(np.int64) for p in parity), np.zeros(len(x), np.int64))
            differ = np.maximum(differ, np.abs(size[x] - size[y]))
            may = (1 + similarity) * differ <= (1 - similarity) * (size[x] + size[y]) + 1e-6
            if may.any():
                x, y, d = x[may], y[may], d[may]
                parts.append([node[x], node[y], label[x], label[y], d, np.zeros(len(x), bool)])
                waiting += len(x)
            if waiting > BLOCK:
                fold()
                waiting = 0
    fold()
    u, v, lu, lv, _, more = parts[0] if parts else [np.empty(0, np.int64)] * 5 + [np.empty(0, bool)]
    return [u, v, lu, lv, more]


def _shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of `nodes` (node, least): the sets of the texts of the ids `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
            own = [_set_name(x) == n % (1 << 64) for x, n in zip(sets, b.column("node").to_pylist())]  # an id may have several texts
            columns = [b.column("node"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"]).filter(pa.array(own, pa.bool_()))

    texts = docs.select(F.col("doc_id").alias("least"), F.col("text").cast("string").alias("text")).join(nodes, "least").select("node", "text")
    return materialise(texts.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "shingles")


def _renamed(rows: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """`rows` with `column` replaced by its component, if it is in one."""
    to = groups.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    return rows.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, max_distance: int = 14, segments: int = 3, soft: int = 5) -> DataFrame:
    """(doc_id, component_id) for every row of `docs` (doc_id, text): groups of texts joined by
    links of at least `similarity` between their sets of shingles of `words` words.

    Texts with the same set of shingles are copies.  Each round compares links exactly and joins
    what is as similar as asked: first those of spanning forests of texts that agree on a segment,
    then the nearest few of every two groups so far (a text alone is a group), and ever more of
    these, until all that meet in a bucket are in one group, are compared, or cannot be as similar.
    """
    marked = materialise(_sketches(docs, words, segments, soft), "fingerprints")
    sketch = F.first(F.struct("fp", "n", "parity", "soft")).alias("s")
    distinct = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("least"), sketch).select("node", "least", "s.*"), "distinct")
    known: list[DataFrame] = []

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the nodes of `pairs` beside those known."""
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        for held in known:
            ends = ends.join(held, "node", "left_anti")
        ends = materialise(distinct.join(ends, "node", "left_semi").select("node", "least"), "ends")
        if not ends.isEmpty():
            known.append(_shingle_sets(docs, ends, words))
        return reduce(DataFrame.union, known) if known else marked.sparkSession.createDataFrame([], "node bigint, shingles array<bigint>")

    def compared(pairs: DataFrame) -> DataFrame:
        """`pairs` with `similar`, whether their sets are as similar as asked."""
        sets = sets_of(pairs)
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return materialise(both.select(*pairs.columns, (shared >= similarity * (F.size("a") + F.size("b") - shared)).alias("similar")), "compared")

    def forest(bucket: np.ndarray, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _nearest_first(bucket, t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy(), max_distance)

    near = materialise(_by_bucket(_plain_indexed(distinct, segments), forest, "u bigint, v bigint", ["bucket"]).distinct(), "near")
    done = compared(near)
    labels = materialise(_renamed(distinct.select("node", F.col("node").alias("label")), "label", components(done.where("similar").select("u", "v"))), "labels")
    done, left, few = done.select("u", "v"), None, 16
    while left is None or not left.isEmpty():
        asked = labels if left is None else labels.join(left, "label", "left_semi")
        part = distinct.join(asked, "node").select("node", "fp", "soft", "label", "n", *[F.col("parity")[i].alias(f"p{i}") for i in range(4)])
        link = lambda bucket, t, few=few: _crossing(bucket, t, max_distance, similarity, few, segments)
        met = _by_bucket(_soft_indexed(part, segments), link, "u bigint, v bigint, lu bigint, lv bigint, more boolean", ["bucket"])
        met = materialise(met.groupBy("u", "v", "lu", "lv").agg(F.max("more").alias("more")), "met")
        pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
        fresh = compared(materialise(met.select(*pair, "lu", "lv").join(done, ["u", "v"], "left_anti"), "fresh"))
        groups = components(fresh.where("similar").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
        labels = materialise(_renamed(labels, "label", groups), "labels")
        more = _renamed(_renamed(met.where("more").select("lu", "lv").distinct(), "lu", groups), "lv", groups).where("lu <> lv")
        left = materialise(more.select(F.col("lu").alias("label")).union(more.select(F.col("lv").alias("label"))).distinct(), "left")
        done, few = done.union(fresh.select("u", "v")), 16 * few
    rooted = distinct.select("node", "least").join(labels, "node")
    first = rooted.join(rooted.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    return marked.select("doc_id", "node").join(first, "node").select("doc_id", "component_id")
