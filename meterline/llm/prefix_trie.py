"""The trie of all conversations' prefixes, built as a burst trie.

A conversation is a list of turns (role, text), a node each distinct list of first turns.  All
conversations start in one container.  A container that holds more than `capacity` turns bursts: one
of its conversations, drawn by hash, becomes a chain of trie heads; every other one leaves the chain
where its turns do, and goes on in the container of that place and its next turn.  So a long common
beginning takes one round, and containers shrink as parts do in a quicksort.  Containers that fit are
dealt to shards by their head, sorted, and swept into nodes; each gives the sums of its topmost node
to the head that it hangs on, and the heads add up from the last round to the first.

Equal conversations are folded to one, with their number, before anything is built.  Turn ids are 128
bits of SHA-256.  One row holds a conversation: 16 bytes a turn and its word count, whatever the texts.

Turns are taken by `turn`, null first; of equal ones the smaller id comes first.  Null roles and texts
are empty.  Rows without a conv_id belong to no conversation and are not counted.  No conversation, no
node.  Further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns up to which the heads of a round may be broadcast (about 100 bytes each).
BROADCAST_TURNS = 200_000
#: Bytes of joined ids in one row on the way to a digest.
_CHUNK = 1 << 18

_NODE = "up binary, up_depth int, conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, end_conv bigint"


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words) of (conv_id, turn, role, text): a row a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", key.alias("id"), F.regexp_count(text, F.lit(WORDS)).alias("words")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def with_shared_beginnings(convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversation c begins with the first h turns of c - c % every, and goes on with its own after
    its first h; h is the CRC-32 of the decimal c, modulo most + 1."""
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most).alias(f"first_{c}") for c in ("ids", "words")])
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    joined = convs.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left").withColumn("h", h.cast("int"))

    def column(name: str) -> Column:
        first, own = f"first_{name}", F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))
        return F.when(F.col(first).isNull(), own).otherwise(F.concat(F.slice(first, F.lit(1), F.col("h")), own)).alias(name)

    return joined.select("conv_id", column("ids"), column("words"))


# ---------------------------------------------------------------------- bursting


def _beside(rows: DataFrame, few: DataFrame, on: list[str], turns: int, how: str = "inner") -> DataFrame:
    """Join with a table of heads, which goes out to all tasks only where it is known to be small."""
    return rows.join(F.broadcast(few) if turns <= BROADCAST_TURNS else few, on, how)


def _burst(rows: DataFrame, over: DataFrame, turns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the containers in `over` (head, pivot): the heads' chains, the number that ends at each place
    of them, and the conversations in their new containers."""
    pivots = _beside(rows, over, ["head"], turns).where(F.col("conv") == F.col("pivot")).select("head", "at", "up", "up_depth", F.col("ids").alias("p_ids"), F.col("words").alias("p_words"))
    pivots = materialise(pivots, "trie-pivots")
    inside = _beside(rows, pivots.select("head", "p_ids"), ["head"], turns)
    same = F.zip_with("ids", F.slice("p_ids", F.lit(1), F.greatest(F.size("ids"), F.lit(1))), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    inside = inside.withColumn("leaves_at", F.when(differs == 0, F.size("ids")).otherwise(differs - 1).cast("int"))
    ends = inside.where(F.size("ids") == F.col("leaves_at")).select("head", F.col("leaves_at").alias("depth"), F.col("n").alias("end_n"), F.col("conv").alias("end_conv"))
    new = _digest(F.concat("head", F.col("leaves_at").cast("string").cast("binary"), F.get("ids", F.col("leaves_at"))))
    rest = inside.where(F.size("ids") > F.col("leaves_at")).select(new.alias("head"), (F.col("leaves_at") + 1).alias("at"), F.col("head").alias("up"), F.col("leaves_at").alias("up_depth"), "conv", "n", "ids", "words")
    chain = pivots.select("head", "up", "up_depth", "at", F.size("p_ids").alias("last"), "p_words", F.explode(F.sequence("at", F.size("p_ids"))).alias("depth"))
    chain = chain.withColumn("w", F.when(F.col("depth") == 0, 0).otherwise(F.get("p_words", F.col("depth") - 1)).cast("long")).drop("p_words")
    return chain, ends, rest


def _added_up(chain: DataFrame, ends: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of heads: what ends there, what hangs on them, and all below on their chain."""
    hung = tops.groupBy(F.col("up").alias("head"), F.col("up_depth").alias("depth")).agg(F.sum("n_convs").alias("c_n"), F.min("conv_id").alias("c_conv"), F.sum("n_leaves").alias("c_leaves"), F.sum("saved_tokens").alias("c_saved"), F.count(F.lit(1)).alias("c"))
    zero = {k: 0 for k in ("end_n", "c_n", "c_leaves", "c_saved", "c")}
    rows = chain.join(ends, ["head", "depth"], "left").join(hung, ["head", "depth"], "left").na.fill(zero)
    below = Window.partitionBy("head").orderBy(F.desc("depth"))
    leaf = ((F.col("depth") == F.col("last")) & (F.col("c") == 0)).cast("long")
    rows = rows.withColumn("n_convs", F.sum(F.col("end_n") + F.col("c_n")).over(below))
    rows = rows.withColumns({
        "conv_id": F.min(F.least("end_conv", "c_conv")).over(below),
        "n_children": F.col("c") + (F.col("depth") < F.col("last")).cast("long"),
        "n_leaves": F.sum(F.col("c_leaves") + leaf).over(below),
        "saved_tokens": F.sum((F.col("n_convs") - 1) * F.col("w") + F.col("c_saved")).over(below),
    })
    parent = F.lead("conv_id").over(below)
    rows = rows.withColumn("parent_conv_id", parent).withColumn("top", F.col("depth") == F.col("at"))
    return rows.select("head", *[F.when(F.col("top"), F.col(c)).alias(c) for c in ("up", "up_depth")], "top", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv")


# ---------------------------------------------------------------------- sweeping


def _nodes_of(at: int, rows: list[tuple]) -> list[list]:
    """The nodes of one container, of its sorted rows (conv, n, ids, words): first the topmost one."""
    parent, depth, conv, count, words, end = [], [], [], [], [], []
    chain: list[int] = []  # the open node of each depth from `at` on
    before: list[bytes] = []
    for c, n, ids, w in rows:
        same = 0
        for x, y in zip(before, ids):
            if x != y:
                break
            same += 1
        if chain:
            del chain[same - at + 1 :]
        for d in range(at + len(chain), len(ids) + 1):
            parent.append(chain[-1] if chain else -1)
            depth.append(d)
            conv.append(c)
            count.append(0)
            words.append(w[d - 1] if d else 0)
            end.append(None)
            chain.append(len(depth) - 1)
        count[chain[-1]] += n
        conv[chain[-1]] = min(conv[chain[-1]], c)
        end[chain[-1]] = c
        before = ids
    leaves, saved, children = [0] * len(depth), [0] * len(depth), [0] * len(depth)
    for i in range(len(depth) - 1, -1, -1):  # children stand after their parents
        if not children[i]:
            leaves[i] = 1
        saved[i] += (count[i] - 1) * words[i]
        p = parent[i]
        if p >= 0:
            count[p] += count[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            children[p] += 1
            conv[p] = min(conv[p], conv[i])
    return [conv, depth, [conv[p] if p >= 0 else None for p in parent], count, children, leaves, saved, end]


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("head", "at", "up", "up_depth", "conv", "n", "ids", "words")))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, ids) to nodes; one container is held at a time."""
    schema = pa.schema([("up", pa.binary()), ("up_depth", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int32()), *[(c, pa.int64()) for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv")], ("top", pa.bool_())])
    held: list[list] = [[] for _ in schema]
    for (_, at, up, up_depth), rows in groupby(_containers(batches), lambda r: r[:4]):
        made = _nodes_of(at, [r[4:] for r in rows])
        rest = [None] * (len(made[0]) - 1)
        for column, values in zip(held, [[up, *rest], [up_depth, *rest], *made, [True, *[False for _ in rest]]]):
            column.extend(values)
        if len(held[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(held, schema)], schema=schema)
            held = [[] for _ in schema]
    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(held, schema)], schema=schema)


# ---------------------------------------------------------------------- the trie


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, conv_id) to (rep, first, text): runs of decimal ids, joined by commas."""
    rep, first, parts, size = None, None, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "first": pa.array([first], pa.int64()), "text": pa.array([",".join(parts)])})

    for b in batches:
        for r, c in zip(b.column("rep").to_pylist(), b.column("conv_id").to_pylist()):
            if parts and (r != rep or size > _CHUNK):
                yield row()
                parts, size = [], 0
            if not parts:
                rep, first = r, c
            parts.append(str(c))
            size += len(parts[-1]) + 1
    if parts:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, first, text) to (rep, sha): one run is held at a time."""
    runs = (r for b in batches for r in zip(b.column("rep").to_pylist(), b.column("text").to_pylist()))
    for rep, of in groupby(runs, lambda r: r[0]):
        digest, comma = hashlib.sha256(), b""
        for _, text in of:
            digest.update(comma + text.encode())
            comma = b","
        yield pa.RecordBatch.from_pydict({"end_conv": pa.array([rep], pa.int64()), "sha": [digest.hexdigest()]})


def _digests(members: DataFrame, same: DataFrame) -> DataFrame:
    """(end_conv, sha) of each group of equal conversations: its ids go by range to the tasks, which
    join runs of them, and a group's runs are hashed in order."""
    placed = members.join(same, "whole").select("rep", "conv_id")
    runs = placed.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_joined, "rep bigint, first bigint, text string")
    return runs.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_hashed, "end_conv bigint, sha string")


def prefix_trie(convs: DataFrame, capacity: int = 2048) -> DataFrame:
    """A row a node, of (conv_id, ids, words): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    whole = _digest(F.array_join(F.transform("ids", F.hex), ",").cast("binary"))
    convs = materialise(convs.withColumn("whole", whole), "trie-conversations")
    folded = materialise(convs.groupBy("whole").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")), "trie-folded")
    digests = _digests(convs.select("whole", "conv_id"), folded.where("n > 1").select("whole", "rep"))

    first = convs.join(folded.select(F.col("rep").alias("conv_id"), "n"), "conv_id")
    root = [F.unhex(F.lit("00")).alias("head"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("int").alias("up_depth")]
    rows = materialise(first.select(*root, F.col("conv_id").alias("conv"), "n", "ids", "words"), "trie-rows")

    fit, rounds = [], []
    while True:
        drawn = F.min_by("conv", F.xxhash64("conv", F.lit(len(rounds))))
        over = rows.groupBy("head").agg(F.sum(F.size("ids") - F.col("at") + 1).alias("turns"), drawn.alias("pivot")).where(F.col("turns") > capacity)
        over = materialise(over.select("head", "pivot"), "trie-over")
        heads = over.count()
        if not heads:
            fit.append(rows)
            break
        turns = over.join(rows, (over["head"] == rows["head"]) & (F.col("pivot") == F.col("conv"))).agg(F.sum(F.size("ids") + 1)).first()[0]
        fit.append(_beside(rows, over.select("head"), ["head"], heads, "left_anti"))
        chain, ends, rest = _burst(rows, over, turns)
        rounds.append((chain, materialise(ends, "trie-ends")))
        rows = materialise(rest, "trie-rows")

    pool = fit[0]
    for more in fit[1:]:
        pool = pool.unionByName(more)
    shards = pool.repartition("head").sortWithinPartitions("head", "ids")
    swept = materialise(shards.mapInArrow(_sweep, f"{_NODE}, top boolean"), "trie-swept")

    totals = ["up", "up_depth", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    tops, heads = swept.where("top").select(totals), []
    for chain, ends in reversed(rounds):
        heads.append(materialise(_added_up(chain, ends, tops), "trie-heads"))
        tops = tops.unionByName(heads[-1].where("top").select(totals))

    nodes = swept
    for h in heads:
        nodes = nodes.unionByName(h.drop("head"))
    if heads:
        above = heads[0]
        for h in heads[1:]:
            above = above.unionByName(h)
        above = above.select(F.col("head").alias("up"), F.col("depth").alias("up_depth"), F.col("conv_id").alias("above"))
        hung = _beside(nodes.where("top"), above, ["up", "up_depth"], above.count(), "left").withColumn("parent_conv_id", F.col("above"))
        nodes = nodes.where("not top").unionByName(hung.select(*nodes.columns))
    ended = nodes.where("end_conv is not null").join(digests, "end_conv", "left")
    sha = F.coalesce("sha", F.sha2(F.col("end_conv").cast("string").cast("binary"), 256))
    inner = nodes.where("end_conv is null").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    shown = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return ended.withColumn("ends_sha256", sha).select(shown).unionByName(inner.select(shown))
