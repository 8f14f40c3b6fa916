"""URL filtering against a sorted digest array.

The entries (rules `host/path` and listed hosts) are keyed by 64-bit xxHash, sorted by Spark and
written as Arrow files, each a run of ascending keys with the full strings beside them.  Tasks
memory-map the files, probe the keys with a vectorised binary search and confirm the full string of
every hit, so that colliding keys do no harm.

A url asks for each suffix of its host of no more labels than some entry has, joined with each prefix
of its path of a length that some entry has; the longest rule that fits decides, else a listed host blocks, else the url is allowed.
Null urls and urls without `://` have an empty host and path and are allowed; repeated rows are
judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import filesystem, materialise, open_mapped, steps

_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host, A-Z lower-cased, and the path; both empty if the url has no `://`."""
    _, scheme, rest = (url or "").partition("://")
    if not scheme:
        return "", ""
    host = _HOST.match(rest).group()
    return host.translate(_LOWER), _PATH.match(rest, len(host)).group()


def host(url: str) -> Column:
    """`host_and_path`'s host as a Spark expression of the column `url`."""
    after = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    raw = F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*", 0)).otherwise(F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def build(entries: DataFrame, folder: str) -> tuple[list[str], list[int]]:
    """Write `entries` (entry, says) as digest files: their URIs and the lengths of entries' paths.

    A repeated entry keeps the greatest `says`.  The lists have one item a file and one a length.
    """
    distinct = entries.where("entry is not null").groupBy("entry").agg(F.max("says").alias("says")).withColumn("key", F.xxhash64("entry"))
    distinct = materialise(distinct, "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            system, path = filesystem(folder)
            system.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.arrow"
            table = pa.Table.from_batches(held).combine_chunks()
            with system.open_output_stream(f"{path}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"]})

    ranged = distinct.select("key", "entry", "says").repartitionByRange("key").sortWithinPartitions("key", "entry")
    uris = [r.uri for r in materialise(ranged.mapInArrow(run, "uri string"), "digest-files").collect()]
    slash = F.instr("entry", "/")
    lengths = distinct.select(F.when(slash > 0, F.length("entry") - slash + 1).otherwise(0).alias("n")).distinct()
    return uris, sorted(r.n for r in lengths.collect())


class DigestArray:
    """Memory-mapped digest files, and the most labels that an entry's host has in them."""

    def __init__(self, uris: list[str]):
        self.parts, self.labels = [], 0
        for uri in uris:
            batches = pa.ipc.open_file(open_mapped(uri)).read_all().combine_chunks()
            self.parts.append((batches["key"].to_numpy(), batches["entry"], batches["says"]))
            hosts = pc.list_element(pc.split_pattern(batches["entry"], "/", max_splits=1), 0)
            self.labels = max(self.labels, pc.max(pc.count_substring(hosts, ".")).as_py() + 1)

    def look_up(self, wanted: list[str]) -> list[str | None]:
        """What the array says of each string; None for strings it does not hold."""
        found: list[str | None] = [None] * len(wanted)
        keys = np.fromiter((xxh64_intdigest(w.encode(), 42) for w in wanted), np.uint64, len(wanted)).view(np.int64)
        for held, entry, says in self.parts:
            at = np.searchsorted(held, keys)
            for i in np.flatnonzero(held[np.minimum(at, len(held) - 1)] == keys):
                j = int(at[i])
                while j < len(held) and held[j] == keys[i]:
                    if entry[j].as_py() == wanted[i]:
                        found[i] = says[j].as_py()
                        break
                    j += 1
        return found


def judge(pages: DataFrame, uris: list[str], lengths: list[int], key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of `pages` (key, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(uris)
        for b in steps(batches, "url"):
            parsed = [host_and_path(u) for u in b.column("url").to_pylist()]
            wanted, of = [], []
            for row, (host, path) in enumerate(parsed):
                labels = host.rsplit(".", array.labels) if host else []
                if len(labels) > array.labels:
                    labels[0] = None  # what stands before the most labels that an entry has
                for i in range(labels[:1] == [None], len(labels)):
                    suffix = ".".join(labels[i:])
                    asked = [suffix + path[:n] for n in lengths if n <= len(path)]
                    wanted += asked
                    of += [row] * len(asked)
            rule: list[str | None] = [None] * len(parsed)
            verdict, listed = [None] * len(parsed), [False] * len(parsed)
            for row, entry, says in zip(of, wanted, array.look_up(wanted)):
                if says == "listed":
                    listed[row] = True
                elif says and (rule[row] is None or len(entry) > len(rule[row])):
                    rule[row], verdict[row] = entry, says
            verdict = [v or ("block" if on else "allow") for v, on in zip(verdict, listed)]
            columns = [pa.array(x, pa.string()) for x in ([h for h, _ in parsed], [p for _, p in parsed], rule, verdict)]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], [key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(key, F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")
