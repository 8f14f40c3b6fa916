"""Secret scanning with an incremental ledger of blobs.

Every version of a text is content-addressed by the SHA-256 of its bytes.  The ledger holds, for
each blob and rule version scanned so far, the spans found; only blobs it has not seen under the
current rule version are scanned, once each, and findings are joined back to every path (here: row)
that holds the blob.

A null text is the empty blob; repeated rows share a blob and each gets its findings; null keys are
kept; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import materialise, scratch, steps

#: Rises with every change of the rules, so that known blobs are scanned again.
RULES_VERSION = 2

# Kinds in their order within one start, the base kinds first.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("private_key", "github", "slack", "jwt", "url_password")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WHOLE = {
    "access": re.compile(r"AKIA[A-Z0-9]{14,}"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
    # to its END line, or as far as there are runs of base64 if the key is cut
    "private_key": re.compile(
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
        r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|(?:(?:\s+[A-Za-z0-9+/=]{20,})+(?:\s+[A-Za-z0-9+/]+=+|\s+[A-Za-z0-9+/]+(?=\s*(?:\Z|-----)))?)?)"
    ),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "url_password": re.compile(r"(?<=://)[^\s/:@]+:[^\s/:@]{6,}(?=@)"),
}
_RANK = {kind: i for i, kind in enumerate(BASE_KINDS + ADDED_KINDS)}

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed.

    Spans of one kind don't overlap.  A hex or access run of too few characters holds no longer
    one, so the patterns ask for the length at once; an assignment's short value still uses up its
    text, so short ones are dropped afterwards.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for kind, pattern in _WHOLE.items():
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], _RANK[x[0]]))


def redact(text: str | None, spans: list[tuple[int, int]], mark: str = "[REDACTED]") -> str | None:
    """`text` with each run of overlapping spans replaced by `mark`."""
    if not text or not spans:
        return text
    out, at, upto = [], 0, 0
    for start, end in sorted(spans):
        if start >= upto:
            out += [text[at:start], mark]
        upto = max(upto, end)
        at = upto
    return "".join(out) + text[at:]


def blob() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def _scan(texts: DataFrame, rules_version: int) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array([rules_version] * b.num_rows, pa.int64()), pa.array(spans, kind)], ["blob", "rules", "spans"])

    return texts.select("blob", "text").mapInArrow(run, f"blob string, rules bigint, spans {SPANS}")


def scan(versions: DataFrame, key: list[str], ledger: str | None = None, rules_version: int = RULES_VERSION) -> DataFrame:
    """(*key, blob, spans) for every row of `versions` (*key, text).

    `ledger` is the folder of the ledger, read before and appended to; None starts a new one.
    """
    spark = versions.sparkSession
    ledger = ledger or scratch(spark, "blob-ledger")
    paths = materialise(versions.select(*key, blob().alias("blob")), "paths")
    first = paths.groupBy("blob").agg(F.min(F.struct(*key)).alias("at"))
    try:
        seen = spark.read.parquet(ledger).where(F.col("rules") == rules_version).select("blob")
        first = first.join(seen, "blob", "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    chosen = first.select("blob", *[F.col(f"at.{k}").alias(f"_{k}") for k in key])
    rows = versions.select(*key, F.col("text").cast("string").alias("text")).withColumn("_blob", blob())
    same = F.col("blob") == F.col("_blob")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    fresh = _scan(rows.join(chosen, same), rules_version).dropDuplicates(["blob"])
    fresh.write.mode("append").parquet(ledger)
    known = spark.read.parquet(ledger).where(F.col("rules") == rules_version).select("blob", "spans").dropDuplicates(["blob"])
    return paths.join(known, "blob", "left").select(*key, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of `scan`'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(_count, BASE_KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "blob")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
