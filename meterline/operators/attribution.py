"""Sessions to accounts, threads and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_accounts(telemetry: DataFrame, support: DataFrame) -> DataFrame:
    """(session_id, account_id, confidence, basis) of both candidate tables (session_id, account_id).

    One candidate account verifies a session, more make it ambiguous; telemetry names the basis
    where it has the session.
    """
    tagged = telemetry.select("session_id", "account_id", F.lit(True).alias("t")).unionByName(support.select("session_id", "account_id", F.lit(False).alias("t")))
    found = tagged.where("session_id is not null and account_id is not null").groupBy("session_id").agg(F.min("account_id").alias("a"), F.max("account_id").alias("b"), F.max("t").alias("t"))
    one = F.col("a") == F.col("b")
    basis = F.when(~one, "account-conflict").when(F.col("t"), "telemetry").otherwise("support-session")
    return found.select("session_id", F.when(one, F.col("a")).otherwise("ambiguous").alias("account_id"), F.when(one, "session-verified").otherwise("ambiguous-account").alias("confidence"), basis.alias("basis"))


def default_attribution(has_config: Column) -> tuple[Column, Column]:
    """Confidence and basis of unattributed rows: whether the source's configuration names a user."""
    return F.when(has_config, "current-config-only").otherwise("source-only"), F.when(has_config, "current-config").otherwise("none")


def sidechain(confidence: Column, basis: Column, is_subagent: Column, has_identity: Column) -> tuple[Column, Column]:
    """A row's own confidence and basis from its parent session's: a conflict stays, then an
    unresolved sidechain, then a child session, then the session's own."""
    conflict = confidence == "ambiguous-account"
    return (
        F.when(conflict, "ambiguous-account").when(is_subagent & ~has_identity, "ambiguous-sidechain").when(is_subagent, "parent-session").otherwise(confidence),
        F.when(conflict, "account-conflict").when(is_subagent, "parent-session").otherwise(basis),
    )


def attribute_accounts(rows: DataFrame, accounts: DataFrame, has_config: bool = False) -> DataFrame:
    """Fresh message rows (session_id, parent_session_id, is_subagent) with account, confidence and
    basis by the transcript's session; a child has an identity if its session is its own."""
    config, none = default_attribution(F.lit(has_config))
    known = accounts.select(F.col("session_id").alias("_s"), F.col("account_id").alias("_a"), F.col("confidence").alias("_c"), F.col("basis").alias("_b"))
    base = F.coalesce("parent_session_id", "session_id")
    joined = rows.drop("account_id", "attribution_confidence", "attribution_basis").join(known, base == F.col("_s"), "left")
    confidence, basis = sidechain(F.coalesce("_c", config), F.coalesce("_b", none), F.col("is_subagent"), F.col("session_id") != base)
    return joined.withColumns({"account_id": F.coalesce("_a", F.lit("unattributed")), "attribution_confidence": confidence, "attribution_basis": basis}).drop("_s", "_a", "_c", "_b")


def reattribute(ledger: DataFrame, accounts: DataFrame, has_config: bool = False) -> DataFrame:
    """Stored message rows after the account tables changed, without reading transcripts.

    Rows of sessions that the tables no longer name keep a verified account; others fall back to
    the source's default.
    """
    config, none = default_attribution(F.lit(has_config))
    known = accounts.select(F.col("session_id").alias("_s"), F.col("account_id").alias("_a"), F.col("confidence").alias("_c"), F.col("basis").alias("_b"))
    base = F.coalesce("parent_session_id", "session_id")
    keeps = F.col("attribution_confidence") == "session-verified"
    joined = ledger.join(known, base == F.col("_s"), "left")
    account = F.coalesce("_a", F.when(keeps, F.col("account_id")).otherwise("unattributed"))
    confidence, basis = sidechain(
        F.coalesce("_c", F.when(keeps, F.col("attribution_confidence")).otherwise(config)),
        F.coalesce("_b", F.when(keeps, F.col("attribution_basis")).otherwise(none)),
        F.col("is_subagent"),
        F.col("session_id") != base,
    )
    mine = F.col("provider") == "message"
    new = {"account_id": account, "attribution_confidence": confidence, "attribution_basis": basis}
    return joined.withColumns({c: F.when(mine, x).otherwise(F.col(c)) for c, x in new.items()}).drop("_s", "_a", "_c", "_b")


def enrich_threads(ledger: DataFrame, threads: DataFrame) -> DataFrame:
    """Counter rows by the exact path of a thread (path, id, model, parent_id, is_subagent): its
    session, parent and kind, and its model where the row's is unknown; the account is reset."""
    known = threads.where("path is not null").groupBy("path").agg(F.max_by(F.struct("id", "model", "parent_id", "is_subagent"), "id").alias("_t"))
    joined = ledger.join(known.withColumnRenamed("path", "_p"), F.col("source_path") == F.col("_p"), "left")
    has, mine = F.col("_p").isNotNull(), F.col("provider") == "counter"
    new = {
        "session_id": F.coalesce("_t.id", "session_id"),
        "parent_session_id": F.when(has, F.col("_t.parent_id")).otherwise(F.col("parent_session_id")),
        "is_subagent": F.when(has, F.coalesce("_t.is_subagent", F.lit(False))).otherwise(F.col("is_subagent")),
        "model": F.when(F.col("model") == "unknown", F.coalesce("_t.model", "model")).otherwise(F.col("model")),
        "account_id": F.lit("unattributed"),
        "current_auth_account_id": F.lit(None).cast("string"),
        "attribution_confidence": F.lit("source-only"),
        "attribution_basis": F.lit("none"),
    }
    return joined.withColumns({c: F.when(mine, x).otherwise(F.col(c)) for c, x in new.items()}).drop("_p", "_t")


def session_tree(ledger: DataFrame) -> DataFrame:
    """(session_id, parent_session_id, parent_known): child sessions and whether their parent has rows."""
    pairs = ledger.where("parent_session_id is not null").select("session_id", "parent_session_id").distinct()
    sessions = ledger.select(F.col("session_id").alias("_s")).distinct()
    return pairs.join(sessions, F.col("parent_session_id") == F.col("_s"), "left").select("session_id", "parent_session_id", F.col("_s").isNotNull().alias("parent_known"))
