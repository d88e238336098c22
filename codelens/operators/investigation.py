"""Investigation tracking and share links as event tables.

Entities (questions, hypotheses, findings, blockers) are event-sourced: the
state of an entity is an aggregation of its events (latest non-empty status
by ``seq``, last time a status was reached), computed with ``max_by`` and
partial aggregation, so an entity with very many events is still reduced
map-side. Share-link accesses are numbered per link with the bucketed dense
index (a hot link is split across tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions.windows import dense_index


def entity_state(events: DataFrame, kind: str | None = None) -> DataFrame:
    """WIN_VERSION_LATEST / INV_*: newest non-empty status per entity, first and last event times."""
    e = events if kind is None else events.where(F.col("kind") == kind)
    st = F.col("status")
    nonempty = st.isNotNull() & (st != "")
    return e.groupBy("kind", "entity_id").agg(
        F.min_by("snapshot_id", "seq").alias("snapshot_id"),
        F.max_by(F.when(nonempty, st), F.when(nonempty, F.col("seq"))).alias("status"),
        F.count(F.lit(1)).cast("bigint").alias("events"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def questions(events: DataFrame) -> DataFrame:
    """INV_QUESTIONS: status; answered_at = last time the question reached 'answered'."""
    s = entity_state(events, "question")
    ans = (events.where((F.col("kind") == "question") & (F.col("status") == "answered"))
           .groupBy("entity_id").agg(F.max("ts").alias("answered_at")))
    return s.join(ans, "entity_id", "left")


def hypotheses(events: DataFrame) -> DataFrame:
    """INV_HYPOTHESES: status; tested_at = last confirmed/refuted time; confidence only from values in [0, 1]."""
    h = events.where(F.col("kind") == "hypothesis")
    s = entity_state(events, "hypothesis")
    ok = F.col("confidence").between(0, 1)
    extra = h.groupBy("entity_id").agg(
        F.max(F.when(F.col("status").isin("confirmed", "refuted"), F.col("ts"))).alias("tested_at"),
        F.max_by(F.when(ok, F.col("confidence")), F.when(ok, F.col("seq"))).alias("confidence"))
    return s.join(extra, "entity_id", "left")


def findings(events: DataFrame) -> DataFrame:
    """INV_FINDINGS: every finding event appends a finding, verified = false."""
    return (events.where(F.col("kind") == "finding")
            .select("seq", "entity_id", "snapshot_id", "ts", F.lit(False).alias("verified")))


def blockers(events: DataFrame) -> DataFrame:
    """INV_BLOCKERS: status; resolved_at = last time the blocker reached 'resolved'."""
    s = entity_state(events, "blocker")
    res = (events.where((F.col("kind") == "blocker") & (F.col("status") == "resolved"))
           .groupBy("entity_id").agg(F.max("ts").alias("resolved_at")))
    return s.join(res, "entity_id", "left")


def investigation_summary(events: DataFrame) -> DataFrame:
    """AGG_INVESTIGATION: per snapshot, questions and blockers by status, verified findings."""
    s = entity_state(events)
    k, st = F.col("kind"), F.col("status")
    return s.groupBy("snapshot_id").agg(
        *[F.count_if((k == "question") & (st == v)).cast("bigint").alias(f"questions_{v}")
          for v in ("open", "investigating", "answered")],
        *[F.count_if((k == "blocker") & (st == v)).cast("bigint").alias(f"blockers_{v}")
          for v in ("open", "investigating", "resolved")],
        F.count_if((k == "finding") & (st == "verified")).cast("bigint").alias("findings_verified"),
        F.count_if(k == "hypothesis").cast("bigint").alias("hypotheses"),
    )


def communication_log(conversations: DataFrame) -> DataFrame:
    """INV_LOG: conversation turns as communications: user -> human, assistant -> ai, others kept."""
    role = F.col("role")
    sender = F.when(role == "user", "human").when(role == "assistant", "ai").otherwise(role)
    kind = F.when(role == "assistant", "recommendation").when(role == "user", "decision").otherwise("message")
    return conversations.select("conv_id", "turn", sender.alias("sender"), kind.alias("entry_type"),
                                F.length("text").cast("bigint").alias("chars"))


def collaboration(log: DataFrame) -> DataFrame:
    """AGG_COLLABORATION: per session interactions, last turn, recommendations and decisions."""
    t = F.col("entry_type")
    return log.groupBy("conv_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("interactions"),
        F.max("turn").cast("bigint").alias("last_turn"),
        F.count_if(t == "recommendation").cast("bigint").alias("recommendations"),
        F.count_if(t == "decision").cast("bigint").alias("decisions"),
        F.count_if(F.col("sender") == "ai").cast("bigint").alias("ai_turns"),
        F.count_if(F.col("sender") == "human").cast("bigint").alias("human_turns"),
    )


def tool_usage(uses: DataFrame, session: str = "session_id") -> DataFrame:
    """AGG_COLLABORATION tool usage: (session, uses, tool_usage), a map from each tool to how often the session used it.

    ``uses`` are (session, tool), one row a use; uses without a tool are not
    counted. A map has one entry a tool, in the tools' order, not one a use.
    """
    counted = uses.where(F.col("tool").isNotNull()).groupBy(session, "tool").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(session).agg(F.sum("n").cast("bigint").alias("uses"),
                                        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("tool_usage"))


# ------------------------------------------------------------ share links

def link_options(links: DataFrame) -> DataFrame:
    """Options as stored: expiry only for a positive hour count, access limit only when positive."""
    hours = F.col("expires_in_hours")
    return links.select(
        "link_id", "snapshot_id", "created_at",
        F.when(F.col("max_accesses") > 0, F.col("max_accesses")).alias("max_accesses"),
        F.when(hours > 0, F.col("created_at") + F.make_dt_interval(hours=hours.cast("int"))).alias("expires_at"))


def link_accesses(links: DataFrame, accesses: DataFrame) -> DataFrame:
    """JOIN_LINK_ACCESS: each access numbered per link by time; granted while unexpired and under the limit."""
    # microseconds since the epoch of a local (NTZ) time, independent of the session time zone
    timed = accesses.withColumn("_us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    numbered = dense_index(timed, ["link_id"], "_us", out="access_no", tiebreak=("event_id",)).drop("_us")
    opts = link_options(links)
    j = numbered.join(opts, "link_id", "left")
    found = F.col("created_at").isNotNull()
    live = F.col("expires_at").isNull() | (F.col("ts") <= F.col("expires_at"))
    under = F.col("max_accesses").isNull() | (F.col("access_no") <= F.col("max_accesses"))
    reason = (F.when(~found, "not found").when(~live, "expired").when(~under, "access limit reached"))
    return j.select("event_id", "link_id", "ts", "access_no", (found & live & under).alias("granted"),
                    reason.alias("reason"))


def link_validity(links: DataFrame, accesses: DataFrame, as_of) -> DataFrame:
    """FLT_LINK_VALID: valid at ``as_of`` if not expired and granted accesses < limit."""
    granted = (link_accesses(links, accesses).where("granted")
               .groupBy("link_id").agg(F.count(F.lit(1)).cast("bigint").alias("access_count")))
    o = link_options(links).join(granted, "link_id", "left").fillna(0, ["access_count"])
    expired = F.col("expires_at").isNotNull() & (as_of > F.col("expires_at"))
    full = F.col("max_accesses").isNotNull() & (F.col("access_count") >= F.col("max_accesses"))
    return o.select("link_id", "access_count", (~expired & ~full).alias("is_valid"),
                    F.when(expired, "expired").when(full, "access limit reached").alias("reason"))


def link_permissions(links: DataFrame, given) -> DataFrame:
    """FLT_LINK_PERMS: defaults read/download true, fork false, overlaid by the given map; fields by permission."""
    defaults = F.create_map(F.lit("read"), F.lit(True), F.lit("download"), F.lit(True), F.lit("fork"), F.lit(False))
    perms = F.map_zip_with(defaults, given, lambda k, d, g: F.coalesce(g, d))
    return links.withColumn("permissions", perms)
