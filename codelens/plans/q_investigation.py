"""Investigation, collaboration and share-link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import investigation as I
from codelens.plans import duck
from codelens.plans.fixtures import duckdb_with
from codelens.plans.registry import Views, query

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _ts(c: str):
    return F.date_format(c, TS_FMT).alias(c)


def _ev(spark, sf_dir):
    return Views(spark, sf_dir)("investigation_events")


D_STATE = ("state", """SELECT kind, entity_id, arg_min(snapshot_id, seq) AS snapshot_id,
  arg_max(status, seq) FILTER (WHERE status IS NOT NULL AND status <> '') AS status,
  CAST(count(*) AS BIGINT) AS events, min(ts) AS created_at, max(ts) AS updated_at
FROM investigation_events GROUP BY kind, entity_id""")


def d_inv(body: str, ctes=()) -> str:
    return duckdb_with(["investigation_events"], [D_STATE, *ctes]) + body


STATE_COLS = f"kind, entity_id, snapshot_id, status, events, {duck.ts_text('created_at')} AS created_at, {duck.ts_text('updated_at')} AS updated_at"


def _state_cols(df, extra=()):
    return df.select("kind", "entity_id", "snapshot_id", "status", "events", _ts("created_at"), _ts("updated_at"),
                     *extra)


@query("win_version_latest", d_inv(f"SELECT {STATE_COLS} FROM state"))
def win_version_latest(spark, sf_dir):
    return _state_cols(I.entity_state(_ev(spark, sf_dir)))


@query("inv_questions", d_inv(f"""
SELECT {STATE_COLS}, {duck.ts_text('a.answered_at')} AS answered_at FROM state s LEFT JOIN (
  SELECT entity_id, max(ts) AS answered_at FROM investigation_events WHERE kind = 'question' AND status = 'answered'
  GROUP BY entity_id) a USING (entity_id) WHERE s.kind = 'question'"""))
def inv_questions(spark, sf_dir):
    q = I.questions(_ev(spark, sf_dir))
    return _state_cols(q, [_ts("answered_at")])


@query("inv_hypotheses", d_inv(f"""
SELECT {STATE_COLS}, {duck.ts_text('h.tested_at')} AS tested_at, round(h.confidence, 6) AS confidence FROM state s LEFT JOIN (
  SELECT entity_id, max(ts) FILTER (WHERE status IN ('confirmed', 'refuted')) AS tested_at,
    arg_max(confidence, seq) FILTER (WHERE confidence BETWEEN 0 AND 1) AS confidence
  FROM investigation_events WHERE kind = 'hypothesis' GROUP BY entity_id) h USING (entity_id) WHERE s.kind = 'hypothesis'"""))
def inv_hypotheses(spark, sf_dir):
    h = I.hypotheses(_ev(spark, sf_dir))
    return _state_cols(h, [_ts("tested_at"), F.round("confidence", 6).alias("confidence")])


@query("inv_findings", duckdb_with(["investigation_events"]) + f"""
SELECT seq, entity_id, snapshot_id, {duck.ts_text('ts')} AS ts, false AS verified FROM investigation_events WHERE kind = 'finding'""")
def inv_findings(spark, sf_dir):
    return I.findings(_ev(spark, sf_dir)).withColumn("ts", F.date_format("ts", TS_FMT))


@query("inv_blockers", d_inv(f"""
SELECT {STATE_COLS}, {duck.ts_text('r.resolved_at')} AS resolved_at FROM state s LEFT JOIN (
  SELECT entity_id, max(ts) AS resolved_at FROM investigation_events WHERE kind = 'blocker' AND status = 'resolved'
  GROUP BY entity_id) r USING (entity_id) WHERE s.kind = 'blocker'"""))
def inv_blockers(spark, sf_dir):
    return _state_cols(I.blockers(_ev(spark, sf_dir)), [_ts("resolved_at")])


@query("agg_investigation", d_inv("""
SELECT snapshot_id,
  CAST(count_if(kind = 'question' AND status = 'open') AS BIGINT) AS questions_open,
  CAST(count_if(kind = 'question' AND status = 'investigating') AS BIGINT) AS questions_investigating,
  CAST(count_if(kind = 'question' AND status = 'answered') AS BIGINT) AS questions_answered,
  CAST(count_if(kind = 'blocker' AND status = 'open') AS BIGINT) AS blockers_open,
  CAST(count_if(kind = 'blocker' AND status = 'investigating') AS BIGINT) AS blockers_investigating,
  CAST(count_if(kind = 'blocker' AND status = 'resolved') AS BIGINT) AS blockers_resolved,
  CAST(count_if(kind = 'finding' AND status = 'verified') AS BIGINT) AS findings_verified,
  CAST(count_if(kind = 'hypothesis') AS BIGINT) AS hypotheses
FROM state GROUP BY snapshot_id"""))
def agg_investigation(spark, sf_dir):
    return I.investigation_summary(_ev(spark, sf_dir))


D_LOG = """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS sender,
  CASE role WHEN 'assistant' THEN 'recommendation' WHEN 'user' THEN 'decision' ELSE 'message' END AS entry_type,
  CAST(length(text) AS BIGINT) AS chars FROM conversations"""


@query("inv_log", D_LOG)
def inv_log(spark, sf_dir):
    return I.communication_log(Views(spark, sf_dir)("conversations"))


@query("agg_collaboration", f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS interactions, CAST(max(turn) AS BIGINT) AS last_turn,
  CAST(count_if(entry_type = 'recommendation') AS BIGINT) AS recommendations,
  CAST(count_if(entry_type = 'decision') AS BIGINT) AS decisions,
  CAST(count_if(sender = 'ai') AS BIGINT) AS ai_turns, CAST(count_if(sender = 'human') AS BIGINT) AS human_turns
FROM ({D_LOG}) l GROUP BY conv_id""")
def agg_collaboration(spark, sf_dir):
    return I.collaboration(I.communication_log(Views(spark, sf_dir)("conversations")))


@query("agg_tool_usage", duckdb_with(["tool_output"]) + """
SELECT session_id, CAST(sum(n) AS BIGINT) AS uses, '{' || string_agg('"' || tool || '":' || CAST(n AS VARCHAR), ',' ORDER BY tool) || '}' AS tool_usage
FROM (SELECT project_id AS session_id, tool, count(*) AS n FROM tool_output WHERE tool IS NOT NULL GROUP BY ALL) t GROUP BY session_id""")
def agg_tool_usage(spark, sf_dir):
    """Tools of each session by use; the sessions are the projects whose captured output names the tools."""
    uses = Views(spark, sf_dir)("tool_output").select(F.col("project_id").alias("session_id"), "tool")
    return I.tool_usage(uses).withColumn("tool_usage", F.to_json("tool_usage"))


# ------------------------------------------------------------ share links

D_OPTS = ("opts", """SELECT link_id, snapshot_id, created_at, CASE WHEN max_accesses > 0 THEN max_accesses END AS max_accesses,
  CASE WHEN expires_in_hours > 0 THEN created_at + to_hours(CAST(expires_in_hours AS BIGINT)) END AS expires_at FROM share_links""")
D_ACC = ("acc", """SELECT a.event_id, a.link_id, a.ts, row_number() OVER (PARTITION BY a.link_id ORDER BY a.ts, a.event_id) AS access_no,
  o.created_at IS NOT NULL AS found, o.expires_at, o.max_accesses
FROM link_access a LEFT JOIN opts o USING (link_id)""")
D_GRANT = ("grants", """SELECT *, found AND (expires_at IS NULL OR ts <= expires_at) AND (max_accesses IS NULL OR access_no <= max_accesses) AS granted,
  CASE WHEN NOT found THEN 'not found' WHEN NOT (expires_at IS NULL OR ts <= expires_at) THEN 'expired'
       WHEN NOT (max_accesses IS NULL OR access_no <= max_accesses) THEN 'access limit reached' END AS reason FROM acc""")


def d_links(body: str) -> str:
    return duckdb_with(["share_links", "link_access"], [D_OPTS, D_ACC, D_GRANT]) + body


@query("join_link_access", d_links(f"""
SELECT event_id, link_id, {duck.ts_text('ts')} AS ts, CAST(access_no AS BIGINT) AS access_no, granted, reason FROM grants"""))
def join_link_access(spark, sf_dir):
    v = Views(spark, sf_dir)
    a = I.link_accesses(v("share_links"), v("link_access"))
    return a.withColumn("ts", F.date_format("ts", TS_FMT))


@query("flt_link_valid", d_links("""
SELECT o.link_id, CAST(coalesce(g.n, 0) AS BIGINT) AS access_count,
  NOT (o.expires_at IS NOT NULL AND (SELECT max(ts) FROM link_access) > o.expires_at)
    AND NOT (o.max_accesses IS NOT NULL AND coalesce(g.n, 0) >= o.max_accesses) AS is_valid,
  CASE WHEN o.expires_at IS NOT NULL AND (SELECT max(ts) FROM link_access) > o.expires_at THEN 'expired'
       WHEN o.max_accesses IS NOT NULL AND coalesce(g.n, 0) >= o.max_accesses THEN 'access limit reached' END AS reason
FROM opts o LEFT JOIN (SELECT link_id, count(*) AS n FROM grants WHERE granted GROUP BY link_id) g USING (link_id)"""))
def flt_link_valid(spark, sf_dir):
    v = Views(spark, sf_dir)
    acc = v("link_access")
    return I.link_validity(v("share_links"), acc, acc.select(F.max("ts")).scalar())


@query("flt_link_perms", duckdb_with(["share_links"]) + """
SELECT link_id, true AS can_read, true AS can_download, link_id % 2 = 0 AS can_fork,
  CASE WHEN link_id % 2 = 0 THEN 'read,download,fork' ELSE 'read,download' END AS fields
FROM share_links""")
def flt_link_perms(spark, sf_dir):
    """Even links are created with ``{"fork": true}``; the rest keep the defaults."""
    links = Views(spark, sf_dir)("share_links")
    given = F.create_map(F.lit("fork"), F.col("link_id") % 2 == 0)
    p = I.link_permissions(links, given)
    granted = F.filter(F.array(*[F.when(F.col("permissions")[k], F.lit(k)) for k in ("read", "download", "fork")]),
                       lambda x: x.isNotNull())
    return p.select("link_id", F.col("permissions")["read"].alias("can_read"),
                    F.col("permissions")["download"].alias("can_download"),
                    F.col("permissions")["fork"].alias("can_fork"), F.array_join(granted, ",").alias("fields"))
