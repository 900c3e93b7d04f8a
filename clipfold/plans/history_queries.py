"""Queries over histories: the ledger as an automaton, journals, order across ranges, and upserts with several identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clipfold.operators import articles, ledger, paging
from clipfold.plans.text_queries import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'prepare' ELSE 'finalize' END AS action,
 CASE WHEN floor(value) % 5 = 0 THEN 's' ELSE 'r' END AS request, CASE WHEN floor(value) % 7 > 0 THEN 'a' || CAST(floor(value) % 2 AS INTEGER) END AS audit, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 9 = 0 THEN 'LEASE_EXPIRED' END AS refused FROM events),
 p AS (SELECT user_id, min(seq) AS asked_at, arg_min(request, seq) AS asked FROM e WHERE action = 'prepare' AND refused IS NULL GROUP BY 1),
 f AS (SELECT user_id, min(seq) AS done_at, arg_min(audit, seq) AS done FROM e JOIN p USING (user_id) WHERE action = 'finalize' AND refused IS NULL AND audit IS NOT NULL AND request = asked AND seq > asked_at GROUP BY 1),
 s AS (SELECT *, CASE WHEN done_at < seq THEN 'completed' WHEN asked_at < seq THEN 'reserved' ELSE 'none' END AS found FROM e LEFT JOIN p USING (user_id) LEFT JOIN f USING (user_id))
 SELECT user_id, event_id, found, CASE WHEN refused IS NOT NULL THEN refused WHEN action = 'prepare' THEN CASE WHEN found = 'none' THEN 'prepared' WHEN request = asked THEN found ELSE 'INVOCATION_CONFLICT' END
 WHEN found = 'none' THEN 'INVOCATION_NOT_FOUND' WHEN request <> asked THEN 'INVOCATION_CONFLICT' WHEN found = 'reserved' THEN CASE WHEN audit IS NULL THEN 'INVALID_INVOCATION_AUDIT' ELSE 'completed' END
 WHEN audit = done THEN 'already_completed' ELSE 'INVOCATION_CONFLICT' END AS outcome FROM s""")
def ledger_transitions(spark, sf_dir):
    """The events of a user as requests and ends of one call."""
    whole = F.floor("value")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seq"), F.when(F.col("event_type").isin("click", "view"), "prepare").otherwise("finalize").alias("action"),
        F.when(whole % 5 == 0, "s").otherwise("r").alias("request"), F.when(whole % 7 > 0, F.concat(F.lit("a"), (whole % 2).cast("string"))).alias("audit"),
        F.when(F.get_json_object("props", "$.k").cast("int") % 9 == 0, "LEASE_EXPIRED").alias("refused"),
    )
    return ledger.transitions(rows, ["user_id"], "seq", chunk=16).select("user_id", "event_id", "found", "outcome")


@query("""WITH j AS (SELECT o_custkey AS run, row_number() OVER w - 1 AS revision, CAST(floor(o_totalprice) AS BIGINT) AS calls, o_orderstatus = 'P' AS unpriced, CASE WHEN o_orderpriority = '5-LOW' THEN [] ELSE list(o_orderkey) OVER (w ROWS UNBOUNDED PRECEDING) END AS attempts,
 o_orderstatus = 'F' AS done, o_orderpriority AS output, o_totalprice > 300000 AS three, CASE WHEN o_totalprice > 400000 THEN o_orderstatus END AS reason, o_orderdate AS moment FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 l AS (SELECT a.*, b.calls AS pc, b.unpriced AS pu, b.attempts AS pa, b.done AS pd, b.output AS po, b.three AS p3, b.reason AS pr, b.moment AS pt FROM j a JOIN j b ON b.run = a.run AND b.revision = a.revision - 1),
 v AS (SELECT run, revision, concat_ws(',', CASE WHEN calls < pc OR (pu AND NOT unpriced) THEN 'USAGE' END, CASE WHEN attempts[1:len(pa)] <> pa THEN 'ATTEMPTS' END, CASE WHEN pd AND NOT (done AND output = po) THEN 'STEPS' END,
 CASE WHEN pr IS NOT NULL AND reason IS DISTINCT FROM pr THEN 'REASON' END, CASE WHEN three <> p3 THEN 'DEFINITION' END, CASE WHEN moment < pt THEN 'TIME' END) AS violations FROM l)
 SELECT * FROM v WHERE violations <> ''""")
def journal_prefixes(spark, sf_dir):
    """The orders of a customer as revisions of a journal."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    step = lambda stage, status, output: F.struct(F.lit(stage).alias("stage"), status.alias("status"), output.alias("output"))
    steps = F.array(step("collect", F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running"), F.col("o_orderpriority")), step("score", F.lit("pending"), F.lit(None).cast("string")))
    third = F.array(step("publish", F.lit("pending"), F.lit(None).cast("string")))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), (F.row_number().over(w) - 1).alias("revision"), F.struct(F.floor("o_totalprice").alias("model_calls"), (F.col("o_orderstatus") == "P").alias("has_unpriced_calls")).alias("usage"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<bigint>")).otherwise(F.collect_list("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("attempts"),
        F.when(F.col("o_totalprice") > 300000, F.concat(steps, third)).otherwise(steps).alias("steps"), F.when(F.col("o_totalprice") > 400000, F.col("o_orderstatus")).alias("terminal_reason"), F.col("o_orderdate").alias("updated_at"),
    )
    return ledger.journal_regressions(rows, "run", []).select("run", "revision", F.array_join("violations", ",").alias("violations"))


@query("""WITH e AS (SELECT event_id, value, user_id, lag(value) OVER w AS pv, lag(user_id) OVER w AS pu FROM events WINDOW w AS (ORDER BY event_id))
 SELECT event_id, value, user_id FROM e WHERE pv IS NOT NULL AND (value > pv OR (value = pv AND user_id >= pu))""")
def order_seams(spark, sf_dir):
    """Events that don't come strictly after the one before them, compared within ranges and at their seams."""
    return paging.order_violations(table(spark, sf_dir, "events").select("event_id", "value", "user_id"), "value", "user_id", "event_id")


@query("""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, ['t' || sha256(coalesce(text, '')), 'b' || (doc_id // 3), 'c' || (doc_id * 7919 % 611)] AS ids FROM documents),
 r(n, seen, doc_id, outcome) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR
 UNION ALL SELECT d.n, CASE WHEN list_has_any(seen, ids) THEN seen ELSE list_concat(seen, ids) END, d.doc_id, CASE WHEN list_has_any(seen, ids) THEN 'duplicate' ELSE 'inserted' END FROM r JOIN d ON d.n = r.n + 1)
 SELECT doc_id, outcome FROM r WHERE doc_id IS NOT NULL""")
def upsert_identities(spark, sf_dir):
    """All documents upserted one after another, each with three identities."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("a"), F.floor(F.col("doc_id") / 3).alias("b"), (F.col("doc_id") * 7919 % 611).alias("c"))
    return articles.upsert(rows, rows.filter("false"), ["a", "b", "c"], "doc_id").select("doc_id", "outcome")
