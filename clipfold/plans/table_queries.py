"""Queries over the business tables, events and conversations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clipfold.functions import text, timeutil, urls
from clipfold.operators import artifacts, contracts, ledger, paging, persistence, publication, signals, topics
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


PUB = "CASE s_suppkey % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'research' WHEN 2 THEN 'news' WHEN 3 THEN 'wire' ELSE 'other' END"
ROL = "CASE s_suppkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'independent' ELSE 'supporting' END"
REL = f"""floor(greatest(0, least(1, CASE {PUB} WHEN 'official' THEN CAST(0.9 AS DOUBLE) WHEN 'research' THEN 0.86 WHEN 'news' THEN 0.72 WHEN 'wire' THEN 0.66 ELSE 0.4 END + CAST(0.08 AS DOUBLE)
 + CASE {ROL} WHEN 'primary' THEN CAST(0.04 AS DOUBLE) WHEN 'independent' THEN 0.05 ELSE 0.0 END + CASE WHEN s_suppkey % 7 = 0 THEN CAST(0.08 AS DOUBLE) ELSE 0.0 END)) * 1000 + 0.5) / 1000"""


def suppliers(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").withColumns({"publisher_type": pick(["official", "research", "news", "wire", "other"], 5), "role": pick(["primary", "independent", "supporting"], 3)})
    authority = F.when(k % 7 == 0, "public_authority_direct_fact").otherwise("none")
    return s.withColumn("reliability", signals.source_reliability(F.col("publisher_type"), F.lit("original_reporting"), F.col("role"), authority))


@query("""SELECT s_suppkey, n_name AS publisher_group, r_name AS provenance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def source_join_validated(spark, sf_dir):
    from clipfold.operators.articles import checked_sources

    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    registry = nations.select(F.col("n_nationkey").cast("string").alias("source_id"), "n_name", "r_name")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("source_id"))
    return checked_sources(rows, registry).select("s_suppkey", F.col("source.n_name").alias("publisher_group"), F.col("source.r_name").alias("provenance"))


@query(f"""WITH b AS (SELECT r_name AS topic, n_name AS publisher_group, max({REL}) AS best FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
 SELECT topic, count(*) AS groups, floor(greatest(0, least(1, round(avg(best), 9) + least(0.16, (count(*) - 1) * CAST(0.08 AS DOUBLE)))) * 1000 + 0.5) / 1000 AS reliability FROM b GROUP BY topic""")
def reliability_by_group(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = suppliers(spark, sf_dir).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return signals.reliability(rows.withColumnRenamed("r_name", "topic"), "topic", "n_name", "reliability")


@query("""SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def source_topk(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn <= 3")


EV = f"""ev AS (SELECT l_orderkey, s_nationkey AS pub, s_suppkey % 10 AS prov, {ROL} AS role FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {EV}, c AS (SELECT l_orderkey, least(count(DISTINCT pub), count(DISTINCT prov)) AS q FROM ev GROUP BY 1),
 p AS (SELECT DISTINCT a.l_orderkey FROM ev a JOIN ev b USING (l_orderkey) WHERE a.role = 'primary' AND b.role = 'independent' AND a.pub <> b.pub AND a.prov <> b.prov),
 t AS (SELECT DISTINCT a.l_orderkey FROM ev a JOIN ev b USING (l_orderkey) WHERE a.role = 'independent' AND b.role = 'independent' AND a.pub <> b.pub AND a.prov <> b.prov)
 SELECT c.l_orderkey, q AS qualifying_group_count, p.l_orderkey IS NOT NULL AS has_primary_and_independent, t.l_orderkey IS NOT NULL AS has_two_independent,
 CASE WHEN p.l_orderkey IS NOT NULL THEN 'primary_plus_independent' WHEN t.l_orderkey IS NOT NULL THEN 'two_independent_sources' END AS evidence_policy FROM c LEFT JOIN p USING (l_orderkey) LEFT JOIN t USING (l_orderkey)""")
def independence_policy(spark, sf_dir):
    s = suppliers(spark, sf_dir).select("s_suppkey", F.col("s_nationkey").alias("publisher_group_id"), (F.col("s_suppkey") % 10).alias("provenance_group_key"), F.col("role").alias("source_role"), F.col("role").alias("source_type"))
    ev = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return topics.independence(ev, "l_orderkey")


@query("""SELECT l_orderkey, sum(l_extendedprice) AS x, 'topic:daily:' || substring(sha256(array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), chr(10))), 1, 32) AS topic_id FROM lineitem GROUP BY l_orderkey ORDER BY CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) DESC, topic_id LIMIT 1""".replace("sum(l_extendedprice) AS x", "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total"))
def select_topic_top1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("total"), F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    return topics.selected(rows.select("l_orderkey", "total", topics.topic_id(F.col("ids")).alias("topic_id")))


@query("""SELECT event_id, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS kst_date FROM events WHERE CAST(ts + INTERVAL 9 HOUR AS DATE) >= DATE '2024-01-08' AND CAST(ts + INTERVAL 9 HOUR AS DATE) < DATE '2024-01-15'""")
def kst_window_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(timeutil.in_window(F.col("ts"), F.lit("2024-01-15").cast("date"), 7))
    return rows.select("event_id", timeutil.kst_date(F.col("ts")).cast("string").alias("kst_date"))


@query("""WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), l AS (SELECT *, lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS latest FROM d)
 SELECT o_custkey, CAST(day AS VARCHAR) AS day, CAST(day - latest AS INTEGER) AS days_since, latest IS NULL OR day - latest >= 7 AS force_best, CASE WHEN latest IS NULL OR day - latest >= 7 THEN 7 ELSE 1 END AS window_days,
 CASE WHEN latest IS NULL THEN 'bootstrap' WHEN day - latest >= 7 THEN 'deadline' ELSE 'quality_first' END AS reason FROM l""")
def publication_cadence(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    latest = F.lag("day").over(Window.partitionBy("o_custkey").orderBy("day"))
    return days.withColumn("c", timeutil.cadence(F.col("day"), latest)).select("o_custkey", F.col("day").cast("string").alias("day"), "c.*")


CALLS = """c AS (SELECT user_id, event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS cost FROM events)"""


def calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cost = F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 100).cast("bigint"))
    return e.select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("k"), cost.alias("cost"))


USE = f"""WITH {CALLS}, u AS (SELECT user_id, count(*) AS model_calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens, CAST(sum(coalesce(cost, 0)) AS BIGINT) AS estimated_cost, bool_or(cost IS NULL) AS has_unpriced_calls FROM c GROUP BY user_id)"""


@query(USE + " SELECT * FROM u")
def usage_rollup(spark, sf_dir):
    return ledger.usage(calls(spark, sf_dir).withColumn("k2", F.col("k") * 2), "user_id", "cost", "k", "k2")


@query(USE + """ SELECT user_id, concat_ws(',', CASE WHEN model_calls > 60 THEN 'MODEL_CALL_LIMIT' END, CASE WHEN input_tokens > 3000 THEN 'INPUT_TOKEN_LIMIT' END, CASE WHEN output_tokens > 7000 THEN 'OUTPUT_TOKEN_LIMIT' END,
 CASE WHEN estimated_cost > 300000 THEN 'ESTIMATED_COST_LIMIT' END, CASE WHEN has_unpriced_calls THEN 'UNPRICED_MODEL_CALL' END) AS issues FROM u""")
def budget_verdict(spark, sf_dir):
    return usage_rollup(spark, sf_dir).select("user_id", F.array_join(ledger.issues(60, 3000, 7000, 300000), ",").alias("issues"))


@query(f"""WITH {CALLS}, r AS (SELECT user_id, event_id, count(*) OVER w AS calls_before, CAST(coalesce(sum(cost) OVER w, 0) AS BIGINT) AS used_before FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT *, calls_before < 50 AND used_before <= 250000 AS may_start FROM r""")
def running_budget(spark, sf_dir):
    return ledger.running(calls(spark, sf_dir), "user_id", ["ts", "event_id"], "cost", 250000, 50).select("user_id", "event_id", "calls_before", "used_before", "may_start")


@query(f"""WITH {CALLS} SELECT user_id, CAST(sum(CASE WHEN event_id % 3 = 0 THEN k * 100 ELSE cost END) AS BIGINT) AS committed_cost, count(*) FILTER (WHERE event_id % 3 = 0) AS open_reservations FROM c GROUP BY user_id""")
def reservation_sum(spark, sf_dir):
    rows = calls(spark, sf_dir).select("user_id", F.when(F.col("event_id") % 3 == 0, "reserved").otherwise("completed").alias("status"), (F.col("k") * 100).alias("reserved_cost"), F.col("cost").alias("actual_cost"))
    return ledger.reserved_total(rows, "user_id")


@query("""SELECT conv_id, count(*) AS attempts, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS consecutive FROM conversations GROUP BY conv_id""")
def attempt_sequence_check(spark, sf_dir):
    return ledger.attempts_checked(table(spark, sf_dir, "conversations").withColumn("attempt", F.col("turn") + 1), ["conv_id"], "attempt")


@query("""WITH j AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, value FROM events), l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY revision) AS p FROM j)
 SELECT user_id, event_id, revision, 'value' AS violations FROM l WHERE value < p""")
def journal_monotonicity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("revision"), "value")
    return ledger.journal_violations(e, "user_id", "revision", ["value"]).select("user_id", "event_id", "revision", F.array_join("violations", ",").alias("violations"))


@query("""WITH l AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id, CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 'allowed' ELSE 'too_soon' END AS decision FROM l""")
def attempt_throttle(spark, sf_dir):
    return ledger.throttled(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 6 * 3600).select("event_id", "user_id", "decision")


ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(date_part('millisecond', o_orderdate) AS INTEGER) % 1000 AS VARCHAR), 3, '0') || 'Z'"
CUR = f"replace(replace(rtrim(base64(encode('v1' || chr(10) || {ISO} || chr(10) || o_orderkey)), '='), '+', '-'), '/', '_')"


def _posts(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", timeutil.iso_millis(F.col("o_orderdate")).alias("published_at"))


@query(f"""WITH p AS (SELECT o_orderkey, {ISO} AS published_at, {CUR} AS cursor FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT published_at AS pa, o_orderkey AS k FROM p ORDER BY published_at DESC, o_orderkey DESC LIMIT 1 OFFSET 11)
 SELECT o_orderkey, published_at, cursor, true AS has_more FROM p, a WHERE published_at < pa OR (published_at = pa AND o_orderkey < k) ORDER BY published_at DESC, o_orderkey DESC LIMIT 12""")
def keyset_page(spark, sf_dir):
    posts = _posts(spark, sf_dir)
    first = paging.page(posts, "published_at", "o_orderkey")
    last = first.orderBy("published_at", "o_orderkey").select("cursor").first()
    return paging.page(posts, "published_at", "o_orderkey", after=last[0] if last else None).select("o_orderkey", "published_at", "cursor", "has_more")


@query(f"""SELECT o_orderkey, {CUR} AS cursor, {ISO} AS back_at, CAST(o_orderkey AS VARCHAR) AS back_key FROM orders""")
def page_cursor(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", paging.cursor(timeutil.iso_millis(F.col("o_orderdate")), F.col("o_orderkey")).alias("cursor"))
    return rows.withColumn("p", paging.cursor_parts(F.col("cursor"))).select("o_orderkey", "cursor", F.col("p.at").alias("back_at"), F.col("p.key").alias("back_key"))


@query("""WITH r AS (SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 365)
 SELECT r.o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(DISTINCT l_suppkey) AS n_sources, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS source_ids, count(*) <> count(DISTINCT l_partkey) AS has_duplicates FROM r JOIN lineitem ON l_orderkey = r.o_orderkey GROUP BY ALL""")
def history_lookup(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(365)
    rows = recent.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = rows.groupBy("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day")).agg(
        F.count_distinct("l_suppkey").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("source_ids"),
        (F.count(F.lit(1)) != F.count_distinct("l_partkey")).alias("has_duplicates"),
    )
    return out


@query("""SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def missing_refs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey").join(table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").distinct()


SETS = """s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag <> 'R')) AS used, list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber <= 3)) AS claimed FROM lineitem GROUP BY l_orderkey)"""


def _sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_partkey"))))
    return rows.groupBy("l_orderkey").agg(pick(F.col("l_returnflag") != "R").alias("used"), pick(F.col("l_linenumber") <= 3).alias("claimed"))


@query(f"WITH {SETS} SELECT l_orderkey, coalesce(used, []) = coalesce(claimed, []) AS exact, list_has_all(coalesce(claimed, []), coalesce(used, [])) AS contained FROM s")
def exact_set_match(spark, sf_dir):
    return _sets(spark, sf_dir).select("l_orderkey", F.col("used").eqNullSafe(F.col("claimed")).alias("exact"), (F.size(F.array_except("used", "claimed")) == 0).alias("contained"))


@query(f"""WITH {SETS}, d AS (SELECT l_orderkey, list_sort(list_filter(coalesce(used, []), lambda x: NOT list_contains(coalesce(claimed, []), x))) AS a, list_sort(list_filter(coalesce(claimed, []), lambda x: NOT list_contains(coalesce(used, []), x))) AS b FROM s)
 SELECT l_orderkey, array_to_string(a, ',') AS unclaimed, array_to_string(b, ',') AS unused FROM d WHERE len(a) + len(b) > 0""")
def symmetric_diff(spark, sf_dir):
    join = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)).cast("array<string>"), ",")
    return _sets(spark, sf_dir).select("l_orderkey", join("used", "claimed").alias("unclaimed"), join("claimed", "used").alias("unused")).filter("unclaimed <> '' or unused <> ''")


@query("""SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size < 10""")
def cited_union(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).union(table(spark, sf_dir, "part").filter("p_size < 10").select("p_partkey")).distinct()


@query("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""")
def exists_not_exists(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(items.filter("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(items.filter("l_quantity > 45"), "o_orderkey", "left_anti")


@query("""SELECT c.c_custkey AS custkey, concat_ws(',', CASE WHEN c.c_mktsegment IS DISTINCT FROM n.seg THEN 'segment' END, CASE WHEN c.c_nationkey IS DISTINCT FROM n.nat THEN 'nation' END) AS fields FROM customer c
 JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 15 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nat FROM customer) n USING (c_custkey) WHERE c.c_mktsegment IS DISTINCT FROM n.seg OR c.c_nationkey IS DISTINCT FROM n.nat""")
def identity_conflicts(spark, sf_dir):
    from clipfold.operators.articles import identity_conflicts as conflicts

    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    new = old.withColumns({"segment": F.when(F.col("custkey") % 10 != 0, F.col("segment")), "nation": F.when(F.col("custkey") % 15 == 0, F.col("nation") + 1).otherwise(F.col("nation"))})
    return conflicts(new, old, "custkey", ["segment", "nation"]).select("custkey", F.array_join("fields", ",").alias("fields"))


@query("""WITH x AS (SELECT event_id, ts + INTERVAL 5 DAY AS until FROM events), e AS (SELECT event_id FROM x WHERE until <= TIMESTAMP '2024-01-20' ORDER BY until, event_id LIMIT 1000)
 SELECT (SELECT count(*) FROM e) AS purged, (SELECT count(*) FROM events) - (SELECT count(*) FROM e) AS remaining, (SELECT max(event_id) FROM e) AS last_id""")
def retention_purge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", timeutil.expires_at(F.col("ts"), F.lit(5)).alias("until"))
    stay, gone = artifacts.purged(rows, F.lit("2024-01-20").cast("timestamp_ntz"), "until", "event_id", 1000)
    return gone.agg(F.count(F.lit(1)).alias("purged"), F.max("event_id").alias("last_id")).join(F.broadcast(stay.agg(F.count(F.lit(1)).alias("remaining"))), F.lit(True)).select("purged", "remaining", "last_id")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'archive-1995-08' AS archive_key FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-08-01' AND DATE '1995-08-31'""")
def snapshot_archive(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= F.lit("1995-08-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1995-09-01").cast("timestamp_ntz"))).select("o_orderkey", day.cast("string").alias("day"), F.lit("archive-1995-08").alias("archive_key"))


@query("""SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS last_turn, array_to_string(list(role ORDER BY turn), '>') AS roles FROM conversations GROUP BY conv_id""")
def last_wins(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("last_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles")
    )


@query("""SELECT conv_id, min(CASE WHEN role = 'assistant' THEN turn END) AS route, count(*) AS tried FROM conversations GROUP BY conv_id""")
def fallback_route(spark, sf_dir):
    return ledger.first_success(table(spark, sf_dir, "conversations").withColumn("ok", F.col("role") == "assistant"), "conv_id", "turn", "ok")


@query("""WITH o AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber) AS cited FROM lineitem GROUP BY 1), d AS (SELECT l_orderkey, cited, list_distinct(cited) AS dd FROM o)
 SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(cited, lambda x: list_position(list_sort(dd), x)), lambda p: p > 0))), ',') AS numbers FROM d""")
def citation_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("c"))
    rows = rows.select("l_orderkey", F.transform("c", lambda x: x["l_suppkey"]).alias("ids"))
    return rows.select("l_orderkey", F.array_join(text.citation_numbers(F.col("ids"), F.array_sort(F.array_distinct("ids"))).cast("array<string>"), ",").alias("numbers"))


@query()
def fnv_visual(spark, sf_dir):
    h = text.fnv1a(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("hash")).select(
        "p_partkey", "hash", (F.col("hash") % 360).alias("hue"), (18 + F.shiftrightunsigned("hash", 16) % 145).alias("angle"), (22 + F.shiftrightunsigned("hash", 5) % 57).alias("x"), (18 + F.shiftrightunsigned("hash", 12) % 61).alias("y")
    )


@query("""SELECT CAST(time_bucket(INTERVAL 1 DAY, ts + INTERVAL 9 HOUR) - i * INTERVAL 1 DAY AS DATE)::VARCHAR AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events, range(0, 7) t(i) GROUP BY ALL""")
def events_hopping_window(spark, sf_dir):
    from clipfold.streaming.windows import hopping

    out = hopping(table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint")), "ts", ["event_type"])
    return out.select(F.to_date("window_start").cast("string").alias("window_start"), "event_type", "n", "cents")


@query("""WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 a AS (SELECT user_id, rn, rn // 2 AS up, 1 AS d FROM s WHERE rn > 1 UNION ALL SELECT user_id, rn, up // 2, d + 1 FROM a WHERE up > 1)
 SELECT 'ref-' || user_id || '-' || rn AS output_reference, 'ref-' || user_id || '-' || up AS ancestor, CAST(d AS INTEGER) AS distance, false AS cyclic FROM a""")
def artifact_lineage(spark, sf_dir):
    """All events of a user are a run's artifacts, and each comes from that of half its number: a tree, whose paths grow with the logarithm."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda n: F.concat_ws("-", F.lit("ref"), F.col("user_id").cast("string"), n.cast("string"))
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("rn"))
    up = F.when(F.col("rn") > 1, F.array(name(F.floor(F.col("rn") / 2)))).otherwise(F.array().cast("array<string>"))
    return artifacts.ancestors(e.select(name(F.col("rn")).alias("output_reference"), up.alias("parent_output_references")))


IDENT = """substring(sha256('{"generationOutputReference":"' || ref || '","runDate":"' || day || '","runId":"' || run || '"}'), 1, 20)"""


@query(f"""WITH r AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'run-' || o_custkey AS run, 'ref-' || o_orderkey AS ref FROM orders), m AS (SELECT *, {IDENT} AS mark FROM r)
 SELECT o_orderkey, 'post-' || replace(day, '-', '') || '-' || mark AS post_id, 'revision-' || replace(day, '-', '') || '-' || mark AS revision_id, 'ai-digital-education-' || day || '-' || substring(mark, 1, 8) AS slug, 'visual-' || mark AS visual_seed FROM m""")
def publication_identity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = publication.identity(F.to_date("o_orderdate"), F.concat(F.lit("run-"), F.col("o_custkey").cast("string")), F.concat(F.lit("ref-"), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", made.alias("p")).select("o_orderkey", "p.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'absent' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'conflict' ELSE 'published' END AS receipt FROM orders""")
def publish_receipts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("revision_id"))
    posts = o.filter("o_orderkey % 7 <> 0")
    shown = o.filter("o_orderkey % 5 <> 0").withColumn("revision_id", F.when((F.col("o_orderkey") % 11 == 0) , "other").otherwise(F.col("revision_id")))
    return publication.receipts(o, "o_orderkey", ("post", posts), ("shown", shown))


@query("""WITH c AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial FROM orders GROUP BY 1)
 SELECT o_custkey, CASE WHEN failed = total THEN CASE WHEN o_custkey % 2 = 0 THEN 'partial' ELSE 'failed' END WHEN failed > 0 OR partial > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM c""")
def ingestion_status(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"))
    status = contracts.expected_status(F.col("total") - F.col("failed"), F.col("failed"), F.col("partial"), F.col("total"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(0))
    return c.select("o_custkey", status.alias("status"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'withheld' WHEN 2 THEN 'blocked' ELSE 'failed' END AS disposition,
 CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'QUALITY_REJECTED' WHEN 2 THEN 'BUDGET_EXCEEDED' ELSE 'MODEL_PROVIDER_ERROR' END AS reason, event_id % 8 = 3 AS retryable FROM events""")
def generation_mapping(spark, sf_dir):
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(k == 0, "validated").otherwise("rejected").alias("status"), F.when(k == 1, "QUALITY_REJECTED").when(k == 2, "BUDGET_EXCEEDED").when(k == 3, "MODEL_PROVIDER_ERROR").alias("failure_code"),
        F.when(F.col("event_id") % 8 == 3, "RATE_LIMITED").when(k == 3, "REFUSED").alias("provider_error_code"), F.when(k == 0, True).when(k == 1, False).alias("quality_passed"), (k == 0).alias("has_post"),
    )
    return e.select("event_id", contracts.generation_disposition().alias("d")).select("event_id", "d.*")


@query("""WITH s AS (SELECT o_orderkey, 'slug-' || o_orderkey AS slug FROM orders) SELECT slug, o_orderkey AS post_id, CASE WHEN o_orderkey % 10 = 0 THEN 'container' WHEN o_orderkey % 15 = 5 THEN 'revision' END AS broken FROM s""")
def slug_pointer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("slug-"), F.col("o_orderkey").cast("string")).alias("slug"), F.col("o_orderkey").alias("post_id"))
    containers = o.filter("post_id % 10 <> 0").withColumn("active_revision_id", F.col("post_id") * 2)
    revisions = o.filter("post_id % 15 <> 5").select((F.col("post_id") * 2).alias("revision_id"), "post_id", "slug", F.lit("t").alias("title"))
    return publication.by_pointer(o, containers, revisions).select("slug", "post_id", "broken")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE CAST(o_orderdate + INTERVAL 9 HOUR AS DATE) >= DATE '1996-03-08' AND CAST(o_orderdate + INTERVAL 9 HOUR AS DATE) < DATE '1996-03-15' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
 SELECT o_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT 'e' || l_suppkey) FILTER (WHERE l_suppkey IS NOT NULL)), ','), '') AS evidence_ids FROM a LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def rolling_materials(spark, sf_dir):
    from clipfold.operators.materials import rolling

    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("published_at"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.concat(F.lit("e"), F.col("l_suppkey").cast("string")).alias("evidence_id"))
    return rolling(a, s, e, F.lit("1996-03-15").cast("date"), 7).select(F.col("article_id").alias("o_orderkey"), F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query(f"""WITH {CALLS}, l AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'reserved' ELSE 'completed' END AS status, k FROM c WHERE event_id % 2 = 0),
 h AS (SELECT user_id, sum(CASE WHEN event_id % 3 = 0 THEN k * 100 ELSE cost END) AS t FROM c WHERE event_id % 2 = 0 GROUP BY 1)
 SELECT c.user_id, c.event_id, CASE WHEN l.event_id IS NULL THEN CASE WHEN coalesce(h.t, 0) + c.k * 100 <= 150000 THEN 'prepared' ELSE 'blocked' END WHEN c.event_id % 14 = 0 THEN 'conflict' ELSE l.status END AS verdict
 FROM c LEFT JOIN l ON l.user_id = c.user_id AND l.event_id = c.event_id LEFT JOIN h ON h.user_id = c.user_id""")
def invocation_verdicts(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumns({"fingerprint": F.when(F.col("event_id") % 14 == 0, "other").otherwise("same"), "reserved_cost": F.col("k") * 100})
    stored = calls(spark, sf_dir).filter("event_id % 2 = 0").select("user_id", "event_id", F.lit("same").alias("fingerprint"), F.when(F.col("event_id") % 3 == 0, "reserved").otherwise("completed").alias("status"), (F.col("k") * 100).alias("reserved_cost"), F.col("cost").alias("actual_cost"))
    return ledger.prepared(rows, stored, "user_id", "event_id", 150000).select("user_id", "event_id", "verdict")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN c_name || ' new' ELSE c_name END AS c_name,
 c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS refreshed FROM customer""")
def refresh_unreferenced(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = rows.filter("c_custkey % 2 = 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" new"))))
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return persistence.refreshed(rows, new, "c_custkey", ["c_name"], used)


@query("""SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'FUR') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'OLD-' || substring(c_mktsegment, 4) ELSE c_mktsegment END AS label FROM customer""")
def relabel_unreferenced(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return persistence.relabelled(rows, "c_custkey", "label", "FUR", "OLD-", used)


@query("""WITH a AS (SELECT o_custkey AS topic_id, count(*) AS n, arg_min(o_orderpriority, ROW(-epoch_us(o_orderdate), 'a' || o_orderkey)) AS newest, arg_max(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY 1)
 SELECT topic_id, concat_ws(',', CASE WHEN topic_id % 5 = 0 THEN 'IDS' END, CASE WHEN title <> newest THEN 'TITLE' END, CASE WHEN topic_id % 7 = 0 THEN 'CONFLICT' END) AS issues FROM a""")
def topic_persist_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic_id"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("article_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("published_at"), "o_orderkey")
    t = o.groupBy("topic_id").agg(F.collect_set("article_id").alias("article_ids"), F.max_by("title", "o_orderkey").alias("title"))
    t = t.withColumn("article_ids", F.when(F.col("topic_id") % 5 == 0, F.array_append("article_ids", F.lit("more"))).otherwise(F.col("article_ids")))
    old = t.filter("topic_id % 2 = 0 or topic_id % 7 = 0").withColumn("title", F.when(F.col("topic_id") % 7 == 0, F.lit("other")).otherwise(F.col("title")))
    return persistence.topic_issues(t, o, old).select("topic_id", F.array_join("issues", ",").alias("issues"))


@query("""SELECT user_id, concat_ws(',', CASE WHEN user_id % 4 = 1 THEN 'MODEL_CALLS' END, CASE WHEN user_id % 3 = 0 THEN 'INPUT_TOKENS' END, CASE WHEN bool_or(event_id % 50 = 0) THEN 'ATTEMPTS' END) AS issues FROM events GROUP BY user_id""")
def audit_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 50 != 0, 1).alias("attempt"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"), F.lit(5).alias("cost"))
    use = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("model_calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost")))
    use = use.withColumns({"model_calls": F.col("model_calls") + (F.col("user_id") % 4 == 1).cast("int"), "input_tokens": F.col("input_tokens") + (F.col("user_id") % 3 == 0).cast("int")})
    return persistence.audit_issues(e, use, "user_id").select("user_id", F.array_join("issues", ",").alias("issues"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 10 = 0 THEN 'SOURCE' END, CASE WHEN o_custkey % 10 = 0 OR o_orderkey % 4 = 0 THEN 'PUBLISHER' END, CASE WHEN o_custkey % 10 = 0 OR o_orderkey % 6 = 0 THEN 'ORIGIN' END,
 CASE WHEN o_custkey % 10 = 0 OR o_orderkey % 9 = 0 THEN 'PROVENANCE' END, CASE WHEN o_custkey % 10 = 0 OR o_custkey % 3 = 0 OR o_custkey % 8 = 0 THEN 'ACCESS' END) AS issues FROM orders""")
def registry_checks(spark, sf_dir):
    name = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    a = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(name("g", "o_custkey")).alias("publisher_group_id"),
        F.when(F.col("o_orderkey") % 6 == 0, "wire").otherwise("unknown").alias("origin_type"), F.when(F.col("o_orderkey") % 9 == 0, "q:1").otherwise(F.concat(name("p", "o_custkey"), F.lit(":1"))).alias("provenance_group_key"),
    )
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id")).distinct().filter("source_id % 10 <> 0").select(
        "source_id", name("g", "source_id").alias("publisher_group_id"), F.lit("unknown").alias("origin_type"), name("p", "source_id").alias("provenance_group_prefix"),
        (F.col("source_id") % 3 != 0).alias("enabled"), F.when(F.col("source_id") % 8 == 0, "blocked").otherwise("allowed").alias("access_status"),
    )
    return persistence.registry_issues(a, s).select(F.col("article_id").alias("o_orderkey"), F.array_join("issues", ",").alias("issues"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https://') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^(https://[^/?]+)(\?|$)', '\1/\2') END AS https_url FROM pages""")
def https_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.https_url(F.col("url")).alias("https_url"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) - length(replace(props, ':', '')) = 1 AS one_key, '{"event_id":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"kind":"' || event_type || '"' ELSE '' END || '}' AS bare FROM events""")
def record_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))
    fields = persistence.fields_removed(persistence.fields_merged(F.create_map(F.lit("k"), F.lit("0"), F.lit("x"), F.lit("1")), F.from_json("props", "map<string,string>")), "x")
    return e.select("event_id", fields["k"].alias("k"), persistence.fields_exact(F.col("props"), "k").alias("one_key"), persistence.json_without_nulls("event_id", "kind").alias("bare"))
