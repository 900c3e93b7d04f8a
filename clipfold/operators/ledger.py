"""Usage, budgets, attempts and journals of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipfold.operators.automata import moves, states_before

#: Tokens reserved for framing, and dollars per million tokens in and out.
FRAMING, IN_PRICE, OUT_PRICE = 16_384, "1.5", "9"


def reservation(payload: Column, output_tokens: Column) -> Column:
    """(reserved_tokens, cost_usd): one token per UTF-8 byte and framing, priced exactly."""
    tokens = F.octet_length(payload).cast("bigint") + FRAMING
    cost = (tokens.cast("decimal(20,0)") * F.lit(IN_PRICE).cast("decimal(4,1)") + output_tokens.cast("decimal(20,0)") * F.lit(OUT_PRICE).cast("decimal(4,1)")) / F.lit(1_000_000).cast("decimal(7,0)")
    return F.struct(tokens.alias("reserved_tokens"), cost.cast("decimal(22,8)").alias("cost_usd"))


def usage(calls: DataFrame, run: str, cost: str = "cost", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """Per run: calls, tokens and cost; a call without a cost counts 0 and marks the run as holding unpriced calls."""
    return calls.groupBy(run).agg(
        F.count(F.lit(1)).alias("model_calls"), F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"),
        F.sum(F.coalesce(F.col(cost), F.lit(0))).alias("estimated_cost"), F.bool_or(F.col(cost).isNull()).alias("has_unpriced_calls"),
    )


def issues(calls: int, tokens_in: int, tokens_out: int, cost: float) -> Column:
    """The limits that a usage row breaks, in order."""
    found = F.array(
        F.when(F.col("model_calls") > calls, F.lit("MODEL_CALL_LIMIT")), F.when(F.col("input_tokens") > tokens_in, F.lit("INPUT_TOKEN_LIMIT")),
        F.when(F.col("output_tokens") > tokens_out, F.lit("OUTPUT_TOKEN_LIMIT")), F.when(F.col("estimated_cost") > cost, F.lit("ESTIMATED_COST_LIMIT")),
        F.when(F.col("has_unpriced_calls"), F.lit("UNPRICED_MODEL_CALL")),
    )
    return F.array_compact(found)


def running(calls: DataFrame, run: str, order: list[str], value: str, limit: float, most_calls: int) -> DataFrame:
    """What a run had used before each call, and whether the call could start."""
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumns({"calls_before": F.count(F.lit(1)).over(before), "used_before": F.coalesce(F.sum(value).over(before), F.lit(0))})
    return out.withColumn("may_start", (F.col("calls_before") < most_calls) & (F.col("used_before") <= limit))


def reserved_total(invocations: DataFrame, run: str) -> DataFrame:
    """Per run: upper bounds of open reservations and actual costs of completed ones."""
    spent = F.when(F.col("status") == "reserved", F.col("reserved_cost")).when(F.col("status") == "completed", F.col("actual_cost"))
    return invocations.groupBy(run).agg(F.sum(spent).alias("committed_cost"), F.count_if(F.col("status") == "reserved").alias("open_reservations"))


def attempts_checked(attempts: DataFrame, group: list[str], number: str) -> DataFrame:
    """Per group: whether attempt numbers run from 1 without gap or repeat. Counts suffice, no group is sorted."""
    n = F.count(F.lit(1))
    agg = attempts.groupBy(*group).agg(n.alias("attempts"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("distinct"))
    return agg.select(*group, "attempts", ((F.col("low") == 1) & (F.col("high") == F.col("attempts")) & (F.col("distinct") == F.col("attempts"))).alias("consecutive"))


def journal_violations(journal: DataFrame, run: str, revision: str, growing: list[str]) -> DataFrame:
    """Revisions that skip a number or in which a growing value falls."""
    w = Window.partitionBy(run).orderBy(revision)
    out = journal.withColumns({f"_{c}": F.lag(c).over(w) for c in [revision, *growing]})
    found = [F.when(F.col(f"_{revision}").isNotNull() & (F.col(revision) != F.col(f"_{revision}") + 1), F.lit("revision"))]
    found += [F.when(F.col(c) < F.col(f"_{c}"), F.lit(c)) for c in growing]
    return out.withColumn("violations", F.array_compact(F.array(*found))).filter(F.size("violations") > 0).drop(*(f"_{c}" for c in [revision, *growing]))


def throttled(attempts: DataFrame, source: str, at: str, tie: str, seconds: int) -> DataFrame:
    """Marks each attempt allowed, or too_soon after the one before it at its source."""
    last = F.lag(at).over(Window.partitionBy(source).orderBy(at, tie))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return attempts.withColumn("decision", F.when(last.isNull() | (gap >= seconds * 1_000_000), "allowed").otherwise("too_soon"))


def first_success(routes: DataFrame, call: str, order: str, ok: str) -> DataFrame:
    """Per call the first route that succeeded, null if none did."""
    return routes.groupBy(call).agg(F.min(F.when(F.col(ok), F.col(order))).alias("route"), F.count(F.lit(1)).alias("tried"))


def prepared(intents: DataFrame, ledger_rows: DataFrame, run: str, call: str, limit: float) -> DataFrame:
    """What a call that is about to start may do, by what the ledger has of it.

    prepared (new, and its reservation fits the run's limit), blocked (new, and
    it doesn't), reserved or completed (the same request is there), conflict
    (another request has its id). ``intents``: run, call, fingerprint and
    reserved_cost; ``ledger_rows``: run, call, fingerprint, status,
    reserved_cost and actual_cost.
    """
    held = reserved_total(ledger_rows, run).select(run, "committed_cost")
    old = ledger_rows.select(run, call, F.col("fingerprint").alias("_f"), F.col("status").alias("_s"))
    rows = intents.join(old, [run, call], "left").join(held, run, "left")
    fits = F.coalesce("committed_cost", F.lit(0)) + F.col("reserved_cost") <= limit
    verdict = F.when(F.col("_f").isNull(), F.when(fits, "prepared").otherwise("blocked")).when(F.col("_f") != F.col("fingerprint"), "conflict").otherwise(F.col("_s"))
    return rows.withColumn("verdict", verdict).drop("_f", "_s", "committed_cost")


#: States of a call in the ledger, and what each kind of event makes of them: a request, or the end of a call with its audit,
#: that equals the one on record or differs from it; no_audit is an end without a valid audit.
NONE, RESERVED, COMPLETED = range(3)
MOVES = {"prepare": (RESERVED, RESERVED, COMPLETED), "finalize": (NONE, COMPLETED, COMPLETED)}
#: The outcome of each kind of event by the state that it finds.
OUTCOMES = {
    "prepare": ("prepared", "reserved", "completed"),
    "prepare_other": ("INVOCATION_CONFLICT", "INVOCATION_CONFLICT", "INVOCATION_CONFLICT"),
    "finalize": ("INVOCATION_NOT_FOUND", "completed", "already_completed"),
    "finalize_other": ("INVOCATION_NOT_FOUND", "INVOCATION_CONFLICT", "INVOCATION_CONFLICT"),
    "no_audit": ("INVOCATION_NOT_FOUND", "INVALID_INVOCATION_AUDIT", "INVOCATION_CONFLICT"),
}


def transitions(events: DataFrame, call: list[str], order: str, chunk: int = 200) -> DataFrame:
    """``events`` with the state that each finds in the ledger and its outcome.

    ``events``: the call's identity, ``order`` (whole numbers from 0, each once a
    call), action (prepare or finalize), request (a fingerprint), audit (of a
    finalize; null if it isn't valid) and refused (the error of a lease that
    didn't hold, else null). The first request that isn't refused reserves the
    call; the first end with that request and a valid audit completes it; equal
    ones are replayed, others are conflicts, and what is refused changes
    nothing.
    """
    valid = F.col("refused").isNull()
    asked = events.filter(valid & (F.col("action") == "prepare")).groupBy(*call).agg(F.min(F.struct(F.col(order).alias("at"), "request")).alias("_asked"))
    rows = events.join(asked, call, "left")
    ends = valid & (F.col("action") == "finalize") & F.col("audit").isNotNull() & (F.col("request") == F.col("_asked.request")) & (F.col(order) > F.col("_asked.at"))
    done = rows.filter(ends).groupBy(*call).agg(F.min(F.struct(F.col(order).alias("at"), "audit")).alias("_done"))
    same = F.coalesce(F.col("request") == F.col("_asked.request"), F.lit(False))
    finalize = F.when(~same, "finalize_other").when(F.col("audit").isNull(), "no_audit").when(F.coalesce(F.col("audit") == F.col("_done.audit"), F.lit(True)), "finalize").otherwise("finalize_other")
    kind = F.when(~valid, "refused").when(F.col("action") == "prepare", F.when(same, "prepare").otherwise("prepare_other")).otherwise(finalize)
    told = rows.join(done, call, "left").select(*events.columns, kind.alias("_kind"))
    found = states_before(told.withColumn("_move", moves(F.col("_kind"), MOVES)), call, order, "_move", 3, NONE, chunk)
    outcome = F.col("refused")
    for name, by in OUTCOMES.items():
        outcome = F.when(F.col("_kind") == name, F.element_at(F.array(*map(F.lit, by)), F.col("state") + 1)).otherwise(outcome)
    state = F.element_at(F.array(*map(F.lit, ("none", "reserved", "completed"))), F.col("state") + 1)
    return found.select(*events.columns, state.alias("found"), outcome.alias("outcome"))


def journal_regressions(journal: DataFrame, run: str, fixed: list[str]) -> DataFrame:
    """run, revision and what in a revision doesn't follow from the one before: REVISION, USAGE, ATTEMPTS, STEPS, REASON, DEFINITION, TIME.

    ``journal``: run, revision, usage (a struct of growing numbers, and
    has_unpriced_calls), attempts (an array), steps (structs with stage and
    status), terminal_reason, updated_at and the ``fixed`` columns of the run's
    definition. Attempts are a prefix of those of the next revision, steps that
    succeeded stay as they are, and the order of stages is part of the
    definition. A revision is joined with its predecessor's number, so a long
    run is not sorted; REVISION: there is no such predecessor, and it isn't the
    first of its run.
    """
    columns = ["usage", "attempts", "steps", "terminal_reason", "updated_at", *fixed]
    before = journal.select(run, (F.col("revision") + 1).alias("revision"), F.struct(*columns).alias("_p"))
    first = journal.groupBy(run).agg(F.min("revision").alias("_first"))
    rows = journal.join(first, run).join(before, [run, "revision"], "left")
    p = F.col("_p")
    less = F.lit(False)
    for f in journal.schema["usage"].dataType.names:
        if f == "has_unpriced_calls":
            less = less | (p["usage"][f] & ~F.col(f"usage.{f}"))
        else:
            less = less | (F.col(f"usage.{f}") < p["usage"][f])
    stages = lambda steps: F.transform(steps, lambda s: s["stage"])
    kept = F.forall(p["steps"], lambda s: (s["status"] != "succeeded") | F.exists("steps", lambda t: t.eqNullSafe(s)))
    defined = stages(p["steps"]).eqNullSafe(stages(F.col("steps")))
    for c in fixed:
        defined = defined & F.col(c).eqNullSafe(p[c])
    has = p.isNotNull()
    found = [
        ("REVISION", ~has & (F.col("revision") > F.col("_first"))), ("USAGE", has & less), ("ATTEMPTS", has & ~F.slice("attempts", F.lit(1), F.size(p["attempts"])).eqNullSafe(p["attempts"])), ("STEPS", has & ~kept),
        ("REASON", has & p["terminal_reason"].isNotNull() & ~F.col("terminal_reason").eqNullSafe(p["terminal_reason"])), ("DEFINITION", has & ~defined), ("TIME", has & (F.col("updated_at") < p["updated_at"])),
    ]
    issues = F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for name, wrong in found)))
    return rows.select(run, "revision", issues.alias("violations")).filter(F.size("violations") > 0)
