"""Structural and semantic gates of generated posts, and the gate before a model call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.functions import text

#: Limits of a post in graphemes and counts.
LIMITS = {"title": 36, "summary": 100, "body": 650, "least_body": 400, "question": 80, "paragraphs": 3, "questions": 2}
#: Limits of what a model may be given.
MODEL = {"items": 12, "graphemes": 6_000, "documents": 4, "document": 18_000, "all_documents": 32_000}


def _ids(refs: Column) -> Column:
    return F.transform(refs, lambda r: r["evidence_id"])


def sentences(post: Column) -> Column:
    """The summary and all sentences of the body."""
    return F.concat(F.array(post["one_line_summary"]), F.flatten(F.transform(post["body"], lambda p: p["sentences"])))


def claimed_ids(post: Column) -> Column:
    return F.flatten(F.transform(post["claims"], lambda c: _ids(c["evidence_refs"])))


def _duplicates(ids: Column) -> Column:
    return F.array_distinct(F.filter(ids, lambda x, i: F.array_position(ids, x) != i + 1))


def reference_issues(post: Column) -> Column:
    """Names of broken references inside a post."""
    claims = F.transform(post["claims"], lambda c: c["claim_id"])
    used = F.flatten(F.transform(sentences(post), lambda s: s["claim_ids"]))
    spots = F.transform(sentences(post), lambda s: s["sentence_id"])
    bare = F.exists(post["claims"], lambda c: c["kind"].isin("fact", "context") & (F.size(c["evidence_refs"]) == 0))
    found = (
        ("MISSING_CLAIM", F.size(F.array_except(used, claims)) > 0), ("DUPLICATE_ID", (F.size(_duplicates(claims)) > 0) | (F.size(_duplicates(spots)) > 0)),
        ("ORPHANED_CLAIM", F.size(F.array_except(claims, used)) > 0), ("CLAIM_WITHOUT_EVIDENCE", bare),
        ("EVIDENCE_MISMATCH", (F.size(F.array_except(claimed_ids(post), post["used_evidence_ids"])) > 0) | (F.size(F.array_except(post["used_evidence_ids"], claimed_ids(post))) > 0)),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found)))


def body_length(post: Column) -> Column:
    texts = F.transform(F.flatten(F.transform(post["body"], lambda p: p["sentences"])), lambda s: text.graphemes(s["text"]))
    return F.aggregate(texts, F.lit(0), lambda a, b: a + b)


def length_issues(post: Column) -> Column:
    body, n = body_length(post), F.size(post["questions"])
    found = (
        ("TITLE_TOO_LONG", text.graphemes(post["title"]) > LIMITS["title"]), ("SUMMARY_TOO_LONG", text.graphemes(post["one_line_summary"]["text"]) > LIMITS["summary"]),
        ("BODY_TOO_LONG", body > LIMITS["body"]), ("BODY_TOO_SHORT", body < LIMITS["least_body"]), ("PARAGRAPHS", F.size(post["body"]) != LIMITS["paragraphs"]),
        ("QUESTIONS", ~n.between(1, LIMITS["questions"])), ("QUESTION_TOO_LONG", F.exists(post["questions"], lambda q: text.graphemes(q) > LIMITS["question"])),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found)))


def link_issues(post: Column, evidence: Column) -> Column:
    """MISSING_EVIDENCE, UNSUPPORTED_CLAIM and FORMAT_INVALID of a post against its evidence."""
    known = F.transform(evidence, lambda e: e["evidence_id"])
    public = F.flatten(F.transform(sentences(post), lambda s: s["claim_ids"]))
    bare = F.exists(
        post["claims"],
        lambda c: (c["kind"].isin("fact", "context") | F.array_contains(public, c["claim_id"])) & (F.size(F.array_intersect(_ids(c["evidence_refs"]), known)) == 0),
    )
    used = post["used_evidence_ids"]
    missing = F.size(F.array_except(F.array_union(claimed_ids(post), used), known)) > 0
    mismatch = (F.size(F.array_except(claimed_ids(post), used)) > 0) | (F.size(F.array_except(used, claimed_ids(post))) > 0) | (F.size(_duplicates(used)) > 0)
    return F.array_compact(F.array(F.when(missing, F.lit("MISSING_EVIDENCE")), F.when(bare, F.lit("UNSUPPORTED_CLAIM")), F.when(mismatch, F.lit("FORMAT_INVALID"))))


def _groups(evidence: Column, field: str) -> Column:
    return F.size(F.array_distinct(F.transform(evidence, lambda e: e[field])))


def independent(policy: Column, post: Column, evidence: Column, allow_single: Column) -> Column:
    """Whether the evidence that a post uses meets its policy."""
    used = F.filter(evidence, lambda e: F.array_contains(post["used_evidence_ids"], e["evidence_id"]))
    primary = F.filter(used, lambda e: (e["source_role"] == "primary") & (e["source_type"] == "primary"))
    others = F.filter(used, lambda e: e["source_role"] == "independent")
    paired = F.exists(primary, lambda p: F.exists(others, lambda i: (i["publisher_group_id"] != p["publisher_group_id"]) & (i["provenance_group_key"] != p["provenance_group_key"])))
    pub, prov = _groups(used, "publisher_group_id"), _groups(used, "provenance_group_key")
    direct = F.forall(post["claims"], lambda c: (c["kind"] == "fact") & (F.size(c["evidence_refs"]) > 0) & F.forall(c["evidence_refs"], lambda r: r["support"] == "direct"))
    single = allow_single & (F.size(primary) > 0) & F.forall(primary, lambda p: p["authority"] == "public_authority_direct_fact") & (pub == 1) & (prov == 1) & direct
    return F.when(policy == "primary_plus_independent", paired).when(policy == "two_independent_sources", (pub >= 2) & (prov >= 2)).otherwise(single)


def structural(posts: DataFrame) -> DataFrame:
    """Adds ``checks`` (type, passed, reasons), ``blocking`` and ``passed``. ``posts``: post, evidence (array), policy, allow_single."""
    post, evidence = F.col("post"), F.col("evidence")
    catalog = F.transform(evidence, lambda e: e["evidence_id"])
    parts = {
        "schema": reference_issues(post),
        "source_metadata": F.when(F.size(_duplicates(catalog)) > 0, F.array(F.lit("DUPLICATE_EVIDENCE"))).otherwise(F.array().cast("array<string>")),
        "evidence_links": link_issues(post, evidence),
        "key_claim_citations": F.transform(F.filter(post["claims"], lambda c: (c["importance"] == "key") & ~c["display_citation"]), lambda c: c["claim_id"]),
        "content_length": length_issues(post),
        "source_independence": F.when(independent(F.col("policy"), post, evidence, F.col("allow_single")), F.array().cast("array<string>")).otherwise(F.array(F.lit("NOT_INDEPENDENT"))),
    }
    checks = F.array(*(F.struct(F.lit(k).alias("type"), (F.size(v) == 0).alias("passed"), v.alias("reasons")) for k, v in parts.items()))
    out = posts.withColumn("checks", checks)
    failed = F.filter("checks", lambda c: ~c["passed"])
    blocking = F.array_distinct(F.concat(F.flatten(F.transform(F.filter(failed, lambda c: c["type"] == "evidence_links"), lambda c: c["reasons"])), F.transform(F.filter(failed, lambda c: c["type"] != "evidence_links"), lambda c: F.upper(c["type"]))))
    return out.withColumn("blocking", blocking).withColumn("passed", F.size(failed) == 0)


def findings(posts: DataFrame, key: str) -> DataFrame:
    """(key, surface, claim_id, code, detail): promotional wording, causes on one source, numbers without evidence.

    A surface is a title, a question, the summary or a sentence; titles and
    questions have no claims, so no number or cause in them has support. A post
    brings its claims and evidence along, so nothing is dealt anew; each claim
    finds its evidence once.
    """
    post, bare = F.col("post"), F.array().cast("array<string>")
    surface = lambda name, said, ids: F.struct(name.alias("surface"), said.alias("text"), ids.alias("claim_ids"))
    plain = F.concat(F.array(surface(F.lit("title"), post["title"], bare)), F.transform(post["questions"], lambda q: surface(F.lit("question"), q, bare)))
    cited = F.transform(sentences(post), lambda s: surface(s["sentence_id"], s["text"], s["claim_ids"]))
    rows = posts.select(key, post["claims"].alias("claims"), "evidence", F.concat(plain, cited).alias("surfaces"))
    rows = rows.withColumns({"said": text.nfkc_all(F.transform("surfaces", lambda s: s["text"])), "told": text.nfkc_all(F.transform("evidence", lambda e: F.coalesce(e["passage"], F.lit(""))))})
    proof = F.zip_with("evidence", "told", lambda e, t: F.struct(e["evidence_id"], e["publisher_group_id"], e["provenance_group_key"], text.numeric_tokens(t, compose=False).alias("numbers")))
    named = lambda c, p: F.coalesce(F.array_contains(_ids(c["evidence_refs"]), p["evidence_id"]), F.lit(False))
    proof = F.coalesce(proof, F.array().cast("array<struct<evidence_id:string,publisher_group_id:string,provenance_group_key:string,numbers:array<string>>>"))
    support = text.bound(proof, lambda all_: F.transform("claims", lambda c: F.struct(c["claim_id"], F.filter(all_, lambda p: named(c, p)).alias("proofs"))))
    rows = rows.withColumn("support", support)
    flat = rows.select(key, "support", F.explode(F.zip_with("surfaces", "said", lambda s, t: F.struct(s["surface"], s["text"], s["claim_ids"], t.alias("said")))).alias("s")).select(key, "support", "s.*")

    proofs = lambda wanted: F.coalesce(F.flatten(F.transform(F.filter("support", wanted), lambda c: c["proofs"])), F.array())
    groups = lambda i, field: F.size(F.array_distinct(F.filter(F.transform(proofs(lambda c: c["claim_id"] == i), lambda p: p[field]), lambda g: g.isNotNull())))
    weak = lambda i: i.isNull() | (groups(i, "publisher_group_id") < 2) | (groups(i, "provenance_group_key") < 2)
    none = F.lit(None).cast("string")
    found = lambda code, claim=none, detail=none: F.struct(claim.alias("claim_id"), F.lit(code).alias("code"), detail.alias("detail"))
    listed = F.when(F.size("claim_ids") > 0, F.array_distinct("claim_ids")).otherwise(F.array(none))
    nothing = F.array().cast("array<struct<claim_id:string,code:string,detail:string>>")
    flat = flat.withColumn("numbers", text.numeric_tokens(F.col("said"), compose=False))
    known = F.flatten(F.transform(proofs(lambda c: F.coalesce(F.array_contains("claim_ids", c["claim_id"]), F.lit(False))), lambda p: p["numbers"]))
    lacking = text.bound(known, lambda k: text.unsupported_numbers(F.col("numbers"), k))
    each = F.concat(
        F.when(text.is_promotional(F.col("text")), F.array(found("PROMOTIONAL"))).otherwise(nothing),
        F.when(text.is_causal(F.col("text")), F.transform(F.filter(listed, weak), lambda i: found("CAUSAL_OVERREACH", claim=i))).otherwise(nothing),
        F.when(F.size("numbers") > 0, F.transform(lacking, lambda d: found("NUMERIC_UNSUPPORTED", detail=F.replace(d, F.lit("|"), F.lit(""))))).otherwise(nothing),
    )
    return flat.select(key, "surface", F.explode(each).alias("f")).select(key, "surface", "f.*")


def reviewed(found: DataFrame, reviews: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """Findings with those of an external review, equal ones once; a review that can't be right is a finding itself.

    ``reviews``: key, passed and ``findings`` (surface, claim_id, code, detail).
    REVIEW_MISSING: a post has none. REVIEW_INVALID: it passed with findings or
    failed without, or one names a claim that the post hasn't.
    """
    none = F.lit(None).cast("string")
    rows = posts.select(key, F.transform("post.claims", lambda c: c["claim_id"]).alias("_claims")).join(reviews.select(key, "passed", "findings"), key, "left")
    strange = F.exists("findings", lambda f: F.coalesce(~F.array_contains("_claims", f["claim_id"]), F.lit(False)))
    wrong = F.coalesce(F.col("passed") == (F.size("findings") > 0), F.lit(True)) | F.coalesce(strange, F.lit(False))
    code = F.when(F.col("findings").isNull(), "REVIEW_MISSING").when(wrong, "REVIEW_INVALID")
    broken = rows.select(key, F.lit("review").alias("surface"), none.alias("claim_id"), code.alias("code"), none.alias("detail")).filter("code is not null")
    told = rows.filter(code.isNull()).select(key, F.explode("findings").alias("f")).select(key, "f.surface", "f.claim_id", "f.code", "f.detail")
    return found.unionByName(told).unionByName(broken).distinct()


def merged(results: DataFrame, key: str) -> DataFrame:
    """Verdicts of several gates (key, passed, blocking) as one: all must pass, reasons are distinct."""
    return results.groupBy(key).agg(F.bool_and("passed").alias("passed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocking")))).alias("blocking"))


def model_input_issues(items: DataFrame, documents: DataFrame, key: str, now: Column) -> DataFrame:
    """Per run what forbids a model call: counts, lengths, personal details, hashes, retention, or lineage that isn't one to one.

    ``items``: evidence_id, article_id, source_name, title, passage, locator;
    ``documents``: document_id, evidence_id, article_id, source_name, title,
    content_text, content_hash, retention_expires_at.
    """
    fields = ("source_name", "title", "passage", "locator")
    items, documents = (df.withColumns({c: text.nfc(F.col(c)) for c in names}) for df, names in ((items, fields), (documents.withColumn("_hash", F.sha2("content_text", 256)), ("content_text",))))
    length: Callable[[str], Column] = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    private = lambda *cs: F.bool_or(text.is_sensitive(F.concat_ws("\n", *cs)))
    ev = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.sum(sum((length(c) for c in fields), F.lit(0))).alias("graphemes"), private(*fields).alias("private_items"))
    own = items.select(key, "evidence_id", F.struct("article_id", "source_name", "title").alias("_i"))
    tied = documents.withColumn("_d", F.struct("article_id", "source_name", "title")).join(own, [key, "evidence_id"], "full")
    doc = tied.groupBy(key).agg(
        F.count("document_id").alias("n_documents"), F.coalesce(F.max(F.length("content_text")), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.length("content_text")), F.lit(0)).alias("total"),
        F.bool_or(~F.col("_d").eqNullSafe(F.col("_i"))).alias("lineage"), F.bool_or(F.col("retention_expires_at") <= now).alias("expired"), F.bool_or(F.col("_hash") != F.col("content_hash")).alias("hash"),
        private("source_name", "title", "content_text").alias("private_documents"), F.count_distinct("document_id").alias("ids"), F.count_distinct("evidence_id").alias("eids"), F.count(F.lit(1)).alias("rows"),
    )
    both = ev.join(doc, key, "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = (
        ("EVIDENCE_COUNT", F.col("n_items") > MODEL["items"]), ("EVIDENCE_LENGTH", F.col("graphemes") > MODEL["graphemes"]), ("NO_DOCUMENT", F.coalesce("n_documents", F.lit(0)) == 0),
        ("DOCUMENT_COUNT", F.col("n_documents") > MODEL["documents"]), ("DOCUMENT_LENGTH", F.col("longest") > MODEL["document"]), ("DOCUMENTS_LENGTH", F.col("total") > MODEL["all_documents"]),
        ("LINEAGE", z("lineage") | (F.col("ids") < F.col("n_documents")) | (F.col("eids") < F.col("rows"))), ("RETENTION", z("expired")), ("HASH", z("hash")), ("SENSITIVE", z("private_items") | z("private_documents")),
    )
    return both.select(key, F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found))).alias("issues"))
