"""Task operators: outbox claims, delegation, registry search, path patches, reviews, artifacts, library commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.runs import paged

STALE_US = 300 * 1000000
FINAL = ["COMPLETED", "FAILED", "CANCELLED"]
ROLES = ["A1", "A2", "A3", "A4"]
RESEARCHER, MOST_RESEARCHERS = "A2", 2


def claim_outbox(outbox: DataFrame, worker: str, now_us: int, limit: int) -> DataFrame:
    """outbox(event_id, status, available_us, claimed_by, claimed_us, attempts) after worker took the first limit events due.

    Due: available, and PENDING, FAILED or CLAIMED at least five minutes ago; by availability, then id.
    Only the limit ids taken are joined back.
    """
    free = F.col("status").isin("PENDING", "FAILED") | ((F.col("status") == "CLAIMED") & (F.col("claimed_us") <= now_us - STALE_US))
    due = outbox.filter((F.col("available_us") <= now_us) & free).orderBy("available_us", "event_id").limit(limit)
    j = outbox.join(due.select("event_id", F.lit(True).alias("_mine")), "event_id", "left")
    mine = F.coalesce("_mine", F.lit(False))
    changes = {"status": F.lit("CLAIMED"), "claimed_by": F.lit(worker), "claimed_us": F.lit(now_us), "attempts": F.col("attempts") + 1}
    return j.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_mine")


def finish_outbox(outbox: DataFrame, results: DataFrame, now_us: int) -> DataFrame:
    """outbox after results(event_id, worker, error): an event claimed by that worker is DONE, or FAILED and free again with an error. outcome is APPLIED, CONFLICT (not claimed by the worker), or null without a result."""
    j = outbox.join(results.withColumn("_asked", F.lit(True)), "event_id", "left")
    good = F.coalesce(F.col("_asked") & (F.col("status") == "CLAIMED") & (F.col("claimed_by") == F.col("worker")), F.lit(False))
    out = j.withColumn("outcome", F.when(good, "APPLIED").when(F.col("_asked"), "CONFLICT"))
    done = F.col("outcome") == "APPLIED"
    changes = {"status": F.when(F.col("error").isNull(), "DONE").otherwise("FAILED"), "claimed_by": F.lit(None), "claimed_us": F.lit(None), "available_us": F.lit(now_us)}
    return out.withColumns({c: F.when(done, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_asked", "worker")


def delegations(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(run_id, request_no, parent_id, child_id, role, scope) with outcome, taken in order within a run of tasks(run_id, task_id, parent_id, role, scope, status).

    BAD_ROLE, BAD_SCOPE (blank), NO_PARENT, NOT_ROOT (only an A0 root delegates), REPEATED_ID, SCOPE_OWNED
    (an active A2 has the scope) or LIMIT (two active A2), else DELEGATED. An A2 delegated here is active
    for the requests behind it. Of a scope only the first request can win, so its place among the firsts
    decides and no fold is needed. child_ids of requests are distinct.
    """
    parents = tasks.select("run_id", F.col("task_id").alias("parent_id"), (F.col("parent_id").isNull() & (F.col("role") == "A0")).alias("_root"))
    taken = tasks.select("run_id", F.col("task_id").alias("child_id"), F.lit(True).alias("_taken"))
    active = tasks.filter((F.col("role") == RESEARCHER) & ~F.col("status").isin(FINAL))
    busy = active.groupBy("run_id").agg(F.count("*").alias("_busy"))
    owned = active.select("run_id", "scope").distinct().withColumn("_owned", F.lit(True))
    j = requests.join(parents, ["run_id", "parent_id"], "left").join(taken, ["run_id", "child_id"], "left").join(owned, ["run_id", "scope"], "left").join(busy, "run_id", "left")
    why = (
        F.when(~F.coalesce(F.col("role").isin(ROLES), F.lit(False)), "BAD_ROLE")
        .when(F.coalesce(F.trim("scope"), F.lit("")) == "", "BAD_SCOPE")
        .when(F.col("_root").isNull(), "NO_PARENT")
        .when(~F.col("_root"), "NOT_ROOT")
        .when(F.col("_taken"), "REPEATED_ID")
        .when((F.col("role") == RESEARCHER) & F.col("_owned"), "SCOPE_OWNED")
    )
    j = j.withColumn("_why", why).withColumn("_fits", F.col("_why").isNull() & (F.col("role") == RESEARCHER))
    nth = F.row_number().over(Window.partitionBy("run_id", "scope", "_fits").orderBy("request_no"))
    j = j.withColumn("_first", F.col("_fits") & (nth == 1))
    j = j.withColumn("_place", F.sum(F.col("_first").cast("int")).over(Window.partitionBy("run_id").orderBy("request_no").rowsBetween(Window.unboundedPreceding, 0)))
    won = F.col("_first") & (F.col("_place") + F.coalesce("_busy", F.lit(0)) <= MOST_RESEARCHERS)
    j = j.withColumn("_won", won)
    mine = F.max(F.col("_won").cast("int")).over(Window.partitionBy("run_id", "scope", "_fits"))
    late = F.when(F.col("_fits") & ~F.col("_won"), F.when(mine == 1, "SCOPE_OWNED").otherwise("LIMIT"))
    return j.select(*requests.columns, F.coalesce("_why", late, F.lit("DELEGATED")).alias("outcome"))


def registry_search(rows: DataFrame, active: list[str], now: str, needle: str = "", status: str = "ALL", scene: str = "ALL", provider: str = "ALL", days: int = 0, ascending: bool = False, page: int = 1, size: int = 20) -> DataFrame:
    """A page of rows(id, mode, status, scene, provider, requested_at): needle in id and mode (case aside), RUNNING means any active status, at most days old; by time (newest first), then id."""
    want = needle.strip().lower()
    tests = [
        F.lower(F.concat_ws(" ", F.col("id").cast("string"), "mode")).contains(want) if want else None,
        None if status == "ALL" else F.col("status").isin(active) if status == "RUNNING" else F.col("status") == status,
        None if scene == "ALL" else F.col("scene") == scene,
        None if provider == "ALL" else F.col("provider") == provider,
        F.col("requested_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS") if days else None,
    ]
    for t in tests:
        rows = rows if t is None else rows.filter(t)
    return paged(rows, [F.asc("requested_at") if ascending else F.desc("requested_at"), F.asc("id")], size, page)


def known_path(path: Column) -> Column:
    """Whether a draft can be edited there: a field, titles/index or sections/id/field."""
    return path.rlike(r"^(?:[^/]+|titles/\d+|sections/[^/]+/[^/]+)$")


def patch_paths(fields: DataFrame, versions: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields after patches, outcome per draft) of drafts held as fields(draft_id, path, value) with versions(draft_id, version).

    patches(draft_id, base_version, op_no, path, old_hash, value) of a draft apply together, in order, or
    not at all: each must expect the hash of what stands at its path, be it stored or written by an
    earlier operation. Outcomes: STALE_VERSION, BAD_PATH (unknown or absent), STALE_VALUE, APPLIED (the
    version goes up by one); null without patches.
    """
    j = patches.join(versions, "draft_id").join(fields.withColumnRenamed("value", "_stored"), ["draft_id", "path"], "left")
    before = F.lag("value").over(Window.partitionBy("draft_id", "path").orderBy("op_no"))
    j = j.withColumn("_now", F.coalesce(before, "_stored"))
    verdicts = j.groupBy("draft_id").agg(
        F.bool_or(F.col("base_version") != F.col("version")).alias("old"),
        F.bool_or(~known_path(F.col("path")) | F.col("_stored").isNull()).alias("bad"),
        F.bool_or(F.coalesce(F.sha2("_now", 256) != F.col("old_hash"), F.lit(True))).alias("stale"),
    )
    outcome = F.when(F.col("old"), "STALE_VERSION").when(F.col("bad"), "BAD_PATH").when(F.col("stale"), "STALE_VALUE").otherwise("APPLIED")
    outcomes = verdicts.select("draft_id", outcome.alias("outcome"))
    last = j.join(outcomes.filter("outcome = 'APPLIED'"), "draft_id", "left_semi").groupBy("draft_id", "path").agg(F.max_by("value", "op_no").alias("_new"))
    after = fields.join(last, ["draft_id", "path"], "left").select("draft_id", "path", F.coalesce("_new", "value").alias("value"))
    raised = versions.join(outcomes, "draft_id", "left").withColumn("version", F.col("version") + F.when(F.col("outcome") == "APPLIED", 1).otherwise(0))
    return after, raised


def newest_reviews(reviews: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per draft the review of its newest reviewed version: reviews(draft_id, draft_version, review_id, verdict) of versions that drafts(draft_id, version) has; of equal ones the highest review_id."""
    known = reviews.join(drafts.select("draft_id", F.col("version").alias("draft_version")), ["draft_id", "draft_version"], "left_semi")
    return known.groupBy("draft_id").agg(F.max(F.struct("draft_version", "review_id", "verdict")).alias("m")).select("draft_id", "m.*")


def run_documents(links: DataFrame, bridge: DataFrame, direct: DataFrame) -> DataFrame:
    """Distinct (run_id, document_id): those of the events linked to a run, and those it names itself. links(run_id, event_id), bridge(event_id, document_id), direct(run_id, document_id)."""
    linked = links.distinct().join(bridge, "event_id").select("run_id", "document_id")
    return linked.union(direct.select("run_id", "document_id")).distinct()


def task_artifacts(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """tasks(task_id, attempt) with the number of artifacts(task_id, attempt) of the present attempt, and of others."""
    per = artifacts.groupBy("task_id", F.col("attempt").alias("_a")).agg(F.count("*").alias("n"))
    j = tasks.join(per, "task_id", "left")
    mine = F.col("attempt") == F.col("_a")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return j.groupBy("task_id", "attempt").agg(total(mine).alias("owned"), total(~mine).alias("stale"))


def library_commands(documents: DataFrame, commands: DataFrame, now: str, retention_days: int) -> DataFrame:
    """documents(document_id, deleted_at, purge_after, source_weight) after one of commands(document_id, command, weight) each.

    DELETE takes a document that is not deleted and sets when it may be purged, RESTORE one that is,
    WEIGHT one that is not; else the outcome is CONFLICT and nothing changes. Null without a command.
    """
    at = F.lit(now).cast("timestamp_ntz")
    gone = F.col("deleted_at").isNotNull()
    fits = ((F.col("command") == "RESTORE") & gone) | (F.col("command").isin("DELETE", "WEIGHT") & ~gone)
    j = documents.join(commands, "document_id", "left").withColumn("outcome", F.when(fits, "APPLIED").when(F.col("command").isNotNull(), "CONFLICT"))
    done = lambda c: F.coalesce((F.col("outcome") == "APPLIED") & (F.col("command") == c), F.lit(False))
    nothing = F.lit(None).cast("timestamp_ntz")
    return j.withColumns(
        {
            "deleted_at": F.when(done("DELETE"), at).when(done("RESTORE"), nothing).otherwise(F.col("deleted_at")),
            "purge_after": F.when(done("DELETE"), at + F.expr(f"INTERVAL {int(retention_days)} DAYS")).when(done("RESTORE"), nothing).otherwise(F.col("purge_after")),
            "source_weight": F.when(done("WEIGHT"), F.col("weight")).otherwise(F.col("source_weight")),
        }
    ).drop("command", "weight")
