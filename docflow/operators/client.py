"""A client's tasks, pages and captures as tables: what is shown, and what may be done next.

Tasks: ``task_id, document_id, title, created_at, page_ids, submitted_page_ids, uploaded_page_ids, failed_page_ids,
accepted, phase, error, local_error, connection_issue, retryable, hidden``; a task without submitted pages is a draft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORKING = ("OCR", "ASSEMBLING", "VALIDATING")
#: What takes up one of the slots for captures, and how many slots there are.
UNDER_WAY, SLOTS = ("QUEUED", "CAPTURING", "SAVING"), 3
FINISHABLE = ("NORMALIZING", "READY", "FAILED")


def is_draft() -> Column:
    return F.col("submitted_page_ids").isNull()


def effective_pages() -> Column:
    return F.coalesce("submitted_page_ids", "page_ids")


def some_missing() -> Column:
    """Whether a page that counts isn't uploaded."""
    return F.size(F.array_except(effective_pages(), F.col("uploaded_page_ids"))) > 0


def some_failed() -> Column:
    return F.arrays_overlap(effective_pages(), F.col("failed_page_ids"))


def done() -> Column:
    return ~is_draft() & F.col("accepted") & (F.col("phase") == "COMPLETED")


def display_status() -> Column:
    """What a task is shown as: the first that holds."""
    failed = F.col("error").isNotNull() | F.col("local_error").isNotNull() | (F.col("phase") == "FAILED") | some_failed()
    return (
        F.when(failed, "FAILED").when(F.col("document_id").isNull() | F.col("connection_issue").isNotNull(), "NOT_CONNECTED").when(some_missing(), "UPLOADING")
        .when(done(), "COMPLETED").when(F.col("phase").isin(*WORKING) | ~is_draft(), "PROCESSING").otherwise("IDLE")
    )


def sync_step() -> Column:
    """What a synchronisation that met no error leaves to be done; an error that can't be tried again blocks it."""
    blocked = (F.col("error").isNotNull() & ~F.col("retryable")) | (F.col("phase") == "FAILED") | F.col("local_error").isNotNull() | some_failed()
    waits = some_missing() | (~is_draft() & ~(F.col("accepted") & (F.col("phase") == "COMPLETED"))) | (is_draft() & (F.col("phase") == "OCR"))
    return F.when(blocked, "BLOCKED").when(F.col("connection_issue").isNotNull(), "RETRY").when(waits, "WAITING").otherwise("DONE")


def visible(tasks: DataFrame, search: str) -> DataFrame:
    """Tasks that aren't hidden and have the search in their title, whatever its case; newest first."""
    hit = F.contains(F.lower("title"), F.lit(search.strip().lower()))
    return tasks.filter(~F.col("hidden") & hit).orderBy(F.desc("created_at"), "task_id")


def capture_admission(captures: DataFrame) -> DataFrame:
    """``session_id, admitted`` from ``session_id, state``: whether another capture may begin."""
    return captures.groupBy("session_id").agg((F.count_if(F.col("state").isin(*UNDER_WAY)) < SLOTS).alias("admitted"))


def finish_gate(sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """``session_id, may_finish``: there is a candidate (``session_id, state, safe``), and each is safe and in a state that allows it."""
    states = candidates.groupBy("session_id").agg(F.bool_and(F.col("safe") & F.col("state").isin(*FINISHABLE)).alias("ok"))
    return sessions.select("session_id").join(states, "session_id", "left").select("session_id", F.coalesce("ok", F.lit(False)).alias("may_finish"))


def page_stages(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages (``page_id, state``) with the stage of their job (``page_id, stage``), which counts before their own state."""
    return pages.join(jobs.select("page_id", "stage"), "page_id", "left").withColumn("stage", F.coalesce("stage", "state"))


def pages_to_upload(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """``task_id, page_id`` of a task's pages that count, are ready (``page_id, state``) and aren't uploaded."""
    wanted = tasks.select("task_id", F.explode(F.array_except(effective_pages(), F.col("uploaded_page_ids"))).alias("page_id"))
    return wanted.join(pages.filter("state = 'READY'").select("page_id"), "page_id", "left_semi").select("task_id", "page_id")


def orphan_jobs(jobs: DataFrame, *known: DataFrame) -> DataFrame:
    """Jobs (``page_id``) of pages that none of the ``known`` tables has: not there, not reserved, not deleted."""
    for table in known:
        jobs = jobs.join(table.select("page_id"), "page_id", "left_anti")
    return jobs
