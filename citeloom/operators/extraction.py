"""Decisions of sources by a model: redact, ask, parse, repair at most once each way, gate, store.

Each round of answers is written to the shared folder before the next one is
decided, so that no call is made twice when an executor is lost later on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import SETTINGS
from citeloom.functions import outputs, policy, text
from citeloom.operators.decisions import parsed
from citeloom.operators.providers import dealt
from citeloom.session import keep

SYSTEM = "Read the source and answer with JSON alone: decisions with topic, summary, alternativesConsidered, confidence from 0 to 1 and touchedPaths."
OLD_CHARS, BODY_CHARS = 8_000, 12_000  # what a repair prompt quotes of the last answer and of the source
DOC_CONFIDENCE = 0.75
Complete = Callable[[DataFrame], DataFrame]  # adds what ``providers.completed`` adds to rows with ``prompt``

_ANSWERED = ("raw", "provider", "model", "tokens", "latency_ms", "failure")


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _round(rows: DataFrame, complete: Complete) -> DataFrame:
    """Answers to prompts, parsed and judged once; tokens and time are added to those of earlier rounds, the last provider stands."""
    found = parsed(complete(rows.drop("decisions", "valid", "odd", *_ANSWERED)))
    odd = F.transform("decisions", lambda d: policy.lacks_alternatives(d["alternatives"], d["summary"], F.col("said_contrast")))
    return keep(found.withColumn("odd", odd)).withColumns({"spent": F.col("spent") + F.col("tokens"), "waited": F.col("waited") + F.col("latency_ms"), "by": F.coalesce("provider", "by"), "by_model": F.coalesce("model", "by_model")})


def extract(sources: DataFrame, complete: Complete) -> DataFrame:
    """One row per source with what was extracted from it.

    Sources are dealt evenly before they are redacted and asked, and answers stay
    where they were given, so ``complete`` need not deal them again.
    ``sources`` has source_type, source_url, source_sha, title, body and perhaps
    diff. Adds decisions (consistent ones), provider and model of the last
    answer, tokens and latency_ms of all, redactions (names of secrets), repaired
    and consistency_repaired, dropped, and failure: why nothing was extracted.
    """
    diff = F.col("diff") if "diff" in sources.columns else F.lit(None).cast("string")
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    said = dealt(sources).withColumns({
        "said_contrast": policy.has_contrast(F.concat(policy.redacted(title), F.lit("\n"), policy.redacted(body))),
        "said_title": policy.redacted(title), "said_body": policy.redacted(body), "said_diff": policy.redacted(diff),
        "redactions": F.concat(policy.secret_hits(body), policy.secret_hits(title), F.coalesce(policy.secret_hits(diff), F.array().cast("array<string>"))),
        "spent": F.lit(0).cast("long"), "waited": F.lit(0).cast("long"), "by": F.lit(None).cast("string"), "by_model": F.lit(None).cast("string"),
        "repaired": F.lit(False), "consistency_repaired": F.lit(False),
    })
    asked = outputs.extraction_prompt(F.col("source_type"), F.coalesce("source_url", F.lit("")), F.col("source_sha"), F.col("said_title"), F.col("said_body"), F.col("said_diff"))
    first = _round(said.withColumn("prompt", asked), complete)
    unread = ~F.col("valid") & F.col("failure").isNull()
    again = _lines("The last answer could not be read as the asked JSON:", F.substring("raw", 1, OLD_CHARS), "", "Return corrected JSON only.")
    second = _round(first.filter(unread).withColumns({"prompt": again, "repaired": F.lit(True)}), complete)
    read = first.filter(~unread).unionByName(second)
    odd = F.col("valid") & F.exists("odd", lambda x: x)
    topics = F.array_join(F.transform(F.filter("decisions", lambda d, k: F.col("odd")[k]), lambda d: d["topic"]), "; ")
    fill = _lines(
        "These decisions name no alternative although the source or the summary contrasts some:", topics, "", "Source title:", F.col("said_title"), "", "Source body:",
        F.substring("said_body", 1, BODY_CHARS), "", "Last JSON:", F.substring(F.to_json("decisions"), 1, OLD_CHARS), "", "Fill in alternatives that the source gives, or leave those decisions out.",
    )
    third = _round(read.filter(odd).withColumns({"prompt": fill, "consistency_repaired": F.lit(True)}), complete)
    done = read.filter(~odd).unionByName(third)
    none = F.array().cast(done.schema["decisions"].dataType)
    sound = F.when(F.col("valid"), F.filter("decisions", lambda d, k: ~F.col("odd")[k])).otherwise(none)
    dropped = F.when(F.col("valid"), F.size("decisions") - F.size(sound)).otherwise(0)
    failure = F.when(~F.col("valid"), F.coalesce("failure", F.lit("the answer is not the asked JSON")))
    return done.select(
        *sources.columns, sound.alias("decisions"), F.col("by").alias("provider"), F.col("by_model").alias("model"), F.col("spent").alias("tokens"), F.col("waited").alias("latency_ms"),
        "redactions", "repaired", "consistency_repaired", dropped.cast("long").alias("dropped"), failure.alias("failure"),
    )


def confident(extracted: DataFrame, least: float = SETTINGS.min_confidence) -> DataFrame:
    """Decisions of at least a confidence, one a row, with the columns of their source."""
    own = [c for c in extracted.columns if c != "decisions"]
    return extracted.select(*own, F.explode("decisions").alias("d")).filter(F.col("d.confidence") >= least).select(*own, "d.*")


RECORD = ("repo_id", "id", "topic", "summary", "alternatives", "decided_at", "source_type", "source_url", "source_sha", "touched_paths", "confidence", "model", "superseded_by")


def records(decisions: DataFrame, git_paths: Column | None = None) -> DataFrame:
    """Rows of ``confident`` as stored records; an id is told by repository, source and topic, so a run repeated stores the same."""
    real = F.array().cast("array<string>") if git_paths is None else git_paths
    paths = F.when(F.size(real) > 0, outputs.trusted_paths(F.col("touched_paths"), real)).otherwise(F.col("touched_paths"))
    key = text.job_id(F.col("repo_id").cast("string"), F.col("source_type"), F.col("source_sha"), F.col("topic"))
    return decisions.withColumns({"id": key, "touched_paths": paths, "superseded_by": F.lit(None).cast("string")}).select(*RECORD)


def doc_records(drafts: DataFrame, source_sha: Column, decided_at: Column) -> DataFrame:
    """Drafts of ``jobs.doc_run`` as stored records of kind ``doc``: cited at their line, never linked by supersession."""
    link = text.blob_link(F.col("https_base"), source_sha, F.col("file_path"), F.col("start_line"))
    made = drafts.filter(F.coalesce("file_path", F.lit("")) != "").withColumns({
        "source_type": F.lit("doc"), "source_url": link, "source_sha": source_sha, "decided_at": decided_at, "alternatives": F.array().cast("array<string>"),
        "touched_paths": F.array("file_path"), "confidence": F.lit(DOC_CONFIDENCE), "model": F.lit("doc"), "superseded_by": F.lit(None).cast("string"),
        "id": text.job_id(F.col("repo_id").cast("string"), F.lit("doc"), F.col("file_path"), F.col("start_line").cast("string")),
    })
    return made.select(*RECORD)


def stored(decisions: DataFrame, run: DataFrame) -> DataFrame:
    """Stored records after a run over documents: those of the run take the place of earlier ones of the same files."""
    files = run.select("repo_id", F.explode("touched_paths").alias("path")).distinct()
    old = decisions.filter("source_type = 'doc'").select("repo_id", "id", F.explode("touched_paths").alias("path"))
    gone = old.join(files, ["repo_id", "path"], "left_semi").select("repo_id", "id").distinct()
    return decisions.join(gone, ["repo_id", "id"], "left_anti").unionByName(run)
