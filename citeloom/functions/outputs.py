"""Texts and keys that queries return or are cached and authorised by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import SPACE, changed_paths, trimmed


# Fixed value: heading of the list of changed files.
CHANGED = "Changed files (from git — use these for touchedPaths; do not invent paths):"


def paths_summary(paths: Column, most: int = 40) -> Column:
    """A line for each of the first paths and how many more there are; null without any."""
    shown = F.transform(F.slice(paths, 1, most), lambda p: F.concat(F.lit("- "), p))
    more = F.when(F.size(paths) > most, F.array(F.concat(F.lit("- …and "), (F.size(paths) - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit(CHANGED))
    return F.when(F.size(paths) > 0, F.array_join(F.concat(head, shown, more), "\n"))


STAT_CHARS = 4096
# What follows a change statistic that is cut, and what stands before one.
STAT_CUT, STAT_HEAD = "\n…(stat truncated)", "Diff stat:\n"


def stat_summary(stat: Column, most: int = STAT_CHARS) -> Column:
    """A change statistic without surrounding space, cut to ``most`` characters; null without any."""
    t = trimmed(stat)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(STAT_CUT))).when(t != "", t)


def diff_summary(paths: Column, stat: Column, most: int = 40) -> Column:
    """Changed paths and their statistic in one text; null without both."""
    both = F.concat_ws("\n\n", paths_summary(paths, most), F.when(F.coalesce(stat, F.lit("")) != "", F.concat(F.lit(STAT_HEAD), stat)))
    return F.when(both != "", both)


def touched_paths(raw_json: Column) -> Column:
    """Distinct paths of a stored record's ``touchedPaths``; none for other records."""
    found = F.from_json(raw_json, "struct<touchedPaths:array<string>>")["touchedPaths"]
    return changed_paths(F.coalesce(found, F.array().cast("array<string>")), 1 << 30)


def first_filled(*lists: Column, most: int = 100) -> Column:
    """The first list that is not empty, cut to ``most``."""
    out = F.array().cast("array<string>")
    for c in reversed(lists):
        out = F.when(F.size(c) > 0, c).otherwise(out)
    return F.slice(out, 1, most)


def trusted_paths(claimed: Column, real: Column, most: int = 40) -> Column:
    """Claimed paths that are real, in their order; without any, the first real ones."""
    kept = F.filter(claimed, lambda p: F.array_contains(real, p))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(real, 1, most))


def cache_key(options: Column, repo: Column, epoch: Column) -> Column:
    """Digest of options (a struct in order of name), repository and index epoch."""
    return F.sha2(F.concat_ws("|", F.to_json(options), repo, epoch.cast("string")), 256)


def bearer(header: Column) -> Column:
    """Digest of a bearer token; null for other headers."""
    token = F.regexp_extract(header, r"(?i)^Bearer\s+(\S+)\s*$", 1)
    return F.when(token != "", F.sha2(token, 256))


def hit_line(rank: Column, path: Column, score: Column, content: Column) -> Column:
    """One line of a result: rank, path, score to three places, and 200 characters."""
    flat = trimmed(F.regexp_replace(content, f"{SPACE}+", " "))
    return F.concat(rank.cast("string"), F.lit(". "), path, F.lit(" ("), F.format_string("%.3f", score), F.lit(") "), F.substring(flat, 1, 200))


def decision_lines(rank: Column, topic: Column, summary: Column, alternatives: Column, url: Column, confidence: Column, score: Column, superseded: Column) -> Column:
    """A found decision: topic, state and scores, then summary, alternatives and source."""
    state = F.when(superseded, "superseded").otherwise("active")
    head = F.concat(rank.cast("string"), F.lit(". "), topic, F.lit(" ["), state, F.lit("] (confidence="), F.format_string("%.2f", confidence), F.lit(", retrievalScore="), F.format_string("%.4f", score), F.lit(")"))
    other = F.when(F.size(alternatives) > 0, F.array_join(alternatives, "; ")).otherwise("(none recorded)")
    return F.concat_ws("\n", head, summary, F.concat(F.lit("Alternatives: "), other), F.concat(F.lit("Source: "), url))


def explained_text(path: Column, summaries: Column, decisions: Column) -> Column:
    """What is known of a file: its summaries, and decisions (structs of topic, superseded, decided_at, summary, source_url)."""
    numbered = lambda k, line: F.concat((k + 1).cast("string"), F.lit(". "), line)
    chunks = F.when(F.size(summaries) > 0, F.array_join(F.transform(summaries, lambda s, k: numbered(k, s)), "\n")).otherwise("No indexed chunks for this path.")
    state = lambda d: F.when(d["superseded"], "superseded").otherwise("active")
    told = lambda d, k: F.concat_ws("\n", numbered(k, F.concat(d["topic"], F.lit(" ["), state(d), F.lit("] ("), d["decided_at"], F.lit(")"))), d["summary"], F.concat(F.lit("Source: "), d["source_url"]))
    related = F.when(F.size(decisions) > 0, F.array_join(F.transform(decisions, told), "\n\n")).otherwise("No related decisions.")
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.lit(""), F.lit("Chunks:"), chunks, F.lit(""), F.lit("Related decisions:"), related)


def extraction_prompt(kind: Column, url: Column, sha: Column, title: Column, body: Column, diff: Column) -> Column:
    head = F.concat_ws("\n", F.concat(F.lit("Source type: "), kind), F.concat(F.lit("Source URL: "), url), F.concat(F.lit("Source SHA: "), sha), F.concat(F.lit("Title: "), title), F.lit(""), F.lit("Body:"), body)
    return F.concat_ws("\n", head, F.when(diff.isNotNull(), F.concat(F.lit("\nDiff summary:\n"), diff)))
