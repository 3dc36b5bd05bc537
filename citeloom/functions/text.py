"""Scalar functions on texts, identifiers, paths and links, as column expressions.

Word boundaries are written out as ASCII classes: the two-sided forms behave
alike in Java and in other regex engines, where ``\\b`` differs on accents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.config import SETTINGS

# White space as a text trim removes it, word tokens, and document extensions.
SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
BAG_TOKEN = r"[A-Za-z_][A-Za-z0-9_]+"
DOC_EXTENSION = r"(?i)\.(md|mdx|rst|txt|adoc)$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def slashed(path: Column) -> Column:
    return F.translate(trimmed(path), "\\", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def split_identifier(raw: Column) -> Column:
    """Lowered identifier, then its snake and camel parts: two characters or more, distinct, in order."""
    camel = lambda p: F.split(F.regexp_replace(F.regexp_replace(p, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), " ")
    parts = F.flatten(F.transform(F.split(raw, "_"), camel))
    whole = F.array(F.lower(raw))
    every = F.when(raw.rlike("_|[a-z0-9][A-Z]|[A-Z]{2}[a-z]"), F.concat(whole, F.transform(parts, F.lower))).otherwise(whole)  # most words have one part
    return F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2))


def sparse_tokens(text: Column) -> Column:
    """Identifiers and numbers of a text, each with its parts; repeats are kept."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), split_identifier))


def fnv1a(term: Column) -> Column:
    """FNV-1a over the characters of an ASCII term, as an unsigned 32-bit number."""
    codes = F.transform(F.filter(F.split(term, ""), lambda x: x != ""), F.ascii)
    step = lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def bm25_tf(tf: Column, length: Column) -> Column:
    k1, b, avg = SETTINGS.bm25_k1, SETTINGS.bm25_b, SETTINGS.bm25_avgdl
    norm = tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(avg))
    return F.when((tf <= 0) | (length <= 0), F.lit(0.0)).otherwise(tf * F.lit(k1 + 1) / norm)


def lexical_query(raw: Column) -> Column:
    """Query without surrounding space and one pair of equal quotes."""
    t = trimmed(raw)
    ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    quoted = (F.length(t) >= 2) & ends.isin("\"\"", "''", "``")
    return F.when(quoted, trimmed(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def like_escaped(raw: Column) -> Column:
    return F.regexp_replace(raw, r"([\\%_])", r"\\$1")


def is_path_like(q: Column) -> Column:
    return F.contains(q, F.lit("/")) | q.rlike(r"(?i)\.[a-z0-9]{1,8}$")


def is_extension_only(q: Column) -> Column:
    return trimmed(q).rlike(r"(?i)^\.[a-z0-9]{1,8}$")


def lexical_match(q: Column, path: Column, symbol: Column, content: Column) -> Column:
    """Kind of the first rule that matches, or null."""
    p, s = trimmed(path), trimmed(F.coalesce(symbol, F.lit("")))
    return (
        F.when(q == "", F.lit(None))
        .when((s != "") & (s == q), "symbol_exact")
        .when((p == q) | (basename(p) == q), "path_exact")
        .when(~is_extension_only(q) & F.endswith(p, F.concat(F.lit("/"), q)), "path_suffix")
        .when((s != "") & F.contains(F.lower(s), F.lower(q)), "symbol_soft")
        .when((F.length(q) >= 3) & F.contains(content, q), "content")
    )


def lexical_score(kind: Column) -> Column:
    scores = {"symbol_exact": 1.0, "path_exact": 0.98, "path_suffix": 0.92, "symbol_soft": 0.75, "content": 0.45}
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), scores.items(), F.when(F.lit(False), F.lit(0.0)))


def lexical_evidence(kind: Column) -> Column:
    exact = kind.isin("symbol_exact", "path_exact", "path_suffix")
    return F.when(exact, 1.0).when(kind == "symbol_soft", 0.4).when(kind == "content", 0.0)


def path_class(path: Column) -> Column:
    base = basename(slashed(path))
    return F.when(base.rlike(DOC_EXTENSION) | base.rlike(r"(?i)^readme(\.|$)"), "doc").otherwise("source")


def doc_slots(limit: int) -> int:
    return 0 if limit <= 0 else max(1, limit // 2)


def is_decision_doc(path: Column) -> Column:
    p = slashed(path)
    base = basename(p)
    named = base.rlike(r"(?i)^(safety|architecture|adr.*)\.md$")
    placed = base.rlike(r"(?i)\.md$") & p.rlike(r"(?i)(^|/)docs/(?:.+/)?decisions/")
    return (base != "") & ~F.contains(p, F.lit("\0")) & (named | placed)


def is_citation(url: Column) -> Column:
    """Whether a link is one of the web, with a host."""
    return F.coalesce(trimmed(url).rlike(r"(?i)^https?://[^\s/?#:@]+(:[0-9]{1,5})?([/?#]\S*)?$"), F.lit(False))


def index_text(path: Column, symbol: Column, content: Column) -> Column:
    """Header lines (path, base name, symbol), an empty line, and the trimmed content."""
    p, s, body = slashed(path), trimmed(F.coalesce(symbol, F.lit(""))), trimmed(content)
    base = basename(p)
    some = lambda c, keep: F.when(keep, c)
    header = F.concat_ws("\n", some(p, p != ""), some(base, (base != "") & (base != p)), some(s, s != ""))
    return F.concat_ws("\n\n", some(header, header != ""), some(body, body != ""))


def decision_text(topic: Column, summary: Column, alternatives: Column) -> Column:
    listed = F.concat(F.lit("Alternatives considered: "), F.array_join(alternatives, "; "))
    return F.concat_ws("\n\n", topic, summary, F.when(F.size(alternatives) > 0, listed))


def chunk_summary(symbol: Column, start: Column, end: Column, content: Column) -> Column:
    flat = trimmed(F.regexp_replace(content, f"{SPACE}+", " "))
    name = F.when(trimmed(F.coalesce(symbol, F.lit(""))) != "", F.concat(symbol, F.lit(" "))).otherwise("")
    dots = F.when(F.length(flat) > 160, "…").otherwise("")
    return F.concat(name, F.lit("["), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("] "), F.substring(flat, 1, 160), dots)


def github_base(remote: Column) -> Column:
    """Web address of a repository from its ssh or https remote; null otherwise."""
    slug = F.regexp_extract(trimmed(remote), r"(?i)^(?:git@github\.com:|ssh://git@github\.com/|https?://(?:[^@/]+@)?github\.com/)([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return F.when(slug != "", F.concat(F.lit("https://github.com/"), slug))


def commit_link(base: Column, slug: Column, sha: Column) -> Column:
    local = F.concat(F.lit("local://"), slug)
    return F.concat(F.coalesce(base, local), F.lit("/commit/"), sha)


def blob_link(base: Column, sha: Column, path: Column, line: Column) -> Column:
    """Link to a line of a file, each segment of the path percent-encoded."""
    encode = lambda s: F.regexp_replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), "%7E", "~")
    parts = F.array_join(F.transform(F.split(F.translate(path, "\\", "/"), "/"), encode), "/")
    at = F.when(line > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise("")
    return F.concat(F.regexp_replace(base, "/$", ""), F.lit("/blob/"), sha, F.lit("/"), parts, at)


def job_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def epoch_of(full: Column, incremental: Column) -> Column:
    """Greatest of two times in milliseconds; 0 without any."""
    return F.coalesce(F.greatest(F.unix_millis(full.cast("timestamp")), F.unix_millis(incremental.cast("timestamp"))), F.lit(0))


def changed_paths(paths: Column, most: int = 40) -> Column:
    """Distinct trimmed paths without NUL, in first-seen order."""
    clean = F.transform(paths, trimmed)
    return F.slice(F.array_distinct(F.filter(clean, lambda p: (p != "") & ~F.contains(p, F.lit("\0")))), 1, most)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def bag_vector(text: Column, size: int = SETTINGS.vector_size) -> Column:
    """Deterministic bag-of-words vector: tokens hashed to dimensions, scaled to length 1."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(BAG_TOKEN), 0)
    dims = F.transform(tokens, lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long") % size)
    each = F.sequence(F.lit(0), F.lit(size - 1))
    counts = bound(dims, lambda d: F.transform(each, lambda k: F.size(F.filter(d, lambda x: x == k)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return bound(counts, lambda c: bound(norm(c), lambda n: F.transform(c, lambda x: x / F.when(n == 0, 1.0).otherwise(n))))
