"""Text expressions: tokens, titles, versions, slugs and classes of messages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that tell nothing about a title
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "into", "from",
    "was", "were", "are", "has", "have", "had", "its", "but", "not",
    "you", "your", "our", "out", "via", "per", "all", "any", "can",
    "did", "does",
)
#: fixed values: words of a query that aren't rare
QUERY_STOPWORDS = (
    "the", "and", "for", "with", "what", "which", "this", "that", "from", "your", "about",
    "does", "how", "why", "when", "where", "into", "over", "than", "then", "they", "them",
    "version", "latest", "current", "release",
)
#: ASCII word bounds; Java's own take accented letters for word characters
B0, B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: fixed values: failure classes of a remote call, tried in this order
FAILURES = (
    ("rate_limited", f"(?i){B0}429{B1}|rate.?limit|too many requests"),
    ("auth", f"(?i){B0}40[13]{B1}|unauthor|invalid api key|forbidden"),
    ("unreachable", f"(?i){B0}(5[0-9][0-9]){B1}|fetch failed|ECONNREFUSED|ETIMEDOUT|ENOTFOUND|socket|network"),
)
#: fixed value: words by which a query asks for the newest state
TEMPORAL = f"(?i){B0}(last|latest|newest|current|most[ -]recent|recent|up[ -]to[ -]date|now){B1}"


def strip(col: Column) -> Column:
    """Without white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def tokens(col: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def normal_title(col: Column) -> Column:
    """Lower case, without a trailing ellipsis, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"(\.\.\.|…)\s*$", ""), r"\s+", " "))


def significant_tokens(col: Column) -> Column:
    """Distinct ASCII words of three letters and more that aren't stop words."""
    parts = F.split(normal_title(col), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


_VERSION = f"(?i){B0}v?([0-9]+)\\.([0-9]+)(?:\\.([0-9]+))?([-+][A-Za-z0-9_.]+)?{B1}"


def version(col: Column) -> Column:
    """(major, minor, patch) of the first version in the text; null if it has none or that one is a pre-release."""
    part = lambda i: F.regexp_extract(col, _VERSION, i)
    number = lambda i: F.coalesce(F.when(part(i) != "", part(i)).cast("long"), F.lit(0).cast("long"))
    return F.when((part(1) != "") & (part(4) == ""), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def version_entity(col: Column) -> Column:
    """What a versioned title is about: its other significant tokens, sorted."""
    return F.array_join(F.array_sort(significant_tokens(F.regexp_replace(col, _VERSION, " "))), " ")


def failure_class(col: Column) -> Column:
    out = None
    for name, pattern in FAILURES:
        out = F.when(col.rlike(pattern), name) if out is None else out.when(col.rlike(pattern), name)
    return out.otherwise("other")


def asks_for_recent(col: Column) -> Column:
    return col.rlike(TEMPORAL)


def clip(col: Column, most: int = 2000) -> Column:
    return F.when(F.length(col) > most, F.concat(F.substring(col, 1, most - 1), F.lit("…"))).otherwise(col)


def slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def chunk_id(channel: Column, source: Column, position: Column) -> Column:
    """A stable id: channel, source and a short digest of both and the place."""
    digest = F.substring(F.sha2(F.concat_ws("\x1f", channel, source, position.cast("string")), 256), 1, 8)
    return F.concat_ws(":", channel, source, digest)


def id_parts(col: Column) -> Column:
    """channel, source and short digest of a chunk id; the source may hold colons."""
    p = F.split(col, ":")
    return F.struct(p[0].alias("channel"), F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0))), ":").alias("source"), F.element_at(p, -1).alias("short"))


def tool_of(path: Column) -> Column:
    """Which tool a memory file belongs to, by its folder, else by its name."""
    name, out = F.element_at(F.split(path, "/"), -1), None
    for tool in ("codex", "gemini", "cursor", "claude"):
        hit = path.contains(f"/.{tool}/")
        out = F.when(hit, tool) if out is None else out.when(hit, tool)
    out = out.when(path.contains("/opencode/"), "opencode").when(name == "copilot-instructions.md", "copilot").when(name.endswith(".mdc"), "cursor")
    return out.when(name.startswith("AGENTS"), "agents").when(name.startswith("CLAUDE"), "claude").when(name.startswith("GEMINI"), "gemini").otherwise("other")


def is_noop(col: Column) -> Column:
    """Prompts too short to search for."""
    text = F.lower(F.trim(col))
    return (F.length(text) < 10) | text.isin("ok", "continue", "yes", "go", "next", "sure")


def bytes_text(n: Column) -> Column:
    """A number of bytes for people: 512 B, 1.5 KB, 2.0 MB, 3.25 GB."""
    part = lambda p, digits: F.format_string(f"%.{digits}f", n / float(1024**p))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(part(1, 1), F.lit(" KB"))).when(n < 1024**3, F.concat(part(2, 1), F.lit(" MB"))).when(n.isNotNull(), F.concat(part(3, 2), F.lit(" GB")))


def elapsed_text(seconds: Column) -> Column:
    """A time for people: 59s, 1m 5s, 2h 30m."""
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).when(s.isNotNull(), F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))


def day_text(epoch: Column) -> Column:
    """The UTC day of epoch seconds as yyyy-mm-dd, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int")).cast("string")
