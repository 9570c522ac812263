"""What a prompt is given: titles and snippets of its hits, grouped by channel and cut to a budget; and small text tools."""

import json
import re
from collections.abc import Iterator
from math import inf, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import byte_pairs
from quarry.functions.byte_pairs import MARKER, Ranks

#: fixed value: channels in the order in which they are shown
CHANNELS = ("inbox", "memory", "skill", "observation", "remote")


def title_of(meta: Column) -> Column:
    """The first of a chunk's section title, file id and title that it has; meta is JSON."""
    pick = lambda k: F.get_json_object(meta, f"$.{k}")
    return F.coalesce(pick("section_title"), pick("filename_id"), pick("title"), F.lit("Untitled"))


def token_count(text: Column) -> Column:
    """Words and marks: a plain stand-in for a model's tokens."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))


def truncated(text: Column, budget: int) -> Column:
    """text, or as many of its tokens as leave room for the marker."""
    keep = max(0, budget - 3)
    head = F.regexp_extract(text, r"(?s)\A(?:\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])){0," + str(keep) + "}", 0)
    return F.when(token_count(text) <= budget, text).otherwise(F.concat(head, F.lit(MARKER)))


def savings(work: Column, read: Column) -> Column:
    """The badge of a record that took `work` tokens and is read for `read`: the share saved, in percent; null if nothing is known of the work."""
    saved = F.greatest(F.lit(0), work - read)
    return F.when(work > 0, F.concat(F.lit("saved "), F.floor(saved * 100 / work + 0.5).cast("string"), F.lit("%")))


def envelopes(hits: DataFrame, budget: int = 4000, ranks: Ranks | None = None) -> DataFrame:
    """(query_id, hits, envelope) of hits (query_id, rank, channel, title, snippet, score): groups by channel, in rank order, cut to a budget.

    Tokens are counted by ranks if they are given, else as words and marks. More columns that hits may have: inbox (boolean; such hits come first whatever their
    channel, without a heading, with sender and sent, or as their title alone if inbox_summary is true), and work_tokens, from which a badge says what is saved.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in hits.columns else F.lit(None).cast(kind)
    count = (lambda c: byte_pairs.token_count(c, ranks)) if ranks else token_count
    inbox = F.coalesce(has("inbox", "boolean"), F.lit(False))
    order = F.element_at(F.create_map(*(x for i, c in enumerate(CHANNELS) for x in (F.lit(c), F.lit(i)))), F.when(inbox, "inbox").otherwise(F.col("channel")))
    snippet = F.trim(F.substring("snippet", 1, 600))
    line = F.concat(F.lit("### "), F.col("title"), F.lit(" · score "), F.format_number("score", 2), F.lit("\n"), snippet)
    sent = F.coalesce(F.concat(F.lit(" · "), F.nullif(has("sent", "string"), F.lit(""))), F.lit(""))
    note = F.when(F.coalesce(has("inbox_summary", "boolean"), F.lit(False)), F.col("title")).otherwise(F.concat(F.lit("### 📨 "), F.coalesce(has("sender", "string"), F.lit("peer")), sent, F.lit("\n"), snippet))
    rows = hits.withColumns({"o": F.coalesce(order, F.lit(len(CHANNELS))), "channel": F.when(inbox, "inbox").otherwise(F.col("channel")), "line": F.when(inbox, note).otherwise(line)})
    if "work_tokens" in hits.columns:
        badge = F.when(~inbox, savings(F.col("work_tokens"), count(F.col("line"))))
        rows = rows.withColumn("line", F.concat_ws("\n", "line", badge))
    group = rows.withColumn("note", inbox).groupBy("query_id", "o", "channel").agg(F.count("*").alias("n"), F.max("note").alias("note"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("body"))
    group = group.withColumn("body", F.when(F.col("note"), F.col("body")).otherwise(F.concat(F.lit("## "), "channel", F.lit("\n"), "body")))
    whole = group.groupBy("query_id").agg(F.sum("n").alias("hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    cut = byte_pairs.truncated(F.col("body"), budget, ranks) if ranks else truncated(F.col("body"), budget)
    return whole.select("query_id", "hits", F.concat(F.lit("<memory-context>\n"), cut, F.lit("\n</memory-context>")).alias("envelope"))


def audit_lines(hits: DataFrame, ts_ms: int, profile: str) -> DataFrame:
    """One line of the recall audit for each query, appended by date: its hits with snippets of 200 characters."""
    h = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "channel", "score", F.substring("snippet", 1, 200).alias("snippet")))), lambda x: x.dropFields("rank"))
    return hits.groupBy("query_id").agg(h.alias("hits")).withColumns({"ts": F.lit(ts_ms), "rank_profile": F.lit(profile)})


def front_matter_of(body: Column, kind: Column) -> Column:
    """name, description and slug of a memory by rule: its first line, its text in one line, both cut."""
    first = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0), F.lit(1)), kind)
    name = F.substring(first, 1, 120)
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.struct(name.alias("name"), F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, 280).alias("description"), F.coalesce(F.nullif(slug(name), F.lit("")), slug(kind)).alias("slug"))


def file_prefix(kind: Column) -> Column:
    """Fixed names: what a memory's file begins with."""
    return F.when(kind.isin("feedback", "preference"), "feedback").otherwise(kind)


def grade(reply: Column) -> Column:
    """A judge's grade 0..3: the first such digit, else a number cut to that range, else 0."""
    digit, number = F.regexp_extract(reply, "([0-3])", 1), F.regexp_extract(reply, "([0-9]+)", 1)
    return F.when(digit != "", digit.cast("int")).when(number != "", F.least(F.lit(3), F.greatest(F.lit(0), F.try_to_number(number, F.lit("999")).cast("int")))).otherwise(0)


_BARE = re.compile(r'"\s*(?:[,:}\]]|\Z)')


def repaired_json(reply: str | None) -> str | None:
    """The object in a model's reply, with quotes inside strings escaped where they don't end one; null if it still isn't JSON."""
    found = re.search(r"\{.*\}", reply or "", re.DOTALL)
    if not found:
        return None
    text, out, inside, i = found[0], [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if inside and not _BARE.match(text, i):
                out.append("\\")
            else:
                inside = not inside
        out.append(c)
        i += 1
    try:
        json.loads("".join(out))
    except ValueError:
        return None
    return "".join(out)


#: fixed values: git commands that change something
_MUTATING = {"checkout", "switch", "commit", "reset", "stash", "rebase", "merge", "cherry-pick", "clean", "restore"}


def git_op(command: str | None) -> str | None:
    """The first command of a shell line that has git change something."""
    for part in re.split(r"&&|\|\||;|\|", command or ""):
        words = part.split()
        while words and re.match(r"[A-Za-z_]\w*=", words[0]):
            words.pop(0)
        if not words or words.pop(0) != "git":
            continue
        while words and words[0].startswith("-"):
            del words[: 2 if words[0] in ("-C", "-c") else 1]
        if words and words[0] in _MUTATING:
            return words[0]
    return None


def parsed(rows: DataFrame, column: str, tool, out: str) -> DataFrame:
    """rows with `out`: a text tool of this module over a column, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [tool(x) for x in pdf[column]]})

    return rows.mapInPandas(run, rows.withColumn(out, F.lit("")).schema)


def bridgeable_days(eps: float, tau_days: float, temporal: float = 0.375, co: float = 0.625) -> float:
    """The greatest gap in time over which pairs that are always used together can still be in one cluster."""
    needed = 1 - eps - co
    if needed <= 0:
        return inf
    if temporal <= 0 or needed >= temporal:
        return 0.0
    return -tau_days * log(needed / temporal)


def tau_for(window_days: float, eps: float, temporal: float = 0.375, co: float = 0.625) -> float:
    """The least tau, in days, by which a window can cluster from end to end; 0 if any does."""
    one = bridgeable_days(eps, 1.0, temporal, co)
    return 0.0 if one == inf else inf if one <= 0 else window_days / one


def blocking(ingesting: bool, pending: int, sessions: int) -> list[str]:
    """What keeps background work from running now."""
    return [name for name, on in (("summarizing", ingesting), ("queue", pending > 0), ("co-session", sessions > 0)) if on]


def permutation_p(with_: list[float], without: list[float], rounds: int = 2000, seed: int = 1) -> float:
    """Two-sided permutation test of a difference of means, by seeded shuffles."""
    import numpy as np

    a, b = np.asarray(with_, float), np.asarray(without, float)
    if not len(a) or not len(b):
        return 1.0
    both, rng = np.concatenate((a, b)), np.random.default_rng(seed)
    seen = abs(a.mean() - b.mean())
    hits = 0
    for _ in range(rounds):
        rng.shuffle(both)
        hits += abs(both[: len(a)].mean() - both[len(a) :].mean()) >= seen - 1e-12
    return (hits + 1) / (rounds + 1)
