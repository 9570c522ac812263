"""Themes as an append-only log: made by a judge's draft, unmade, listed, and folded into records."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.operators import context
from quarry.operators import semantic as G
from quarry.operators.judging import Judge, judged

DRAFT = "title string, narrative string, facts array<string>, concepts array<string>"
_ASK = 'These notes may have one thing in common. If so, reply with JSON: {"title", "narrative", "facts", "concepts"}. If not, reply: DECLINE.'


@F.pandas_udf(StringType())
def _repaired(reply: pd.Series) -> pd.Series:
    return reply.map(context.repaired_json)


def drafted(records: DataFrame, stars: DataFrame, declined: DataFrame, judge: Judge, path: str, now: int, ttl_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(created, declines) of one pass over stars (seed_id, id), clusters of records; path keeps the judge's answers.

    created: theme_id, cluster_key, member_ids, counters and last_surfaced of the members, project_id, branch, the draft's columns and created. declines: cluster_key,
    declined_at. Clusters declined within ttl_days aren't asked about; a cluster without an answer is in neither. A reply without a title is a decline.
    """
    live = records.where(~F.col("archived"))
    member = stars.join(live.select("id"), "id", "left_semi")
    clusters = G.themes(live, member, declined, now, ttl_days).where(F.size("member_ids") >= 2)
    said = member.join(live.select("id", "title", "project_id", "branch"), "id").groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("m"), F.first("project_id").alias("project_id"), F.first("branch").alias("branch"))
    asked = clusters.drop("session_id", "type").join(said, "seed_id")
    lines = F.transform("m", lambda x: F.concat(F.lit("- "), F.coalesce(x["title"], F.lit(""))))
    prompt = F.concat_ws("\n", F.lit(_ASK), F.array_join(lines, "\n"))
    told = judged(asked, F.concat_ws("\x1f", F.col("cluster_key"), prompt), prompt, judge, path).where("reply is not null")
    draft = told.withColumn("draft", F.from_json(_repaired("reply"), DRAFT))
    fine = F.coalesce(F.length(F.trim("draft.title")) > 0, F.lit(False))
    created = draft.where(fine).select(
        F.xxhash64(F.lit("theme"), "cluster_key", F.lit(now)).alias("theme_id"), "cluster_key", "member_ids", "project_id", "branch", "from_auto", "from_search", "from_drill", "last_surfaced", "draft.*", F.lit(now).cast("long").alias("created")
    )
    return created, draft.where(~fine).select("cluster_key", F.lit(now).cast("long").alias("declined_at"))


def unmade(created: DataFrame, gone: DataFrame, theme_ids: DataFrame, now: int) -> DataFrame:
    """New rows (theme_id, unmade_at) of the log of unmade themes: the asked ones that are themes and still live, so asking twice is harmless."""
    live = created.select("theme_id").join(gone.select("theme_id"), "theme_id", "left_anti")
    return theme_ids.select("theme_id").distinct().join(live, "theme_id", "left_semi").withColumn("unmade_at", F.lit(now).cast("long"))


def listed(created: DataFrame, gone: DataFrame, limit: int = 50) -> DataFrame:
    """The newest live themes: theme_id, title, created, member_ids."""
    live = created.join(gone.select("theme_id"), "theme_id", "left_anti")
    return live.select("theme_id", "title", "created", "member_ids").orderBy(F.desc("created"), F.desc("theme_id")).limit(limit)


def folded(records: DataFrame, created: DataFrame, gone: DataFrame) -> DataFrame:
    """records with all themes applied: members of live themes are archived into them (theme_id), and each theme is a record of its own, archived
    if it was unmade. A record that several live themes name belongs to the earliest; what was archived before stays without a theme."""
    live = created.join(gone.select("theme_id"), "theme_id", "left_anti")
    owner = live.select("theme_id", "created", F.explode("member_ids").alias("id")).groupBy("id").agg(F.min_by("theme_id", F.struct("created", "theme_id")).alias("theme_id"))
    j = records.join(owner, "id", "left").withColumn("theme_id", F.when(~F.col("archived"), F.col("theme_id")))
    j = j.withColumn("archived", F.col("archived") | F.col("theme_id").isNotNull()).withColumn("member_ids", F.lit(None).cast("array<long>"))
    state = created.join(gone.select("theme_id", F.lit(True).alias("archived")).distinct(), "theme_id", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))
    own = state.select(F.col("theme_id").alias("id"), F.lit("theme").alias("session_id"), F.lit("discovery").alias("type"), "title", "project_id", "branch", "from_auto", "from_search", "from_drill", "last_surfaced", "created", "archived", "member_ids")
    return j.unionByName(own, allowMissingColumns=True)
