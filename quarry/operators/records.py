"""The record table (observations): state changes as event logs that are folded, never updated in place."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lifecycle as L
from quarry.functions import text as T

SCOPE = ("project_id", "branch")


def viewed(records: DataFrame, view: str = "all", kind: str | None = None, title: str | None = None) -> DataFrame:
    """All records that aren't archived, seen through a view, with their total."""
    total = F.col("from_auto") + F.col("from_search") + F.col("from_drill")
    views = {"all": F.lit(True), "surfaced": total > 0, "recalled": F.col("from_drill") > 0, "recent": F.col("last_surfaced").isNotNull(), "themes": F.col("session_id") == "theme"}
    rows = records.where(~F.col("archived") & views[view]).withColumn("total", total)
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    if title:
        rows = rows.where(F.contains(F.lower("title"), F.lit(title.lower())))
    return rows


def page(records: DataFrame, view: str = "all", kind: str | None = None, title: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the recall browser: what is seen, most surfaced first."""
    rows = viewed(records, view, kind, title)
    return rows.orderBy(F.desc("total"), F.desc_nulls_last("last_surfaced"), F.desc("id")).offset(offset).limit(limit)


def sweep_candidates(records: DataFrame, state: str, cutoff: int, limit: int = 256) -> DataFrame:
    """Oldest records of a state that nothing protects and nothing surfaced since cutoff."""
    seen = F.coalesce("last_surfaced", "created")
    rows = records.where((F.col("tide_state") == state) & ~F.col("is_anchored") & (F.col("from_drill") == 0) & (seen < cutoff))
    return rows.orderBy(seen, "id").limit(limit)


def promotion_candidates(records: DataFrame, least: int = 1, limit: int = 5) -> DataFrame:
    total = F.col("from_auto") + F.col("from_search") + F.col("from_drill")
    rows = records.where(F.col("promoted_at").isNull() & ~F.col("archived") & F.col("type").isin("decision", "feature", "discovery") & (total >= least))
    return rows.orderBy(F.desc("created"), F.desc("id")).limit(limit)


def bumped(records: DataFrame, events: DataFrame, tide: L.Tide = L.Tide()) -> DataFrame:
    """records after surfacing events (id, ts, seq, src): counters, last surfacing, stability folded in time order, state afloat again."""
    log = events.groupBy("id").agg(
        *(F.count(F.when(F.col("src") == s, 1)).alias(f"n_{s}") for s in ("auto", "search", "drill")),
        F.max("ts").alias("last"),
        F.collect_list(F.struct("ts", "seq", "src")).alias("log"),
    )
    j = records.join(log, "id", "left")
    start = F.coalesce("stability_days", F.lit(tide.start_days))
    out = j.withColumn("stability_days", F.when(F.col("log").isNull(), F.col("stability_days")).otherwise(L.folded_stability(F.col("log"), start, tide)))
    for s in ("auto", "search", "drill"):
        out = out.withColumn(f"from_{s}", F.col(f"from_{s}") + F.coalesce(f"n_{s}", F.lit(0)))
    out = out.withColumn("last_surfaced", F.greatest("last_surfaced", "last")).withColumn("tide_state", F.when(F.col("log").isNotNull(), "active").otherwise(F.col("tide_state")))
    return out.select(*records.columns)


def swept(records: DataFrame, now: int, tide: L.Tide = L.Tide()) -> DataFrame:
    """records with tide_state after one sweep of all of them."""
    b = L.buoyancy(F.col("stability_days"), F.col("last_surfaced"), F.col("created"), F.col("is_anchored"), now, tide)
    return records.withColumn("tide_state", L.tier(F.col("tide_state"), b, F.col("last_surfaced"), F.col("created"), F.col("is_anchored"), F.col("from_drill"), now, tide))


def version_heads(records: DataFrame) -> DataFrame:
    """Versioned records with the newest version of their scope and entity: head_id, ties to the lower id."""
    rows = records.withColumn("version", T.version(F.col("title"))).withColumn("entity", T.version_entity(F.col("title")))
    rows = rows.where(F.col("version").isNotNull() & (F.col("entity") != ""))
    w = Window.partitionBy(*SCOPE, "entity").orderBy(F.col("version").desc(), F.col("id"))
    first = lambda c: F.first(c).over(w)
    return rows.withColumns({"head_id": first("id"), "head_version": first("version"), "head_created": first("created")})


def supersede_candidates(records: DataFrame) -> DataFrame:
    """Records of a strictly older version than the head of their entity, and not written after it."""
    return version_heads(records).where((F.col("version") < F.col("head_version")) & (F.col("created") <= F.col("head_created"))).select("id", "head_id", "entity")


def merge_events(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The event log of merges: groups (survivor_id, id) of one scope, with what each member had at that time."""
    cols = ("from_auto", "from_search", "from_drill", "last_surfaced")
    member = records.select("id", *cols, *SCOPE)
    survivor = records.select(F.col("id").alias("survivor_id"), *(F.col(c).alias(f"of_{c}") for c in SCOPE))
    j = groups.where("id <> survivor_id").join(member, "id").join(survivor, "survivor_id")
    same = F.lit(True)
    for c in SCOPE:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return j.where(same).select("survivor_id", "id", *cols)


def merged(records: DataFrame, events: DataFrame) -> DataFrame:
    """records after merges: survivors take their members' counters and latest surfacing, members are archived."""
    gain = events.groupBy(F.col("survivor_id").alias("id")).agg(*(F.sum(c).alias(f"g_{c}") for c in ("from_auto", "from_search", "from_drill")), F.max("last_surfaced").alias("g_last"))
    gone = events.select("id").distinct().withColumn("gone", F.lit(True))
    j = records.join(gain, "id", "left").join(gone, "id", "left")
    for c in ("from_auto", "from_search", "from_drill"):
        j = j.withColumn(c, F.col(c) + F.coalesce(f"g_{c}", F.lit(0)))
    j = j.withColumn("last_surfaced", F.greatest("last_surfaced", "g_last")).withColumn("archived", F.col("archived") | F.coalesce("gone", F.lit(False)))
    return j.select(*records.columns)


def unmerged(records: DataFrame, events: DataFrame, before: DataFrame) -> DataFrame:
    """records with the merges of the events taken back; `before` gives survivors' last surfacing from then (id, last_surfaced)."""
    gain = events.groupBy(F.col("survivor_id").alias("id")).agg(*(F.sum(c).alias(f"g_{c}") for c in ("from_auto", "from_search", "from_drill")))
    back = events.select("id").distinct().withColumn("back", F.lit(True))
    j = records.join(gain, "id", "left").join(back, "id", "left").join(before.select("id", F.col("last_surfaced").alias("was")), "id", "left")
    for c in ("from_auto", "from_search", "from_drill"):
        j = j.withColumn(c, F.col(c) - F.coalesce(f"g_{c}", F.lit(0)))
    j = j.withColumn("last_surfaced", F.when(F.col("g_from_auto").isNotNull(), F.col("was")).otherwise(F.col("last_surfaced")))
    return j.withColumn("archived", F.col("archived") & ~F.coalesce("back", F.lit(False))).select(*records.columns)


def same_session(records: DataFrame) -> DataFrame:
    """Live surfaced records of sessions that have more than one."""
    total = F.col("from_auto") + F.col("from_search") + F.col("from_drill")
    live = records.where(~F.col("archived") & (total > 0))
    several = live.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1")
    return live.join(several, "session_id", "left_semi")


#: fixed values: the types that a record may have; others are coerced to the last
TYPES = ("bugfix", "feature", "refactor", "discovery", "decision", "change")


def coerced(records: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """records with a type that is one of the types: null and unknown ones become the last."""
    return records.withColumn("type", F.when(F.col("type").isin(*types), F.col("type")).otherwise(types[-1]))


def restored(records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """records (of the ids, if given) with `was`, the state before, afloat again if they had sunk; others keep their state."""
    rows = records if ids is None else records.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.withColumn("was", F.col("tide_state")).withColumn("tide_state", F.when(F.col("tide_state").isin("dormant", "archived"), "active").otherwise(F.col("tide_state")))


def survivors(events: DataFrame) -> DataFrame:
    """(survivor_id, members) of merge events (survivor_id, id): who holds what was merged, told once however often the log has it."""
    return events.groupBy("survivor_id").agg(F.count_distinct("id").alias("members"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key. Written to a new path or by foreachBatch."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (source_path, sha) that aren't known with this sha."""
    return files.join(known.select("source_path", "sha"), ["source_path", "sha"], "left_anti")
