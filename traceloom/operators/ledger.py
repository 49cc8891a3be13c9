"""The ledger of open items, and workspace tables of all initiatives at once (keyed by slug)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def loops(sessions: DataFrame) -> DataFrame:
    """One row per next step; ``ref`` is <file stem>#<step id>."""
    s = sessions.select("slug", "file", "session_id", "ended", F.inline("next_steps"))
    return s.select("slug", "file", "session_id", "ended", F.concat("file", F.lit("#"), "id").alias("ref"), "id", "text", "kind", F.col("ref").alias("target"))


def resolves(sessions: DataFrame, opened: DataFrame) -> DataFrame:
    """One row per resolve with its problem, if any: self, missing, self, not-prior, in this order."""
    r = sessions.select("slug", F.col("file").alias("by_file"), F.col("session_id").alias("by_session"), F.col("ended").alias("by_ended"), F.inline("resolves"))
    o = opened.select("slug", "ref", "file", "session_id", "ended")
    met = r.join(o, ["slug", "ref"], "left")
    problem = (
        F.when(F.substring_index("ref", "#", 1) == F.col("by_file"), "self")
        .when(F.col("file").isNull(), "missing")
        .when(F.col("session_id") == F.col("by_session"), "self")
        .when(F.col("ended") >= F.col("by_ended"), "not-prior")
    )
    return met.select("slug", "ref", "outcome", "note", "by_file", "by_session", "by_ended", problem.alias("problem"))


def latest_resolution(found: DataFrame) -> DataFrame:
    """The valid resolve that ended last; ties go to the later file."""
    return found.filter("problem is null").groupBy("slug", "ref").agg(F.max(F.struct("by_ended", "by_file", "outcome", "note")).alias("r")).select("slug", "ref", "r.*")


def open_ledger(opened: DataFrame, resolved: DataFrame, now: Column, tasks: DataFrame | None = None, merged: DataFrame | None = None) -> DataFrame:
    """Loops without a resolution, a done task or a merged pull request, oldest first."""
    out = opened.join(resolved.select("slug", "ref"), ["slug", "ref"], "left_anti")
    if tasks is not None:
        done = tasks.filter("status = 'done'").select("slug", F.col("id").alias("target"), F.lit("task").alias("kind"))
        out = out.join(done, ["slug", "target", "kind"], "left_anti")
    if merged is not None:
        out = out.withColumn("number_", X.pr_number(F.col("target"))).join(merged.select(X.pr_number(F.col("ref")).alias("number_"), F.lit("pr").alias("kind")).distinct(), ["number_", "kind"], "left_anti").drop("number_")
    return out.withColumn("age_days", X.age_days(F.col("ended"), now)).orderBy("ended", "ref")


def resolved_ledger(opened: DataFrame, resolved: DataFrame, outcome: str | None = None, since: Column | None = None) -> DataFrame:
    """Resolved loops, newest first; abandoned ones in a window by ``outcome`` and ``since``."""
    out = opened.join(resolved, ["slug", "ref"])
    out = out.filter(F.col("outcome") == outcome) if outcome else out
    out = out.filter(F.col("by_ended") >= since) if since is not None else out
    return out.orderBy(F.desc("by_ended"), "ref")


def dangling_report(found: DataFrame) -> DataFrame:
    """W4."""
    return found.filter("problem is not null").groupBy("slug", "problem").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("ref")).alias("refs"))


def bad_task_refs(open_: DataFrame, tasks: DataFrame) -> DataFrame:
    """Open task loops that name no task."""
    return open_.filter("kind = 'task' and target is not null").join(tasks.select("slug", F.col("id").alias("target")), ["slug", "target"], "left_anti")


def stale_loops(open_: DataFrame, days: int = 30) -> DataFrame:
    """W5."""
    return open_.filter(F.col("age_days") > days)


def empty_ledgers(sessions: DataFrame) -> DataFrame:
    """Canonical sessions that open and resolve nothing and do not say so."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return sessions.filter((n("next_steps") <= 0) & (n("resolves") <= 0) & ~F.coalesce("no_loops", F.lit(False)) & (F.col("track") == "canonical"))


def long_texts(rows: DataFrame, text: str, most: int) -> DataFrame:
    """Rows whose text has more than ``most`` lines."""
    return rows.withColumn("lines", X.body_lines(F.col(text))).filter(F.col("lines") > most)


def source_drift(briefs: DataFrame, files: DataFrame) -> DataFrame:
    """Sources referenced but absent, and present but not referenced, where a brief references any."""
    named = briefs.select("slug", F.explode(X.source_links(F.col("body"))).alias("name")).distinct()
    present = files.join(named.select("slug").distinct(), "slug", "left_semi").select("slug", "name").distinct()
    return named.join(present, ["slug", "name"], "left_anti").withColumn("drift", F.lit("absent")).union(present.join(named, ["slug", "name"], "left_anti").withColumn("drift", F.lit("unreferenced")))


def hash_drift(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose content no longer has the manifest's digest; missing files are ignored."""
    return manifest.join(files.select("path", F.sha2("content", 256).alias("now")), "path").filter("now <> sha256")


def stale_done(tasks: DataFrame, now: Column, days: int) -> DataFrame:
    """Done tasks whose completion is at least ``days`` ago."""
    return tasks.filter((F.col("status") == "done") & (F.col("done_at") <= F.date_sub(now.cast("date"), days)))


def recently_done(tasks: DataFrame, now: Column, days: int = 14) -> DataFrame:
    return tasks.filter((F.col("status") == "done") & (F.col("done_at") > F.date_sub(now.cast("date"), days))).groupBy("slug").agg(F.count("*").alias("recently_done"))


def top_tasks(tasks: DataFrame, n: int = 5) -> DataFrame:
    """each initiative's first open tasks by priority, with how many there are."""
    w = Window.partitionBy("slug")
    t = tasks.filter("status <> 'done'").withColumn("rank", F.row_number().over(w.orderBy("priority", "id"))).withColumn("open_tasks", F.count("*").over(w))
    return t.filter(F.col("rank") <= n)


def narrative(sessions: DataFrame) -> DataFrame:
    """The newest canonical session of each initiative, else its newest."""
    w = Window.partitionBy("slug").orderBy(F.desc(F.col("track") == "canonical"), F.desc("ended"), F.desc("started"), F.desc("file"))
    return sessions.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def parallel_sessions(sessions: DataFrame) -> DataFrame:
    """Other sessions that ended after the narrative one."""
    main = narrative(sessions).select("slug", F.col("ended").alias("main_ended"), F.col("file").alias("main_file"))
    return sessions.join(main, "slug").filter("track <> 'canonical' and ended > main_ended and file <> main_file").select(*sessions.columns)


def newest_notes(notes: DataFrame, n: int = 12) -> DataFrame:
    """with the number that did not fit."""
    w = Window.partitionBy("slug")
    return notes.withColumn("rank", F.row_number().over(w.orderBy(F.desc("created"), "title"))).withColumn("overflow", F.greatest(F.count("*").over(w) - n, F.lit(0))).filter(F.col("rank") <= n)


def resume(sessions: DataFrame, open_: DataFrame, tasks: DataFrame, notes: DataFrame, now: Column) -> DataFrame:
    """One row per initiative with its narrative session, and lists of open loops, tasks, notes and parallel sessions (top lists are short)."""
    gather = lambda df, name, *cols: df.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = narrative(sessions).select("slug", "file", "session_id", "ended", X.elapsed_text(F.col("ended"), now).alias("since"))
    for part in (gather(open_, "open_loops", "ended", "ref", "text"), gather(top_tasks(tasks), "tasks", "rank", "id", "title", "open_tasks"), gather(newest_notes(notes), "notes", "rank", "title", "overflow"), gather(parallel_sessions(sessions), "parallel", "ended", "session_id"), recently_done(tasks, now)):
        out = out.join(part, "slug", "left")
    return out


def session_problems(sessions: DataFrame) -> DataFrame:
    """Reasons why a session document is malformed; an empty list is valid."""
    ids = F.transform(F.coalesce("next_steps", F.array().cast(sessions.schema["next_steps"].dataType)), lambda s: s["id"])
    rules = [
        (F.col("session_id").isNull(), "no session_id"),
        (F.col("ended") < F.col("started"), "ended before started"),
        (F.size(ids) != F.size(F.array_distinct(ids)), "step ids repeat"),
        (F.exists(F.coalesce("resolves", F.array().cast(sessions.schema["resolves"].dataType)), lambda r: (r["outcome"] == "abandoned") & r["note"].isNull()), "abandoned without a note"),
    ]
    return sessions.withColumn("problems", F.filter(F.array(*[F.when(c, m) for c, m in rules]), lambda x: x.isNotNull()))


def brief_problems(briefs: DataFrame) -> DataFrame:
    rules = [((F.col("state") == "focused") & F.col("rank").isNull(), "focused without a rank"), ((F.col("state") == "paused") & (F.col("paused_since").isNull() | F.col("restart_trigger").isNull()), "paused without date or trigger"), (~X.is_date(F.col("updated").cast("string")), "no date")]
    return briefs.withColumn("problems", F.filter(F.array(*[F.when(c, m) for c, m in rules]), lambda x: x.isNotNull()))


def artifacts(docs: DataFrame) -> DataFrame:
    """Branches, stashes and worktrees as rows."""
    parts = [docs.select("slug", F.lit(kind).alias("kind"), F.explode(col).alias("a")).select("slug", "kind", F.col(f"a.{repo}").alias("repo"), F.col(f"a.{name}").alias("name"), "a.note") for kind, col, repo, name in (("branch", "branches", "repo", "name"), ("stash", "stashes", "repo", "label"), ("worktree", "worktrees", "repo", "path")) if col in docs.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def worktree_conflicts(rows: DataFrame) -> DataFrame:
    """Paths claimed by more than one initiative."""
    return rows.filter("kind = 'worktree'").groupBy(F.col("name").alias("path")).agg(F.array_sort(F.collect_set("slug")).alias("slugs")).filter("size(slugs) > 1")


def check_rollup(checks: DataFrame, key: str) -> DataFrame:
    """Failures dominate, then pending ones; with n of total."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    c = checks.groupBy(key).agg(n("fail").alias("fail"), n("pending").alias("pending"), F.count("*").alias("total"))
    say = lambda word, k: F.concat(F.lit(f"{word} "), k.cast("string"), F.lit("/"), F.col("total").cast("string"))
    return c.withColumn("summary", F.when(F.col("fail") > 0, say("fail", F.col("fail"))).when(F.col("pending") > 0, say("pending", F.col("pending"))).otherwise(say("pass", F.col("total"))))


def audit_order(rows: DataFrame, states: list[str]) -> DataFrame:
    """rank first (missing ones last), then the order of states, then slug."""
    return rows.orderBy(F.col("rank").asc_nulls_last(), F.array_position(F.array(*[F.lit(s) for s in states]), F.col("state")), "slug")


def sections(initiatives: DataFrame) -> DataFrame:
    """initiatives by section, with their place in it: focused by rank (missing ones last), paused by the time since
    when (missing ones first), done by the latest update, ties and the rest by slug.  Other states have no section."""
    states = [("focused", "Focused"), ("backburner", "Backburner"), ("paused", "Paused"), ("done", "Done")]
    heading = F.coalesce(*[F.when(F.col("state") == s, h) for s, h in states])
    number = F.array_position(F.array(*[F.lit(s) for s, _ in states]), F.col("state")).cast("int")
    own = lambda state, c: F.when(F.col("state") == state, F.col(c))
    w = Window.partitionBy("state").orderBy(own("focused", "rank").asc_nulls_last(), F.coalesce(own("paused", "paused_since"), F.lit("")), own("done", "updated").desc_nulls_last(), "slug")
    return initiatives.filter(heading.isNotNull()).select(heading.alias("heading"), number.alias("section"), F.row_number().over(w).alias("place"), "slug", "state", "rank", "paused_since", "updated")


def recent_sessions(listed: DataFrame, lines: DataFrame, n: int = 50) -> DataFrame:
    """the ``n`` transcripts changed last (``sources.discover``), with the first prompt in each; only these are looked at."""
    top = listed.filter("subagent_id is null").orderBy(F.desc("mtime"), "display_path").limit(n).select("path", "display_path", "mtime", "length")
    said = lines.join(F.broadcast(top.select("path")), "path").filter("event_type = 'user_prompt'").groupBy("path").agg(F.min_by("content_text", "offset").alias("first_prompt"), F.min("session_id").alias("session_id"))
    return top.join(said, "path", "left").select("display_path", "session_id", "mtime", "length", F.left("first_prompt", F.lit(240)).alias("first_prompt"))


def session_list(sessions: DataFrame, n: int = 100) -> DataFrame:
    """the latest sessions with their first line that is not blank."""
    first = F.try_element_at(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != ""), F.lit(1))
    return sessions.orderBy(F.desc("ended"), "file").limit(n).select("slug", "file", "session_id", "ended", F.left(F.trim(first), F.lit(120)).alias("summary"))


def discovery(tables: list[DataFrame], slugs: DataFrame, triaged: DataFrame) -> DataFrame:
    """Hits of several sources (source, ref, cwd), without those triaged, each with its initiative."""
    from .joins import match_slugs

    hits = tables[0]
    for t in tables[1:]:
        hits = hits.unionByName(t)
    hits = hits.join(triaged.select("ref").distinct(), "ref", "left_anti")
    return match_slugs(hits, slugs, "ref", ["ref", "cwd"]).withColumn("tracked", F.col("slug").isNotNull())


def sessions_per_cwd(lines: DataFrame) -> DataFrame:
    """Sessions in each folder, the latest one and its subject."""
    per = lines.groupBy("cwd", "session_id").agg(F.max("mtime").alias("mtime"), F.min_by("subject", F.when(F.col("subject").isNotNull(), F.col("offset"))).alias("subject"))
    return per.groupBy("cwd").agg(F.count("*").alias("sessions"), F.max("mtime").alias("latest"), F.max_by("session_id", F.struct("mtime", "session_id")).alias("latest_session"), F.coalesce(F.max_by("subject", F.struct("mtime", "session_id")), F.max("subject")).alias("subject"))


def session_summary(messages: DataFrame) -> DataFrame:
    """The latest continuation message of a session, else its first user text."""
    last = F.max_by("text", F.when(F.col("is_continuation"), F.col("offset")))
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("offset")))
    return messages.groupBy("session_id").agg(F.left(F.coalesce(F.when(F.max(F.col("is_continuation").cast("int")) == 1, last), first), F.lit(150)).alias("summary"))


def recency(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """W22."""
    age = F.round((F.unix_micros(now) - F.unix_micros(F.col("mtime"))) / 86_400_000_000).cast("int")
    return rows.withColumn("age_days", age).withColumn("recency", F.when(F.col("age_days") <= days, "recent").otherwise("older"))


def source_listing(files: DataFrame, kind: str | None = None) -> DataFrame:
    """Type and title (first heading, else file stem) of each source."""
    name = F.substring_index("path", "/", -1)
    out = files.select("slug", "path", X.source_type(name).alias("type"), F.coalesce(X.first_heading(F.col("body")), F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"))
    return out.filter(F.col("type") == kind) if kind else out
