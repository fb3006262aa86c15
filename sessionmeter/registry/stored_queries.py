"""The given conversations written as real logs, and read back through folders, listings and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.plans.memory import memory_view
from sessionmeter.plans.store import Store
from sessionmeter.registry import logs
from sessionmeter.registry import tables as T
from sessionmeter.session import work_path
from sessionmeter.sources.files import write_lines

SOURCES = {"claude": logs.claude, "codex": logs.codex, "qwen": logs.qwen}


def _written_logs(spark: SparkSession, sf: str) -> dict[str, str]:
    """The root of each agent's logs."""
    root = work_path(spark, "logs")
    for agent, lines in SOURCES.items():
        rel = F.concat(F.lit(f"{agent}/"), F.regexp_replace("path", "^/logs/", ""))
        write_lines(lines(spark, sf).select(rel.alias("rel"), "ord", "value"), root).write.format("noop").mode("overwrite").save()
    return {agent: f"{root}/{agent}" for agent in SOURCES}


def _store(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, work_path(spark, "store"))
    roots = _written_logs(spark, sf)
    store.refresh(roots, logs.hermes(spark, sf))
    store.refresh(roots, logs.hermes(spark, sf))  # nothing has changed, so nothing is read again
    return store


def stored_sessions(spark, sf):
    """All agents' sessions from files; times of files differ from run to run."""
    return _store(spark, sf).read("sessions").select("agent", "session_id", "cwd", "model", "prompt", "turns", "is_scripted")


def stored_usage(spark, sf):
    """Events and bodies per session, from files."""
    store = _store(spark, sf)
    spent = store.read("token_events").groupBy("agent", "session_id").agg(
        F.count_if("is_user_turn").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    said = store.read("transcript_events").groupBy("agent", "session_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_index").alias("last_index"))
    return spent.join(said, ["agent", "session_id"])


def home_projects(spark, sf):
    """A home per source: each document a memory file of the project that a tenth of them share, which one log names."""
    homes = work_path(spark, "homes")
    doc, home = F.col("doc_id"), F.coalesce("source", F.lit("none"))
    encoded = F.concat(F.lit("-w-"), (doc % 10).cast("string"))
    cwd = F.concat(F.lit(f"{homes}/"), home, F.lit("/w"), (doc % 10).cast("string"))
    documents = T.table(spark, sf, "documents")
    project = F.concat(home, F.lit("/.claude/projects/"), encoded)
    notes = documents.select(
        F.concat(project, F.lit("/memory/d"), doc.cast("string"), F.lit(".md")).alias("rel"), F.lit(0).alias("ord"), F.lit("note").alias("value")
    )
    # the projects 0 to 4 have a log; those of 0 and 1 also have a file in their directory
    named = documents.where(doc % 10 < 5).select(home.alias("home"), encoded.alias("encoded"), cwd.alias("cwd"), (doc % 10).alias("k")).distinct()
    log = named.select(
        F.concat("home", F.lit("/.claude/projects/"), "encoded", F.lit("/s.jsonl")).alias("rel"), F.lit(0).alias("ord"),
        F.to_json(F.struct("cwd")).alias("value"),
    )
    own = named.where("k < 2").select(
        F.concat("home", F.lit("/w"), F.col("k").cast("string"), F.lit("/CLAUDE.md")).alias("rel"), F.lit(0).alias("ord"), F.lit("own").alias("value")
    )
    write_lines(notes.unionByName(log).unionByName(own), homes).write.format("noop").mode("overwrite").save()
    return memory_view(spark, homes)["projects"].select("home", "agent", "encoded", "name", "n_files")


QUERIES = {"stored_sessions": stored_sessions, "stored_usage": stored_usage, "home_projects": home_projects}
