"""Memory and skill files, labels and manifests over the given documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions import text as X
from sessionmeter.functions import times
from sessionmeter.operators import inventory
from sessionmeter.plans.manifest import changed_files, gone_files
from sessionmeter.registry import tables as T

def _doc():
    return F.col("doc_id")


def _documents(spark, sf) -> DataFrame:
    return T.table(spark, sf, "documents")


def _home():
    return F.concat(F.lit("h"), F.floor(_doc() / 100).cast("string"))


def _name(prefix: str, column=None, suffix: str = ""):
    column = _doc() if column is None else column
    return F.concat(F.lit(prefix), column.cast("string"), F.lit(suffix))


def files(spark, sf) -> DataFrame:
    """Every document as a file in some user's home."""
    doc, source = _doc(), F.col("source")
    skill = F.floor(doc / 20)
    front = F.concat(F.lit('---\nname: x\n Description: "about '), doc.cast("string"), F.lit('" \n---\n'), F.col("text"))
    place = (
        F.when(doc % 10 == 0, F.concat(F.lit(".claude/projects/-w-"), source, F.lit("/memory/"), _name("d", suffix=".md")))
        .when(doc % 20 == 1, _name(".claude/skills/s", skill, "/SKILL.md"))
        .when(doc % 20 == 11, _name(".claude/skills/s", skill, "/AGENTS.md"))
        .when(doc % 20 == 12, _name(".codex/skills/k", skill, "/AGENTS.md"))
        .when(doc % 20 == 2, F.concat(_name(".qwen/skills/q", skill, "/docs/"), _name("d", suffix=".txt")))
        .when(doc % 100 == 3, ".claude/CLAUDE.md")
        .when(doc % 100 == 13, ".codex/AGENTS.md")
        .when(doc % 100 == 23, ".codex/rules/default.rules")
        .when(doc % 100 == 33, ".qwen/settings.json")
        .when(doc % 100 == 43, ".qwen/output-language.md")
        .when(doc % 10 == 4, F.concat(_name("w/d"), F.lit("/CLAUDE.md")))
        .when(doc % 10 == 5, F.concat(_name("w/d", doc - 1), F.lit("/.claude/CLAUDE.md")))
        .otherwise(_name("notes/d", suffix=".txt"))
    )
    return _documents(spark, sf).select(
        _home().alias("home"),
        place.alias("path"),
        F.concat(F.lit("/home/"), _home()).alias("home_dir"),
        F.col("n_chars").alias("size"),
        (doc * 7 % 1000).alias("mtime"),
        F.when(doc % 40 != 12, front).otherwise(F.col("text")).alias("text"),
    )


def logs(spark, sf) -> DataFrame:
    """Each document as a readable line of a project log: three lines per log."""
    doc, source = _doc(), F.col("source")
    own = doc % 10 == 4
    encoded = F.when(own, F.concat(F.lit("-home-"), _home(), _name("-w-d"))).otherwise(F.concat(F.lit("-w-"), source))
    cwd = F.when(own, F.concat(F.lit("/home/"), _home(), _name("/w/d"))).when(
        doc % 3 != 0, F.concat(F.lit("/w/"), source, F.lit("/v"), (doc % 4).cast("string"))
    )
    return _documents(spark, sf).select(
        _home().alias("home"),
        encoded.alias("encoded"),
        _name("log", F.floor(doc / 3)).alias("log"),
        (F.floor(doc / 3) * 11 % 500).alias("log_mtime"),
        doc.alias("ord"),
        cwd.alias("cwd"),
    )


def project_cwds(spark, sf):
    return inventory.project_cwds(logs(spark, sf))


def _memory(spark, sf) -> DataFrame:
    kept = files(spark, sf)
    own = inventory.project_memory(kept, project_cwds(spark, sf))
    return own.unionByName(inventory.shared_memory(kept))


def memory_files(spark, sf):
    return _memory(spark, sf).select("home", "agent", "encoded", "name", "category", "path", "size", "mtime")


def memory_projects(spark, sf):
    return inventory.memory_projects(_memory(spark, sf))


def memory_listing(spark, sf):
    return inventory.memory_listing(inventory.global_memory(files(spark, sf)), _memory(spark, sf))


def skills(spark, sf):
    return inventory.skills(files(spark, sf))


def skill_files(spark, sf):
    return inventory.skill_files(files(spark, sf)).drop("text")


def manifest_changes(spark, sf):
    """Two states of the documents: some grew, some are new, some were read by an older version."""
    doc = _doc()
    docs = _documents(spark, sf)
    path = _name("d")
    known = docs.where(doc % 5 != 0).select(
        path.alias("path"),
        (F.col("n_chars") + F.when(doc % 7 == 0, 1).otherwise(0)).alias("file_size"),
        F.when(doc % 11 == 0, 0).otherwise(1).alias("version"),
    )
    listed = docs.where(doc % 13 != 0).select(path.alias("path"), F.col("n_chars").alias("file_size"))
    return changed_files(listed, known, version=1)


def manifest_gone(spark, sf):
    doc = _doc()
    docs = _documents(spark, sf)
    known = docs.where(doc % 5 != 0).select(_name("d").alias("path"))
    listed = docs.where(doc % 13 != 0).select(_name("d").alias("path"))
    return gone_files(listed, known)


def time_labels(spark, sf):
    seconds = times.epoch_seconds(F.col("ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    age = F.lit(T.NOW) - seconds
    return T.table(spark, sf, "events").select(
        "event_id",
        times.minute_label(seconds).alias("minute"),
        times.clock_part(F.concat(iso, F.lit(".554Z"))).alias("clock"),
        times.clock_part(F.lit("later")).alias("no_clock"),
        times.duration_label(F.floor(age / (F.col("event_id") % 997 + 1))).alias("age"),
        times.real_iso(seconds.cast("double") + 0.25).alias("iso"),
        X.thousands(seconds).alias("grouped"),
    )


def path_labels(spark, sf):
    path = F.regexp_extract("url", "^https?:/(/.*)$", 1)
    return T.table(spark, sf, "pages").select(
        "page_id",
        X.short_path(path).alias("short"),
        X.short_path(F.substr(path, F.lit(2))).alias("short_relative"),
        X.encoded_dir(path).alias("encoded"),
        X.cut(F.col("url"), 20).alias("cut"),
    )


QUERIES = {
    "project_cwds": project_cwds,
    "memory_files": memory_files,
    "memory_projects": memory_projects,
    "memory_listing": memory_listing,
    "skills": skills,
    "skill_files": skill_files,
    "manifest_changes": manifest_changes,
    "manifest_gone": manifest_gone,
    "time_labels": time_labels,
    "path_labels": path_labels,
}
