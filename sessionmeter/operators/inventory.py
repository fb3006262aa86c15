"""Memory and skill files.

Input `files`: home, path (relative to that home, as written on disk), size, mtime, text. Every home
is one user's copied tree; `text` is needed only for the two files that describe a skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmeter.functions.text import trim_ws

NEWEST_LOGS = 3


def global_memory(files: DataFrame) -> DataFrame:
    return files.where(F.col("path") == ".claude/CLAUDE.md").select(
        "home", F.lit("global").alias("category"), "path", "size", "mtime"
    )


def project_cwds(logs: DataFrame) -> DataFrame:
    """(home, encoded, cwd) per project: the first cwd in its three newest logs, newest log first.

    `logs`: home, encoded, log, log_mtime, ord, cwd, one row per readable line. Logs are reduced to
    their first cwd before they are ranked, so no window holds lines.
    """
    per_log = logs.groupBy("home", "encoded", "log").agg(
        F.max("log_mtime").alias("log_mtime"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("ord"))).alias("cwd"),
    )
    newest = Window.partitionBy("home", "encoded").orderBy(F.desc("log_mtime"), "log")
    ranked = per_log.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= NEWEST_LOGS)
    return (
        ranked.groupBy("home", "encoded")
        .agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("_rank"))).alias("cwd"))
        .where(F.col("cwd").isNotNull())
    )


def project_memory(files: DataFrame, cwds: DataFrame, home_dir: str = "home_dir") -> DataFrame:
    """Memory files of each project with a known cwd.

    A file is looked up by its exact place, so this is an equality join on (home, path). A local
    file that is the global file itself is left out; links do not exist in object stores, so "is" means the
    same normalised path.
    """
    # Places relative to the project directory.
    places = {"CLAUDE.md": "CLAUDE.md", ".claude/CLAUDE.md": ".claude/CLAUDE.md"}
    wanted = cwds.select(
        "home", "encoded", "cwd",
        F.explode(F.create_map(*[F.lit(x) for pair in places.items() for x in pair])).alias("category", "place"),
    ).withColumn("path", F.concat_ws("/", F.regexp_replace("cwd", "/+$", ""), "place"))
    in_project = (
        wanted.join(_absolute(files, home_dir), ["home", "path"])
        .where((F.col("category") != ".claude/CLAUDE.md") | (F.col("rel_path") != ".claude/CLAUDE.md"))
        .select("home", "encoded", "cwd", "category", F.col("path"), "size", "mtime")
    )
    noted = (
        files.where(F.col("path").rlike(r"^\.claude/projects/[^/]+/memory/[^/]+\.md$"))
        .withColumn("encoded", F.regexp_extract("path", r"^\.claude/projects/([^/]+)/", 1))
        .join(cwds, ["home", "encoded"])
        .select("home", "encoded", "cwd", F.lit("auto-memory").alias("category"), "path", "size", "mtime")
    )
    return in_project.unionByName(noted).withColumn("agent", F.lit("claude")).withColumn(
        "name", F.when(F.col("cwd") == "/", F.col("cwd")).otherwise(F.regexp_extract("cwd", r"([^/]+)/*$", 1))
    )


def _absolute(files: DataFrame, home_dir: str) -> DataFrame:
    return files.select(
        "home", F.col("path").alias("rel_path"),
        F.concat_ws("/", F.col(home_dir), F.col("path")).alias("path"), "size", "mtime",
    )


def shared_memory(files: DataFrame) -> DataFrame:
    """Files that hold for all projects of the other two agents."""
    # Path, category, agent.
    places = [
        (".codex/AGENTS.md", "AGENTS.md", "codex"),
        (".codex/rules/default.rules", "default.rules", "codex"),
        (".qwen/settings.json", "settings.json", "qwen"),
        (".qwen/output-language.md", "output-language.md", "qwen"),
    ]
    path = F.col("path")
    category, agent = F.lit(None).cast("string"), F.lit(None).cast("string")
    for place, label, owner in places:
        category = F.when(path == place, label).otherwise(category)
        agent = F.when(path == place, owner).otherwise(agent)
    return (
        files.where(path.isin([p for p, _, _ in places]))
        .withColumn("category", category)
        .withColumn("agent", agent)
        .select(
            "home",
            F.concat(F.lit("_"), "agent", F.lit("_global")).alias("encoded"),
            F.concat(F.lit("."), "agent").alias("cwd"),
            "category", "path", "size", "mtime", "agent",
            F.concat("agent", F.lit(" (global)")).alias("name"),
        )
    )


def memory_projects(memory: DataFrame) -> DataFrame:
    """One row per project, latest change first."""
    return (
        memory.groupBy("home", "agent", "encoded")
        .agg(
            F.min("name").alias("name"),
            F.min("cwd").alias("cwd"),
            F.count(F.lit(1)).alias("n_files"),
            F.max("mtime").alias("latest_mtime"),
        )
        .orderBy(F.desc("latest_mtime"), "encoded", "home")
    )


def memory_listing(global_files: DataFrame, memory: DataFrame) -> DataFrame:
    """Flat list: the global file first, then project by project, files in category order."""
    latest = memory.groupBy("home", "encoded").agg(F.max("mtime").alias("latest_mtime"))
    # Order of the categories inside a project.
    order = ["CLAUDE.md", ".claude/CLAUDE.md", "auto-memory", "AGENTS.md", "default.rules", "settings.json"]
    rank = F.lit(len(order))
    for i, name in enumerate(order):
        rank = F.when(F.col("category") == name, i).otherwise(rank)
    first = global_files.select(
        "home", F.lit("~/.claude/CLAUDE.md (global)").alias("label"), F.lit("claude").alias("agent"), "path",
        F.lit(0).alias("_part"), F.lit(0).cast("bigint").alias("latest_mtime"),
        F.lit("").alias("encoded"), F.lit(0).alias("_rank"),
    )
    rest = memory.join(latest, ["home", "encoded"]).select(
        "home",
        F.concat(F.lit("["), "agent", F.lit("] "), "name", F.lit(" · "), "category").alias("label"),
        "agent", "path", F.lit(1).alias("_part"), "latest_mtime", "encoded", rank.alias("_rank"),
    )
    return (
        first.unionByName(rest)
        .orderBy("home", "_part", F.desc("latest_mtime"), "encoded", "_rank", "path")
        .select("home", "label", "agent", "path")
    )


def description(text: Column) -> Column:
    """The `description:` of a front matter block, or empty."""
    front = F.regexp_extract(text, r"(?s)\A---(.*?)\n---", 1)
    line = F.regexp_extract(front, r"(?im)^\s*description:(.*)$", 1)
    return F.regexp_replace(F.regexp_replace(trim_ws(line), '^"+|"+$', ""), "^'+|'+$", "")


def skill_files(files: DataFrame) -> DataFrame:
    """Files below the three skill roots."""
    pattern = r"^\.(claude|codex|qwen)/skills/([^/]+)/(.+)$"
    path = F.col("path")
    return files.where(path.rlike(pattern)).select(
        "home",
        F.regexp_extract(path, pattern, 1).alias("agent"),
        F.regexp_extract(path, pattern, 2).alias("name"),
        F.regexp_extract(path, pattern, 3).alias("rel_path"),
        "size", "text",
    )


def skills(files: DataFrame) -> DataFrame:
    """One row per skill directory: its description, number of files and total size.

    The description comes from SKILL.md, or from AGENTS.md where there is none. The files themselves are
    the rows of `skill_files`, ordered by path.
    """
    rel = F.col("rel_path")
    told = description(F.coalesce("text", F.lit("")))
    return (
        skill_files(files)
        .groupBy("home", "agent", "name")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("size").alias("total_size"),
            F.coalesce(
                F.max(F.when(rel == "SKILL.md", told)), F.max(F.when(rel == "AGENTS.md", told)), F.lit("")
            ).alias("description"),
        )
        .orderBy("agent", "name", "home")
    )
