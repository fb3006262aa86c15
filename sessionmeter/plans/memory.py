"""Memory and skill files of many users, from their homes as they lie on disk.

One walk over the homes finds the files and the facts of all session logs. Of the logs only the three newest of a
project are opened, newest first, and only up to the line that names the project's directory. The two files in
such a directory are asked for by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionmeter.operators import inventory
from sessionmeter.operators.inventory import NEWEST_LOGS
from sessionmeter.sources.files import Layout, existing, find_files, first_texts, with_text

# Places below a home. Hidden parts below a skill root are left out.
_SKILLS = r"\.(?:claude|codex|qwen)/skills"
_FILES = [
    r"\.claude/CLAUDE\.md", r"\.claude/projects/[^/]+/memory/[^/]+\.md", r"\.claude/projects/[^/]+/[^/]+\.jsonl",
    r"\.codex/AGENTS\.md", r"\.codex/rules/default\.rules", r"\.qwen/settings\.json", r"\.qwen/output-language\.md",
    _SKILLS + r"/[^./][^/]*(?:/[^./][^/]*)+",
]
_FOLDERS = [
    r"\.claude", r"\.claude/projects", r"\.claude/projects/[^/]+", r"\.claude/projects/[^/]+/memory", r"\.codex", r"\.codex/rules",
    r"\.qwen", _SKILLS + r"(?:/[^./][^/]*)*",
]
HOMES = Layout(files=f"[^/]+/(?:{'|'.join(_FILES)})", folders=f"[^/]+|[^/]+/(?:{'|'.join(_FOLDERS)})")
_LOG = r"^\.claude/projects/([^/]+)/[^/]+\.jsonl$"


def home_tree(spark: SparkSession, homes: str) -> DataFrame:
    """home, path (below the home), uri, size, mtime of all files that count below `<homes>/<user>/`."""
    return find_files(spark, homes, HOMES).select(
        F.substring_index("rel", "/", 1).alias("home"), F.regexp_replace("rel", "^[^/]+/", "").alias("path"),
        F.col("path").alias("uri"), "size", "mtime",
    )


def opened_cwds(tree: DataFrame) -> DataFrame:
    """home, encoded, cwd (NULL where none is named), opened, of every project with a log."""
    logs = tree.where(F.col("path").rlike(_LOG)).withColumn("encoded", F.regexp_extract("path", _LOG, 1))
    newest = Window.partitionBy("home", "encoded").orderBy(F.desc("mtime"), "path")
    # Spark keeps three rows of a project in each task before they are shuffled
    ranked = logs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= NEWEST_LOGS)
    return first_texts(ranked.select("home", "encoded", "rank", F.col("uri").alias("path")), ["home", "encoded"], "cwd")


def _in_projects(cwds: DataFrame, homes: str, origin: str) -> DataFrame:
    """The files of project directories by the names they must have; a cwd outside its home names no file of the tree."""
    base = F.concat(F.lit(origin.rstrip("/") + "/"), "home")
    inside = cwds.where(F.startswith(F.concat(F.regexp_replace("cwd", "/+$", ""), F.lit("/")), F.concat(base, F.lit("/"))))
    below = F.ltrim(F.substr(F.regexp_replace("cwd", "/+$", ""), F.length(base) + 1), F.lit("/"))
    asked = inside.select("home", below.alias("dir")).distinct().select(
        "home", F.explode(F.array(F.lit("CLAUDE.md"), F.lit(".claude/CLAUDE.md"))).alias("name"), "dir"
    ).select("home", F.ltrim(F.concat("dir", F.lit("/"), "name"), F.lit("/")).alias("rel"))
    # `path` is a URI
    place = F.replace(F.concat(F.lit(homes.rstrip("/") + "/"), "home", F.lit("/"), "rel"), F.lit("%"), F.lit("%25"))
    found = existing(asked.select("home", "rel", place.alias("path")))
    return found.select("home", F.col("rel").alias("path"), "size", "mtime")


def memory_view(spark: SparkSession, homes: str, origin: str | None = None) -> dict[str, DataFrame]:
    """`global`, `memory`, `projects`, `listing`, `skills`, `skill_files` of the homes below `homes`.

    `origin` is the folder the homes lay in when the logs were written, if they were copied from there.
    """
    origin = homes if origin is None else origin
    tree = home_tree(spark, homes)
    cwds = opened_cwds(tree).where("cwd is not null").drop("opened")
    home_dir = F.concat(F.lit(origin.rstrip("/") + "/"), "home")
    # of all these files only the two that describe a skill are read
    tells = F.col("path").rlike(r"/skills/[^/]+/(SKILL|AGENTS)\.md$")
    files = with_text(tree.where(~F.col("path").rlike(_LOG)), tells).drop("uri")
    # a project file may also be one of the tree: the home directory's own
    files = files.unionByName(_in_projects(cwds, homes, origin), allowMissingColumns=True).dropDuplicates(["home", "path"]).withColumn("home_dir", home_dir)
    everywhere = inventory.global_memory(files)
    memory = inventory.project_memory(files, cwds).unionByName(inventory.shared_memory(files))
    return {
        "global": everywhere,
        "memory": memory,
        "projects": inventory.memory_projects(memory),
        "listing": inventory.memory_listing(everywhere, memory),
        "skills": inventory.skills(files),
        "skill_files": inventory.skill_files(files).drop("text"),
    }
