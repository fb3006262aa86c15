"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
# Fixed value: the record separator that marks a tool result carrying an exit code.
EXIT_MARK = "\u001e"


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def trim_ws(text: Column) -> Column:
    """Strip white space of every kind at both ends (plain trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return trim_ws(text) == ""


def cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, max(n - 1, 0)), F.lit(ELLIPSIS))
    )


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def short_path(path: Column) -> Column:
    """First letter of each directory, last part whole: /w/alice/app becomes /w/a/app."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    heads = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.substring(p, 1, 1))
    lead = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.size(parts) == 0, path).otherwise(
        F.concat(lead, F.array_join(F.concat(heads, F.slice(parts, -1, 1)), "/"))
    )


def encoded_dir(cwd: Column) -> Column:
    """Name of the log folder that belongs to a working directory."""
    return F.translate(cwd, "/", "-")


def strip_ansi(text: Column) -> Column:
    # fixed value: the pattern of terminal colour codes
    return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")


def fold_command_tags(text: Column) -> Column:
    """Fold slash-command wrappers to one line; NULL for a message that is only a caveat."""
    # Fixed patterns: the wrapper tags written by the agent.
    caveat = r"(?sU)^\s*<local-command-caveat>.*?</local-command-caveat>\s*\z"
    stdout = r"(?sU)^\s*<local-command-stdout>(.*?)</local-command-stdout>\s*\z"
    name = r"<command-name>([^<]+)</command-name>"
    args = r"(?s)<command-args>(.*?)</command-args>"
    block = r"(?s)<command-[a-z]+>.*?</command-[a-z]+>"
    printed = F.concat(F.lit("[stdout] "), strip_ansi(trim_ws(F.regexp_extract(text, stdout, 1))))
    command = F.concat_ws(
        " ",
        trim_ws(F.regexp_extract(text, name, 1)),
        F.nullif(trim_ws(F.regexp_extract(text, args, 1)), F.lit("")),
    )
    only_tags = text.rlike(name) & is_blank(F.regexp_replace(text, block, ""))
    # the cheap prefix test keeps the patterns off ordinary messages
    folded = (
        F.when(text.rlike(caveat), F.lit(None).cast("string"))
        .when(text.rlike(stdout), printed)
        .when(only_tags, command)
        .otherwise(text)
    )
    return F.when(text.contains("<local-command-") | text.contains("<command-name>"), folded).otherwise(text)


def exit_code(body: Column) -> Column:
    """Exit code of a marked tool result, else NULL."""
    return F.regexp_extract(body, f"^{EXIT_MARK}exit=([+-]?\\d+)(\n|\\z)", 1).try_cast("bigint")


def without_exit_code(body: Column) -> Column:
    return F.when(exit_code(body).isNull(), body).otherwise(
        F.regexp_replace(body, f"^{EXIT_MARK}exit=[+-]?\\d+(\n|\\z)", "")
    )


def line_status(line: Column) -> Column:
    """'error', 'ok' or '' for one line of output; error words win."""
    # The words that mark a line.
    low = F.lower(line)
    is_error = low.rlike("error|failed|fatal|panic|traceback")
    is_ok = low.contains("success") | low.contains(" ok ") | low.endswith(" ok")
    return F.when(is_error, "error").when(is_ok, "ok").otherwise("")


def output_lines(body: Column) -> Column:
    """Lines of a text; a closing line break does not open another line."""
    lines = F.split(F.regexp_replace(body, "\r?\n\\z", ""), "\r?\n")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(lines)
