"""The Claude dialect: one JSON object per line, messages streamed over several lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sessionmeter.functions import jsonval as J
from sessionmeter.functions.text import first_chars, fold_command_tags, is_blank
from sessionmeter.functions.times import rfc3339_seconds
from sessionmeter.operators.logs import explode_events, first_value, parsed_lines, summary_row
from sessionmeter.operators.ordered import line_chunk
from sessionmeter.schema import TOKEN_COLUMNS, USAGE, no_usage

AGENT = "claude"
SYNTHETIC = "<synthetic>"
NO_ID = "_anon"


def _raw_user_text(v: Column) -> Column:
    """The text a user line carries: a plain string or the first text block."""
    blocks = F.filter(J.list_at(v, "$.message.content"), lambda b: J.word_at(b, "$.type") == "text")
    first = J.text_at(F.try_element_at(blocks, F.lit(1)), "$.text")
    return F.when(J.word_at(v, "$.type") == "user", F.coalesce(J.text_at(v, "$.message.content"), first))


def _with_user_text(parsed: DataFrame) -> DataFrame:
    """Add `said`, the folded user text; in two steps, so that the text is looked up once."""
    return parsed.withColumn("_raw", _raw_user_text(F.col("v"))).withColumn("said", fold_command_tags(F.col("_raw")))


def sessions(lines: DataFrame) -> DataFrame:
    """One row per file."""
    v = F.col("v")
    kind = J.word_at(v, "$.type")
    rows = _with_user_text(parsed_lines(lines, AGENT, keep_bad=True)).select(
        "path", "session_id", "file_mtime", "ord",
        v.isNotNull().alias("is_json"),
        kind.alias("type"),
        J.text_at(v, "$.cwd").alias("cwd"),
        rfc3339_seconds(J.word_at(v, "$.timestamp")).alias("ts"),
        (J.text_at(v, "$.entrypoint") == "sdk-cli").alias("is_sdk"),
        first_chars(F.col("said"), 120).alias("prompt"),
        F.when(kind == "assistant", J.text_at(v, "$.message.model")).alias("model"),
    )
    opened_by = F.min_by(F.coalesce("type", F.lit("")), F.when(F.col("is_json"), F.col("ord")))
    return summary_row(
        rows,
        AGENT,
        cwd=first_value("cwd"),
        model=first_value("model"),
        prompt=first_value("prompt"),
        turns=F.count_if(F.col("type") == "user"),
        is_scripted=F.coalesce(opened_by == "queue-operation", F.lit(False))
        | F.coalesce(F.bool_or("is_sdk"), F.lit(False)),
    )


def _usage(v: Column) -> dict[str, Column]:
    paths = {
        "input_tokens": "$.message.usage.input_tokens",
        "output_tokens": "$.message.usage.output_tokens",
        "cache_read_tokens": "$.message.usage.cache_read_input_tokens",
        "cache_creation_5m_tokens": "$.message.usage.cache_creation.ephemeral_5m_input_tokens",
        "cache_creation_1h_tokens": "$.message.usage.cache_creation.ephemeral_1h_input_tokens",
        "cache_creation_tokens": "$.message.usage.cache_creation_input_tokens",
    }
    return {name: J.count_at(v, path) for name, path in paths.items()}


def token_events(lines: DataFrame) -> DataFrame:
    """One event per user line and per assistant call, streamed lines of a call merged."""
    return merge_streamed(call_rows(lines), AGENT)


def call_rows(lines: DataFrame) -> DataFrame:
    """The rows `merge_streamed` takes: one per line that opens, continues or ends a call."""
    v = F.col("v")
    kind = J.word_at(v, "$.type")
    model = F.coalesce(J.text_at(v, "$.message.model"), F.lit(""))
    return (
        parsed_lines(lines, AGENT)
        .where(~J.flag_at(v, "$.isMeta"))
        .select(
            "path", "session_id", "ord",
            F.coalesce(F.when(kind.isin("user", "assistant"), kind), F.lit("other")).alias("kind"),
            F.coalesce(rfc3339_seconds(J.word_at(v, "$.timestamp")), F.lit(0).cast("bigint")).alias("ts"),
            model.alias("model"),
            F.coalesce(J.text_at(v, "$.message.id"), F.lit("")).alias("mid"),
            J.at(v, "$.message").isNotNull().alias("has_message"),
            *[c.alias(n) for n, c in _usage(v).items()],
        )
        .where((F.col("kind") != "assistant") | (F.col("has_message") & (F.col("model") != SYNTHETIC)))
        .drop("has_message")
    )


def merge_streamed(rows: DataFrame, agent: str) -> DataFrame:
    """Merge adjacent assistant rows that share a non-empty id.

    `rows`: path, session_id, ord, kind (user, assistant, other), ts, model, mid and usage columns, with
    transparent lines already gone. The first row of a run counts until a later one with output replaces
    it. Runs are found per chunk; the first and last run of each chunk then meet in a second, small cell,
    so a file of any size is spread over many tasks. Both passes are windows over one sort each.
    """
    usage = [c for c in USAGE if c in rows.columns]
    has_output = (F.col("kind") == "assistant") & (F.col("output_tokens") > 0)
    rows = rows.withColumns(
        {
            "chunk": line_chunk(),
            "key": F.when(F.col("mid") == "", F.lit(NO_ID)).otherwise(F.col("mid")),
            "has_output": has_output,
            # the model a row gives to a run that is already open
            "sets_model": F.when(has_output & (F.col("model") != ""), F.col("model")),
            "is_first": F.lit(True),
        }
    )
    in_chunk = Window.partitionBy("path", "chunk").orderBy("ord")
    parts = _close_runs(rows, in_chunk)

    # only the first and last run of a chunk can belong together with a run of another chunk
    is_first = F.col("run_no") == 1
    at_border = is_first | F.col("is_last")
    parts = parts.withColumn("is_first", is_first).withColumn(
        "cell", F.when(at_border, F.lit(-1).cast("bigint")).otherwise(F.col("chunk"))
    )
    calls = _close_runs(parts.drop("run_no", "is_last"), Window.partitionBy("path", "cell").orderBy("ord"))
    is_turn = F.col("kind") == "user"
    spent = sum((F.col(c) for c in usage if c != "web_search_calls"), F.lit(0))
    model = F.coalesce("sets_model", "model")
    return (
        calls.where(is_turn | ((F.col("kind") == "assistant") & (spent > 0)))
        .select(
            F.lit(agent).alias("agent"), "path", "session_id", "ord", "ts",
            is_turn.alias("is_user_turn"),
            F.when(is_turn, F.lit("")).otherwise(model).alias("model"),
            *[F.when(is_turn, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in usage],
            *[c.alias(n) for n, c in no_usage().items() if n not in usage],
        )
        .select(*TOKEN_COLUMNS)
    )


def _close_runs(rows: DataFrame, window: WindowSpec) -> DataFrame:
    """One row per run of the window: the row whose state counts at its end.

    A row that is not `is_first` always opens a run. Adds `run_no` and `is_last` (in its partition);
    `model` becomes that of the run's first row, `sets_model` the last one given later, if any.
    """
    goes_on = (
        F.col("is_first")
        & (F.col("kind") == "assistant")
        & (F.col("mid") != "")
        & (F.lag("kind").over(window) == "assistant")
        & (F.lag("key").over(window) == F.col("mid"))
    )
    opens = ~F.coalesce(goes_on, F.lit(False))
    # a row that neither opens a run nor has output changes nothing
    kept = rows.withColumn("opens", opens).where(F.col("opens") | F.col("has_output"))
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    given = F.when(F.col("sets_model").isNotNull(), F.col("sets_model")).when(F.col("opens"), F.lit(""))
    next_opens = F.lead("opens").over(window)
    return (
        kept.withColumns(
            {
                "next_opens": next_opens,
                "run_no": F.sum(F.col("opens").cast("int")).over(so_far),
                "given": F.last(given, ignorenulls=True).over(so_far),
                "model": F.last(F.when(F.col("opens"), F.col("model")), ignorenulls=True).over(so_far),
            }
        )
        .where(F.coalesce("next_opens", F.lit(True)))
        .withColumn("is_last", F.col("next_opens").isNull())
        .withColumn("sets_model", F.nullif("given", F.lit("")))
        .drop("opens", "next_opens", "given")
    )


def _event(kind: str, body: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), body.alias("body"))


def _user_events(v: Column) -> Column:
    text = F.col("said")
    blocks = F.filter(J.list_at(v, "$.message.content"), lambda b: J.word_at(b, "$.type") == "tool_result")
    results = F.transform(
        blocks, lambda b: _event("ToolResult", F.coalesce(J.text_or_json(b, "$.content"), F.lit("")))
    )
    said = F.when(text.isNotNull() & ~is_blank(text), F.array(_event("User", text)))
    return F.concat(F.coalesce(said, F.array()), F.coalesce(results, F.array()))


def _assistant_events(v: Column) -> Column:
    def one(block: Column) -> Column:
        kind = J.word_at(block, "$.type")
        call = F.concat(
            F.coalesce(J.text_at(block, "$.name"), F.lit("tool")),
            F.lit(": "),
            F.coalesce(F.to_json(J.at(block, "$.input")), F.lit("")),
        )
        return (
            F.when(kind == "text", _event("Assistant", J.text_at(block, "$.text")))
            .when(kind == "thinking", _event("Thinking", J.text_at(block, "$.thinking")))
            .when(kind == "tool_use", _event("ToolUse", call))
        )

    return F.filter(F.transform(J.list_at(v, "$.message.content"), one), lambda e: e["body"].isNotNull())


def transcript(lines: DataFrame) -> DataFrame:
    """Readable events in order."""
    v = F.col("v")
    kind = J.word_at(v, "$.type")
    events = (
        F.when(kind == "user", _user_events(v))
        .when(kind == "assistant", _assistant_events(v))
        .when(
            (kind == "system") & J.text_at(v, "$.content").isNotNull(),
            F.array(_event("System", J.text_at(v, "$.content"))),
        )
    )
    readable = parsed_lines(lines, AGENT).where(
        ~J.flag_at(v, "$.isMeta") & kind.isin("user", "assistant", "system")
    )
    rows = (
        _with_user_text(readable)
        .select(
            "path", "session_id", "ord",
            F.coalesce(J.text_at(v, "$.timestamp"), F.lit("")).alias("ts"),
            events.alias("events"),
        )
    )
    return explode_events(rows, AGENT)
