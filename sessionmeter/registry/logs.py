"""The given conversations written as log lines of each dialect, so that the readers have work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.registry.tables import table

BASE = 1_704_844_800  # 2024-01-10T00:00:00Z


def _columns() -> tuple[Column, ...]:
    """conv, turn, role, text, and the time of a turn; every fifth turn has one that cannot be read."""
    conv, turn = F.col("conv_id"), F.col("turn")
    seconds = F.lit(BASE).cast("bigint") + conv * 60 + turn
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return conv, turn, F.col("role"), F.col("text"), F.when(turn % 5 == 4, F.lit("soon")).otherwise(iso)


def _obj(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _line(**fields) -> Column:
    return F.to_json(_obj(timestamp=_columns()[-1], **fields))


def _name(prefix: str) -> Column:
    return F.concat(F.lit(prefix), _columns()[0].cast("string"))


def _lines(spark: SparkSession, sf_dir: str, path: Column, lines: list[Column]) -> DataFrame:
    """One row per line; `lines` are those of one turn, NULL where it has none."""
    conv, turn = _columns()[:2]
    numbered = F.array(*[F.struct(F.lit(i).alias("k"), c.alias("value")) for i, c in enumerate(lines)])
    return (
        table(spark, sf_dir, "conversations")
        .select(
            path.alias("path"),
            (conv + 1_700_000_000).alias("file_mtime"),
            F.lit(0).cast("bigint").alias("file_size"),
            turn,
            F.explode(F.filter(numbered, lambda n: n["value"].isNotNull())).alias("n"),
        )
        .select(
            "path", "file_mtime", "file_size",
            (F.col("turn") * 10 + F.col("n.k")).alias("ord"),
            F.col("n.value").alias("value"),
        )
    )


def claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, role, text, _ = _columns()
    is_user, is_assistant = role == "user", role == "assistant"
    cwd = F.concat(F.lit("/w/p"), (conv % 7).cast("string"))
    mid = F.concat(F.lit("m"), conv.cast("string"), F.lit("-"), turn.cast("string"))
    model = F.when(conv % 2 == 0, "claude-sonnet-4-x").otherwise("claude-opus-4-5-x")
    size = F.length(text)

    def said(content: Column, usage: Column) -> Column:
        return F.when(
            is_assistant,
            _line(type="assistant", cwd=cwd, message=_obj(id=mid, model=model, content=content, usage=usage)),
        )

    plain = _line(type="user", cwd=cwd, message=_obj(content=text))
    blocks = F.array(
        _obj(type="text", text=text, content=F.lit(None).cast("string"), tool_use_id=F.lit(None).cast("string")),
        _obj(
            type="tool_result", text=F.lit(None).cast("string"),
            content=F.concat(F.lit("r"), turn.cast("string")), tool_use_id="use",
        ),
    )
    rich = _line(type="user", message=_obj(content=blocks))
    nested = F.when(
        is_user & (turn % 4 != 0),
        _line(
            type="user",
            message=_obj(content=F.array(_obj(type="tool_result", content=F.array(_obj(z=turn, a="x"))))),
        ),
    )
    return _lines(
        spark, sf_dir,
        F.concat(F.lit("/logs/-w-p"), (conv % 7).cast("string"), F.lit("/"), _name("c"), F.lit(".jsonl")),
        [
            F.when((turn == 0) & (conv % 9 == 0), _line(type="queue-operation", content="go")),
            F.when(turn == 0, F.lit('{"type": "user", "torn')),
            F.when(is_user & (turn % 4 == 0), plain).when(is_user, rich),
            nested,
            F.when(is_user & (turn % 3 == 0), _line(type="user", isMeta=True, message=_obj(content="meta"))),
            said(
                F.array(_obj(type="thinking", thinking=text)),
                _obj(input_tokens=size, output_tokens=1),
            ),
            said(F.array(_obj(type="text", text=text)), _obj(input_tokens=size + 1, output_tokens=0)),
            F.when(
                is_assistant,
                _line(type="assistant", message=_obj(id=mid, model="<synthetic>", content=F.array(_obj(type="x")))),
            ),
            said(
                F.array(_obj(type="tool_use", name="Bash", input=_obj(n=turn, cmd="ls " * 100))),
                _obj(
                    input_tokens=size, output_tokens=size + 7, cache_read_input_tokens=size % 13,
                    cache_creation_input_tokens=F.lit("5"),
                    cache_creation=_obj(ephemeral_5m_input_tokens=size % 3, ephemeral_1h_input_tokens=F.lit(2.5)),
                ),
            ),
            F.when(role == "system", _line(type="system", content=text, entrypoint=F.when(conv % 5 == 0, "sdk-cli"))),
        ],
    )


def codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, role, text, _ = _columns()
    is_user, is_assistant, is_system = role == "user", role == "assistant", role == "system"
    size = F.length(text)
    second = (turn == 3) & (conv % 4 < 2)

    def event(sub: str, **fields) -> Column:
        return _line(type="event_msg", payload=_obj(type=sub, **fields))

    def tokens(**fields) -> Column:
        return event("token_count", info=_obj(last_token_usage=_obj(**fields)))

    return _lines(
        spark, sf_dir,
        F.concat(F.lit("/logs/2024/01/10/rollout-2024-01-10T00-00-00-"), _name("c"), F.lit(".jsonl")),
        [
            F.when(
                turn == 0,
                _line(
                    type="session_meta",
                    payload=_obj(cwd="/w/q", source="cli", originator=F.when(conv % 5 == 0, "codex_exec").otherwise("tui")),
                ),
            ).when(
                second, _line(type="session_meta", payload=_obj(source="cli", cwd=F.when(conv % 4 == 0, "/w/later")))
            ),
            F.when(
                (turn % 3 == 0) & ~((turn == 0) & (conv % 6 == 5)),
                _line(type="turn_context", payload=_obj(model=F.when(turn == 0, "gpt-5.3-codex").otherwise("o3"))),
            ),
            F.when(is_user, event("user_message", message=text))
            .when(is_system, event("exec_command_end", aggregated_output=text, exit_code=conv % 3))
            .otherwise(
                _line(
                    type="response_item",
                    payload=_obj(
                        type="message", role="assistant",
                        content=F.array(
                            _obj(type="output_text", text=text), _obj(type="x", text=F.lit(None).cast("string"))
                        ),
                    ),
                )
            ),
            F.when(
                is_assistant,
                _line(
                    type="response_item",
                    payload=_obj(type="function_call", name="shell", arguments=F.concat(F.lit("n="), turn.cast("string"))),
                ),
            ),
            F.when(is_assistant, tokens(input_tokens=size, output_tokens=size % 50, cached_input_tokens=size % 20)),
            F.when(is_assistant, event("task_complete")),
            F.when(is_system, tokens(input_tokens=F.lit("7"), output_tokens=F.lit(2.5), cached_input_tokens=F.lit(-4))),
            F.when(is_system, event("web_search_end")),
        ],
    )


def qwen(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, role, text, _ = _columns()
    is_user, is_assistant, is_system = role == "user", role == "assistant", role == "system"
    size = F.length(text)
    none = F.lit(None)

    def part(**fields) -> Column:
        call = "struct<name:string,args:struct<b:bigint,a:string>>"
        return _obj(
            text=fields.get("text", none.cast("string")),
            thought=fields.get("thought", none.cast("boolean")),
            functionCall=fields.get("call", none).cast(call),
        )

    called = _obj(name=F.lit("f"), args=_obj(b=turn, a="x"))
    answered = _obj(
        functionResponse=_obj(name=F.when(turn % 2 == 1, "f"), response=_obj(output=text))
    )
    telemetry = F.struct(
        F.lit("qwen-code.api_response").alias("event.name"),
        F.when(conv % 2 == 0, "a########b").otherwise("solo").alias("prompt_id"),
    )
    return _lines(
        spark, sf_dir,
        F.concat(F.lit("/logs/p"), (conv % 7).cast("string"), F.lit("/chats/"), _name("c"), F.lit(".jsonl")),
        [
            F.when(
                is_user,
                _line(
                    type="user",
                    cwd=F.when(turn > 0, F.lit("/w/z")),
                    message=_obj(parts=F.array(part(text=F.lit("hm"), thought=F.lit(True)), part(text=text))),
                ),
            )
            .when(
                is_assistant,
                _line(
                    type="assistant",
                    model=F.when(conv % 3 != 0, "qwen3-coder-x"),
                    usageMetadata=_obj(
                        promptTokenCount=size, candidatesTokenCount=size % 40, cachedContentTokenCount=size % 9
                    ),
                    message=_obj(
                        parts=F.array(
                            part(text=text, thought=F.lit(True)), part(text=text), part(call=called)
                        )
                    ),
                ),
            )
            .when(is_system, _line(type="system", subtype="ui_telemetry", systemPayload=_obj(uiEvent=telemetry))),
            F.when(
                is_assistant,
                _line(
                    type="tool_result",
                    toolCallResult=_obj(status=F.when(turn % 4 == 1, "error").otherwise("success")),
                    message=_obj(parts=F.array(answered)),
                ),
            ).when(is_system, _line(type="system", systemPayload=text)),
        ],
    )


def hermes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two stored tables."""
    conv, turn, role, text, _ = _columns()
    rows = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("c"), conv.cast("string"))
    sums = rows.groupBy("conv_id").agg(F.sum(F.length(text)).alias("size"), F.count(F.lit(1)).alias("n"))
    empty = conv % 11 == 10
    start = (conv * 60 + BASE).cast("double") + 0.25

    def unless_empty(value: Column) -> Column:
        return F.when(~empty, value.cast("bigint"))

    size = F.col("size")
    sessions = sums.select(
        key.alias("id"),
        F.when(conv % 3 != 0, "gemma-x").alias("model"),
        start.alias("started_at"),
        F.when(conv % 4 != 0, start + 100.5).alias("ended_at"),
        unless_empty(F.col("n")).alias("message_count"),
        unless_empty(size).alias("input_tokens"),
        unless_empty(F.when(conv % 7 == 0, F.lit(-5)).otherwise(size % 100)).alias("output_tokens"),
        unless_empty(size % 30).alias("cache_read_tokens"),
        unless_empty(size % 17).alias("cache_write_tokens"),
        unless_empty(size % 5).alias("reasoning_tokens"),
        F.when(conv % 5 == 0, F.concat(F.lit("title of "), key)).alias("title"),
    )
    is_tool = (role == "system") & (turn % 2 == 0)
    calls = F.when(conv % 9 == 0, F.lit("broken {")).when(
        conv % 9 == 1, F.lit('{"name":"not a list"}')
    ).otherwise(
        F.to_json(
            F.array(
                _obj(id="1", function=_obj(name="grep", arguments=F.concat(F.lit("n="), turn.cast("string"))),
                     name=F.lit(None).cast("string")),
                _obj(id="2", function=F.lit(None).cast("struct<name:string,arguments:string>"), name="bare"),
            )
        )
    )
    messages = rows.select(
        (conv * 100 + turn).alias("id"),
        key.alias("session_id"),
        F.when(is_tool, "tool").otherwise(role).alias("role"),
        F.when(turn != 5, text).alias("content"),
        F.when(is_tool & (conv % 2 == 0), "id7").alias("tool_call_id"),
        F.when(role == "assistant", calls).alias("tool_calls"),
        F.when(is_tool & (conv % 3 == 0), "run").alias("tool_name"),
        ((conv * 60 + turn + BASE).cast("double") + 0.5).alias("timestamp"),
        F.when((role == "assistant") & (turn % 2 == 1), text).alias("reasoning"),
    )
    return sessions, messages
