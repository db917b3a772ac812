"""Conversations as dataset lines, and their validators. Validators return arrays of error codes, empty if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.jsonio import is_object, is_valid
from evidentia.functions.text import token_estimate

TURN = "struct<role:string,kind:string,text:string,tool_name:string,args_json:string,result_json:string>"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, system, turns) from rows conv_id, turn, role (system, user, assistant), text, in order of turn."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    told = F.filter("t", lambda t: t["role"] != "system")
    shaped = F.transform(
        told,
        lambda t: F.struct(
            F.when(t["role"] == "user", "USER").otherwise("MODEL").alias("role"), F.lit("TEXT").alias("kind"), t["text"].alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("tool_name", "args_json", "result_json")]
        ),
    )
    system = F.array_join(F.transform(F.filter("t", lambda t: t["role"] == "system"), lambda t: t["text"]), "\n")
    return rows.select("conv_id", F.when(system != "", system).alias("system"), shaped.alias("turns"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def sft_errors(turns: str = "turns") -> Column:
    """Codes ``name`` or ``name:turn``."""
    t = F.col(turns)
    n = F.size(t)
    first, last = F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(-1))
    at = lambda i: F.get(t, i)

    def own(x: Column, i: Column) -> Column:
        code = lambda name, when: F.when(when, F.concat(F.lit(f"{name}:"), (i + 1).cast("string")))
        text, call, reply = x["kind"] == "TEXT", x["kind"] == "TOOL_CALL", x["kind"] == "TOOL_RESPONSE"
        not_kind = lambda y, k: ~F.coalesce(y["kind"] == k, F.lit(False))
        return F.array_compact(
            F.array(
                code("empty_text", text & _blank(x["text"])), code("call_not_model", call & (x["role"] != "MODEL")), code("call_unnamed", call & _blank(x["tool_name"])), code("call_args", call & ~is_object(x["args_json"])),
                code("call_unanswered", call & not_kind(at(i + 1), "TOOL_RESPONSE")), code("response_unnamed", reply & _blank(x["tool_name"])), code("response_json", reply & ~is_valid(x["result_json"])),
                code("response_alone", reply & ~F.coalesce(F.when(i > 0, at(i - 1)["kind"]) == "TOOL_CALL", F.lit(False))),
            )
        )

    whole = F.array_compact(F.array(F.when(~F.coalesce((first["role"] == "USER") & (first["kind"] == "TEXT"), F.lit(False)), "first_not_user"), F.when(~F.coalesce((last["role"] == "MODEL") & (last["kind"] == "TEXT"), F.lit(False)), "last_not_model")))
    return F.when(n <= 0, F.array(F.lit("no_turns"))).otherwise(F.concat(whole, F.flatten(F.transform(t, own))))


def dpo_errors(prompt: str = "prompt_turns", chosen: str = "chosen", rejected: str = "rejected") -> Column:
    t, c, r = F.col(prompt), F.col(chosen), F.col(rejected)
    first, last = F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(-1))
    empty = F.filter(F.transform(t, lambda x, i: F.when((x["kind"] == "TEXT") & _blank(x["text"]), F.concat(F.lit("empty_prompt:"), (i + 1).cast("string")))), lambda x: x.isNotNull())
    own = F.array_compact(
        F.array(
            F.when(F.size(t) <= 0, "no_prompt"), F.when((F.size(t) > 0) & (first["role"] != "USER"), "prompt_start"), F.when((F.size(t) > 0) & ~((last["role"] == "USER") & (last["kind"] == "TEXT")), "prompt_end"),
            F.when(_blank(c), "chosen_empty"), F.when(_blank(r), "rejected_empty"), F.when(~_blank(c) & (F.trim(c) == F.trim(r)), "identical"),
        )
    )
    return F.concat(own, F.coalesce(empty, F.array().cast("array<string>")))


def dpo_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, prompt_turns, chosen, rejected): the turns before the last, its text, and the conversation's first model text as the rejected one."""
    t = F.col("turns")
    model = F.filter(t, lambda x: x["role"] == "MODEL")
    return conversations.where(F.size("turns") >= 2).select("conv_id", F.slice(t, 1, F.size(t) - 1).alias("prompt_turns"), F.element_at(t, -1)["text"].alias("chosen"), F.try_element_at(model, F.lit(1))["text"].alias("rejected"))


def framed(turn: Column) -> Column:
    """The text of a turn, tool turns framed by their name."""
    return F.when(turn["kind"] == "TOOL_CALL", F.concat(F.lit("<tool_call>"), F.to_json(F.struct(turn["tool_name"].alias("name"), turn["args_json"].alias("args"))), F.lit("</tool_call>"))).when(
        turn["kind"] == "TOOL_RESPONSE", F.concat(F.lit("<tool_response>"), F.to_json(F.struct(turn["tool_name"].alias("name"), turn["result_json"].alias("result"))), F.lit("</tool_response>"))
    ).otherwise(turn["text"])


def contents_line(turns: str = "turns") -> Column:
    """{"contents": [{"role", "parts": [{"text"}]}]}"""
    role = lambda x: F.when(x["kind"] == "TOOL_CALL", "model").when(x["kind"] == "TOOL_RESPONSE", "user").otherwise(F.lower(x["role"]))
    return F.to_json(F.struct(F.transform(turns, lambda x: F.struct(role(x).alias("role"), F.array(F.struct(framed(x).alias("text"))).alias("parts"))).alias("contents")))


def messages_line(turns: str = "turns", system: str = "system") -> Column:
    """{"messages": [{"role", "content"}]}, the system message first if there is one."""
    role = lambda x: F.when(x["kind"] == "TOOL_CALL", "assistant").when(x["kind"] == "TOOL_RESPONSE", "user").when(x["role"] == "USER", "user").otherwise("assistant")
    message = "array<struct<role:string,content:string>>"
    head = F.when(F.trim(system) != "", F.array(F.struct(F.lit("system").alias("role"), F.col(system).alias("content")))).otherwise(F.array().cast(message))
    rest = F.transform(turns, lambda x: F.struct(role(x).alias("role"), framed(x).alias("content")))
    return F.to_json(F.struct(F.concat(head.cast(message), rest.cast(message)).alias("messages")))


def dpo_line(prompt: str = "prompt_turns", chosen: str = "chosen", rejected: str = "rejected") -> Column:
    text = lambda c: F.struct(F.lit("model").alias("role"), F.array(F.struct(F.col(c).alias("text"))).alias("parts"))
    contents = F.transform(prompt, lambda x: F.struct(F.lower(x["role"]).alias("role"), F.array(F.struct(framed(x).alias("text"))).alias("parts")))
    return F.to_json(F.struct(contents.alias("contents"), text(chosen).alias("chosen"), text(rejected).alias("rejected")))


def line_errors(lines: DataFrame, max_tokens: int) -> DataFrame:
    """lines: line_no, value. Codes for what is wrong with a message line: no JSON object, no messages, odd roles, ends, alternation, size."""
    parsed = F.from_json("value", "messages array<struct<role:string,content:string>>")
    rows = lines.withColumn("m", parsed["messages"])
    told = F.filter(F.col("m"), lambda x: x["role"] != "system")
    ok = F.size(told) > 0
    pairs = F.arrays_zip(F.slice(told, 1, F.greatest(F.size(told) - 1, F.lit(0))).alias("x"), F.slice(told, 2, F.greatest(F.size(told) - 1, F.lit(0))).alias("y"))
    codes = F.array_compact(
        F.array(
            F.when(~is_object("value"), "not_object"), F.when(is_object("value") & (F.coalesce(F.size("m"), F.lit(0)) <= 0), "no_messages"),
            F.when(F.exists("m", lambda x: ~F.coalesce(x["role"].isin("system", "user", "assistant"), F.lit(False))), "odd_role"), F.when(F.exists("m", lambda x: _blank(x["content"])), "empty_content"),
            F.when(ok & (F.element_at(told, 1)["role"] != "user"), "first_not_user"), F.when(ok & (F.element_at(told, -1)["role"] != "assistant"), "last_not_assistant"),
            F.when(F.exists(pairs, lambda z: z["x"]["role"] == z["y"]["role"]), "no_alternation"), F.when(token_estimate("value") > max_tokens, "too_long"),
        )
    )
    return rows.select("line_no", codes.alias("errors"))


ENCODINGS = ("QWEN_HERMES", "PLAIN_JSON", "GEMMA_FENCED")


def encoded_tool(turn: Column, encoding: str) -> Column:
    """The text of a tool turn in one of three framings; arguments or results that are no JSON become an empty object."""
    name = F.to_json(F.struct(F.coalesce(turn["tool_name"], F.lit("")).alias("name")))
    open_name = F.substr(name, F.lit(1), F.length(name) - 1)
    args = F.when(is_valid(turn["args_json"]), F.to_json(F.try_parse_json(turn["args_json"]))).otherwise("{}")
    result = F.when(is_valid(turn["result_json"]), F.to_json(F.try_parse_json(turn["result_json"]))).otherwise("{}")
    field = "arguments" if encoding == "QWEN_HERMES" else "args"
    call = F.concat(open_name, F.lit(f',"{field}":'), args, F.lit("}"))
    before, after = {"QWEN_HERMES": (("<tool_call>\n", "\n</tool_call>"), ("<tool_response>\n", "\n</tool_response>")), "PLAIN_JSON": (("", ""), ("", "")), "GEMMA_FENCED": (("```tool_call\n", "\n```"), ("```tool_output\n", "\n```"))}[encoding]
    round_ = lambda marks, x: F.concat(F.lit(marks[0]), x, F.lit(marks[1]))
    return F.when(turn["kind"] == "TOOL_CALL", round_(before, call)).when(turn["kind"] == "TOOL_RESPONSE", round_(after, result)).otherwise(turn["text"])


PART_KEYS = ("text", "inline_data", "file_data")
_CONTENT = "struct<role:string,parts:array<map<string,string>>>"


def contents_errors(lines: DataFrame, kind: str, max_tokens: int) -> DataFrame:
    """(line_no, errors) of SFT or DPO lines in contents form. lines: line_no, value.

    Codes: blank, not_json, not_object, no_contents, role:n, no_parts:n, tool_parts:n, odd_keys:n by place of the content; first_not_user and last_not_model
    for SFT; no_chosen, no_rejected, chosen_text, rejected_text for DPO; too_long. ``assistant`` counts as model.
    """
    answer = f"{_CONTENT}"
    parsed = F.from_json("value", f"contents array<{_CONTENT}>, chosen {answer}, rejected {answer}")
    rows = lines.withColumn("p", parsed).withColumns({"blank": F.trim("value") == "", "object": is_object("value"), "valid": is_valid("value")})
    role = lambda c: F.when(c["role"] == "assistant", "model").otherwise(c["role"])
    text = lambda c: F.coalesce(F.exists(c["parts"], lambda x: F.coalesce(F.trim(F.try_element_at(x, F.lit("text"))) != "", F.lit(False))), F.lit(False))
    keys = lambda x: F.map_keys(x)
    tools, known = F.array(F.lit("functionCall"), F.lit("functionResponse")), F.array(*map(F.lit, PART_KEYS))

    def own(c: Column, i: Column) -> Column:
        code = lambda name, when: F.when(F.coalesce(when, F.lit(False)), F.concat(F.lit(f"{name}:"), (i + 1).cast("string")))
        return F.array_compact(
            F.array(
                code("role", ~F.coalesce(role(c).isin("user", "model"), F.lit(False))), code("no_parts", F.coalesce(F.size(c["parts"]), F.lit(0)) <= 0), code("tool_parts", F.exists(c["parts"], lambda x: F.arrays_overlap(keys(x), tools))),
                code("odd_keys", F.exists(c["parts"], lambda x: F.size(F.array_except(keys(x), known)) > 0)),
            )
        )

    contents = F.col("p.contents")
    n = F.coalesce(F.size(contents), F.lit(0))
    first, last = F.try_element_at(contents, F.lit(1)), F.try_element_at(contents, F.lit(-1))
    none = F.array().cast("array<string>")
    each = F.when(n > 0, F.flatten(F.transform(contents, own))).otherwise(F.when(F.col("object"), F.array(F.lit("no_contents"))).otherwise(none))
    if kind == "SFT":
        ends = F.array_compact(F.array(F.when((n > 0) & ~((role(first) == "user") & text(first)), "first_not_user"), F.when((n > 0) & ~((role(last) == "model") & text(last)), "last_not_model")))
    else:
        missing = lambda f: F.when(F.col("object") & F.try_variant_get(F.try_parse_json("value"), f"$.{f}", "variant").isNull(), f"no_{f}").when(F.col("object") & ~text(F.col(f"p.{f}")), f"{f}_text")
        ends = F.array_compact(F.array(missing("chosen"), missing("rejected")))
    long = F.when(token_estimate("value") > max_tokens, F.array(F.lit("too_long"))).otherwise(none)
    whole = F.when(F.col("blank"), F.array(F.lit("blank"))).when(~F.col("valid"), F.array(F.lit("not_json"))).when(~F.col("object"), F.array(F.lit("not_object")))
    return rows.select("line_no", F.coalesce(whole, F.concat(F.coalesce(each, none), ends, long)).alias("errors"))


def file_errors(lines: DataFrame, kind: str, form: str, max_tokens: int) -> DataFrame:
    """(file, line_no, errors) of whole files: line 0 for what is wrong with a file: empty, or DPO in messages form; else its lines' errors, none left out.

    lines: file, line_no, value; trailing blank lines don't count.
    """
    if (kind, form) == ("DPO", "MESSAGES"):
        return lines.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.array(F.lit("dpo_needs_contents")).alias("errors"))
    ends = lines.groupBy("file").agg(F.coalesce(F.max(F.when(F.trim("value") != "", F.col("line_no"))), F.lit(0)).alias("last"))
    kept = lines.join(ends, "file").where(F.col("line_no") <= F.col("last")).select(F.struct("file", "line_no").alias("line_no"), "value")
    told = line_errors(kept, max_tokens) if form == "MESSAGES" else contents_errors(kept, kind, max_tokens)
    empty = ends.where("last = 0").select("file", F.lit(0).cast("long").alias("line_no"), F.array(F.lit("empty_file")).alias("errors"))
    return told.select("line_no.file", "line_no.line_no", "errors").unionByName(empty)
