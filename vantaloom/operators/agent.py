"""Routing, tool dispatch, the agent loop behind a chat provider, and its cost accounts."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two intents, looked for in lower-case text; the gap does not cross a line break.
WRITE_INTENT = r"\b(write|generate|create|implement|produce)\b.{0,30}\b(python|code|script|snippet|function|program|class|module)\b"
RUN_INTENT = r"\b(run|execute|compute|calculate)\b.{0,30}\b(python|code|script|snippet)\b"
MAX_STEPS, TOOL_CHARS, FILE_CHARS = 6, 4000, 200_000
NO_ANSWER = "(no answer within the steps allowed)"


def route(query: Column, allow_write: Column, allow_run: Column) -> Column:
    """``write_code`` before ``run_python``, each if its flag is on; else ``search``."""
    low = F.lower(query)
    return F.when(allow_write & F.regexp_like(low, F.lit(WRITE_INTENT)), F.lit("write_code")).when(allow_run & F.regexp_like(low, F.lit(RUN_INTENT)), F.lit("run_python")).otherwise(F.lit("search"))


def tools(has_code: Column, allow_run: Column, allow_write: Column) -> Column:
    """The names of the tools that the flags make available, in order."""
    some = lambda flag, *names: F.when(flag, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("search")), some(has_code, "search_code"), some(allow_run, "run_python", "run_file"), some(allow_write, "read_file", "write_file", "edit_file"))


def format_run(out: Column, err: Column, failure: Column, checked: Column, check_ok: Column, check_error: Column) -> Column:
    """The text of a run for the model: failure, then the check's outcome with its error, then output; cut to the tool's length."""
    from vantaloom.functions.text import strip

    whole = strip(F.concat(out, F.when(F.length(err) > 0, F.concat(F.lit("\n[stderr]\n"), err)).otherwise(F.lit(""))))
    shown = F.when(F.length(whole) > 0, whole).otherwise(F.lit("(no output)"))
    text = F.when(F.length(failure) > 0, F.concat(F.lit("[run failed "), failure, F.lit("]\n"), whole)).when(checked & check_ok, F.concat(F.lit("check passed\n"), shown)).when(checked, F.concat(F.lit("[check failed "), F.coalesce(check_error, F.lit("")), F.lit("]\n"), shown)).otherwise(shown)
    return F.substring(text, 1, TOOL_CHARS)


def trace_costs(traces: DataFrame) -> DataFrame:
    """Per conversation: steps, tool calls, latencies, tokens and characters; missing fields count 0.

    ``traces``: conv_id, total_lat, prefetch struct<lat, chars>, steps array<struct<llm_lat,
    prompt, completion, cached, tools array<struct<name, lat, chars>>>>.
    """
    total = lambda path: F.aggregate("steps", F.lit(0.0), lambda s, x: s + F.coalesce(x[path].cast("double"), F.lit(0.0)))
    inner = lambda path: F.aggregate("steps", F.lit(0.0), lambda s, x: s + F.aggregate(F.coalesce(x["tools"], F.array()), F.lit(0.0), lambda t, y: t + F.coalesce(y[path].cast("double"), F.lit(0.0))))
    calls = F.aggregate("steps", F.lit(0), lambda s, x: s + F.greatest(F.coalesce(F.size(x["tools"]), F.lit(0)), F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return traces.select(
        "conv_id", F.size("steps").cast("long").alias("n_steps"), calls.cast("long").alias("n_tools"), F.round(total("llm_lat"), 6).alias("llm_lat"), F.round(inner("lat"), 6).alias("tool_lat"), total("prompt").cast("long").alias("prompt"),
        total("completion").cast("long").alias("completion"), total("cached").cast("long").alias("cached"), (inner("chars") + zero(F.col("prefetch.chars").cast("double"))).cast("long").alias("chars"), F.round(zero(F.col("total_lat")), 6).alias("total_lat"),
    )


class Workspace:
    """Files of one root; paths that leave it are refused."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)

    def _path(self, name: str) -> str:
        target = os.path.realpath(os.path.join(self.root, name))
        if os.path.commonpath([self.root, target]) != self.root:
            raise ValueError(f"{name} leaves the workspace")
        return target

    def read(self, name: str) -> str:
        with open(self._path(name), encoding="utf-8") as f:
            return f.read(FILE_CHARS)

    def write(self, name: str, content: str) -> str:
        target = self._path(name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(content)
        return f"wrote {name} ({len(content)} characters)"

    def edit(self, name: str, old: str, new: str) -> str:
        """Replace the first occurrence; says how many remain."""
        if not old:
            raise ValueError("the text to replace is empty")
        with open(self._path(name), encoding="utf-8") as f:
            text = f.read()
        before, found, after = text.partition(old)
        if not found:
            raise ValueError("the text to replace does not occur")
        self.write(name, before + new + after)
        rest = after.count(old)
        return f"replaced 1 in {name}" + (f", {rest} more remain" if rest else "")


@dataclass
class Reply:
    """A model's turn: text, or tool calls (id, name, JSON arguments), and its token usage."""

    content: str = ""
    calls: list[tuple[str, str, str]] = field(default_factory=list)
    usage: dict[str, int] = field(default_factory=dict)


class Agent:
    """The loop: route, fetch ahead, then turns of a chat provider with tools until it answers."""

    def __init__(self, chat: Callable[[list[dict], list[str]], Reply], handlers: dict[str, Callable[..., str]], router: Callable[[str], str] = lambda q: "search"):
        self.chat, self.handlers, self.router = chat, handlers, router

    def execute(self, name: str, arguments: str) -> str:
        """A tool's result; arguments that are no JSON give a message for the model, an unknown tool raises."""
        try:
            args = json.loads(arguments)
        except (json.JSONDecodeError, TypeError) as e:
            return f"(the arguments are not JSON: {e}; call the tool again)"
        if name not in self.handlers:
            raise ValueError(f"unknown tool: {name}")
        return self.handlers[name](**args)

    def run(self, query: str, max_steps: int = MAX_STEPS) -> tuple[str, list[str], dict]:
        """Answer, contexts and the trace."""
        began, contexts = time.perf_counter(), []
        trace: dict = {"prefetch": None, "steps": []}
        messages: list[dict] = [{"role": "user", "content": query}]
        if self.router(query) == "search":
            at = time.perf_counter()
            contexts.append(self.handlers["search"](query=query))
            trace["prefetch"] = {"lat": time.perf_counter() - at, "chars": len(contexts[0])}
            messages += [{"role": "assistant", "content": "", "tool_calls": [("prefetch_0", "search", json.dumps({"query": query}))]}, {"role": "tool", "tool_call_id": "prefetch_0", "content": contexts[0]}]
        answer = NO_ANSWER
        for _ in range(max_steps):
            at = time.perf_counter()
            reply = self.chat(messages, sorted(self.handlers))
            step = {"llm_lat": time.perf_counter() - at, **{k: reply.usage.get(k, 0) for k in ("prompt", "completion", "cached")}, "tools": []}
            trace["steps"].append(step)
            if not reply.calls:
                answer = reply.content
                break
            messages.append({"role": "assistant", "content": reply.content, "tool_calls": reply.calls})
            for call, name, arguments in reply.calls:
                at = time.perf_counter()
                result = self.execute(name, arguments)
                step["tools"].append({"name": name, "lat": time.perf_counter() - at, "chars": len(result)})
                contexts.append(result)
                messages.append({"role": "tool", "tool_call_id": call, "content": result})
        trace["total_lat"] = time.perf_counter() - began
        return answer, contexts, trace
