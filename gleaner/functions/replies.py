"""Model replies: the first JSON object of a reply, and the validity of a tool trajectory."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"\A```(?:json)?\s*|\s*```\Z")


def _as_object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def first_object(reply: str | None) -> dict | None:
    """The reply as a JSON object, without a code fence; else its first balanced braces that are one. Braces inside
    strings count."""
    body = (reply or "").strip()
    if body.startswith("```"):
        body = _FENCE.sub("", body)
    whole = _as_object(body)
    if whole is not None:
        return whole
    opens: int | None = None
    depth = 0
    for m in re.finditer(r"[{}]", body):
        depth += 1 if m[0] == "{" else -1
        if m[0] == "{" and depth == 1:
            opens = m.start()
        elif depth == 0 and opens is not None:
            inner = _as_object(body[opens : m.end()])
            if inner is not None:
                return inner
            opens = None
    return None


def extract_json(reply: Column) -> Column:
    """JSON text of the first object, keys sorted; null if there is none."""

    @F.pandas_udf("string")
    def extract(replies: pd.Series) -> pd.Series:
        found = (first_object(r) for r in replies)
        return pd.Series([None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False) for x in found], dtype=object)

    return extract(reply)


def trajectory_problem(messages: list[dict], tools: list[dict]) -> str | None:
    """Why a tool trajectory is invalid, or None. Calls may be parallel and answered in any order, but each once, and
    all before the assistant speaks again without calling."""
    names = {t["function"].get("name") for t in tools or [] if t.get("function")}
    used: set[str] = set()
    unanswered: set[str] = set()
    for message in messages or []:
        calls = message.get("tool_calls") or []
        if message.get("role") == "tool":
            call = (message.get("tool_call_id") or "").strip()
            if call not in unanswered:
                return "broken_chain:orphan_result"
            unanswered.discard(call)
        elif message.get("role") == "assistant":
            if unanswered and not calls:
                return "broken_chain:no_result"
            for entry in calls:
                call, function = (entry.get("id") or "").strip(), entry.get("function") or {}
                name = (function.get("name") or "").strip()
                if not call:
                    return "missing_call_id"
                if call in used:
                    return "duplicate_call_id"
                if name not in names:
                    return f"unknown_function:{name}"
                try:
                    json.loads(function.get("arguments") or "{}")
                except (TypeError, ValueError):
                    return "invalid_arguments_json"
                used.add(call)
                unanswered.add(call)
    return "broken_chain:no_result" if unanswered else None


def validate_trajectory(messages: Column, tools: Column) -> Column:
    """messages and tools as JSON text to the problem, null if there is none; unreadable JSON is invalid_json."""

    @F.pandas_udf("string")
    def check(m: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(m, t):
            try:
                out.append(trajectory_problem(json.loads(x or "[]"), json.loads(y or "[]")))
            except (TypeError, ValueError, AttributeError, KeyError):
                out.append("invalid_json")
        return pd.Series(out, dtype=object)

    return check(messages, tools)
