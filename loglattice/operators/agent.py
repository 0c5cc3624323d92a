"""The model side: tools, retries, the tool-calling loop and prompts.

A model is any function; none is needed for the default rules. These run on the driver or
inside ``decide.ask``; what they are about stays in columns.
"""

from __future__ import annotations

import inspect
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger("loglattice")

KINDS = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}
#: Calls of tools that one question may take.
LIMITS = {"classification": 10, "judgment": 12, "extraction": 8}


class Fatal(Exception):
    """An error that no repetition mends."""


def is_fatal(error: BaseException) -> bool:
    """Whether a call must not be repeated: no permission, or an answer that says so."""
    status = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    return isinstance(error, (Fatal, PermissionError)) or status in (401, 403)


@dataclass
class Tools:
    """Functions a model may call, by name; arguments are checked against their signatures."""

    functions: dict[str, Callable] = field(default_factory=dict)

    def add(self, function: Callable) -> Callable:
        self.functions[function.__name__] = function
        return function

    def schemas(self) -> list[dict[str, Any]]:
        """What a model is told of each tool."""
        out = []
        for name, function in self.functions.items():
            of = inspect.signature(function, eval_str=True).parameters
            properties = {k: {"type": KINDS.get(p.annotation, "string")} for k, p in of.items()}
            required = [k for k, p in of.items() if p.default is inspect.Parameter.empty]
            out.append({"name": name, "description": inspect.getdoc(function) or "", "parameters": {"type": "object", "properties": properties, "required": required}})
        return out

    def call(self, name: str, arguments: str | dict[str, Any]) -> str:
        """The result as JSON; an object with ``error`` where the tool, its arguments or its run are wrong."""
        try:
            given = json.loads(arguments) if isinstance(arguments, str) else arguments
            bound = inspect.signature(self.functions[name], eval_str=True)
            bound.bind(**given)
            for key, value in given.items():
                kind = bound.parameters[key].annotation
                if kind in KINDS and not (isinstance(value, kind) and (kind is bool or not isinstance(value, bool)) or kind is float and isinstance(value, int)):
                    raise TypeError(f"{key} must be {KINDS[kind]}")
            return json.dumps(self.functions[name](**given))
        except KeyError:
            return json.dumps({"error": f"no such tool: {name}"})
        except Exception as error:  # noqa: BLE001  the model reads it and may call again
            return json.dumps({"error": str(error)})


def retried(call: Callable[[], str], parse: Callable[[str], Any], attempts: int = 3) -> tuple[bool, Any, str]:
    """Whether an answer could be read, what it says and the answer; asked again until ``parse`` gives more than None."""
    answer = ""
    for attempt in range(1, attempts + 1):
        try:
            answer = call()
            found = parse(answer)
            if found is not None:
                return True, found, answer
        except Exception as error:  # noqa: BLE001  a model may fail in any way
            if is_fatal(error):
                raise
            log.warning("attempt %d of %d: %s", attempt, attempts, error)
    return False, None, answer


def converse(model: Callable[[list[dict], list[dict]], dict], tools: Tools, prompt: str, limit: int = 10) -> str:
    """A model's last answer, after the tools it calls; ``model`` takes messages and schemas and gives ``text`` or ``calls``.

    After ``limit`` rounds the model is asked once more, without tools.
    """
    messages: list[dict] = [{"role": "user", "content": prompt}]
    for _ in range(limit):
        said = model(messages, tools.schemas())
        if not said.get("calls"):
            return said.get("text") or ""
        messages.append({"role": "assistant", "calls": said["calls"]})
        messages += [{"role": "tool", "name": x["name"], "content": tools.call(x["name"], x.get("arguments", {}))} for x in said["calls"]]
    return model(messages, []).get("text") or ""


def filled(template: str, **values: Column | str | int) -> Column:
    """A prompt from a template with {name} places; a place without a value stays as it is."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce((value if isinstance(value, Column) else F.lit(value)).cast("string"), F.lit("")))
    return out
