"""Command lines over named steps: chains, conditions and pipes.

    line := step (('&&' | '||' | ';' | '|') step)*
    step := word+                 -- words may be quoted, @{name} is a variable

A step is a function of (context, arguments) that returns an exit code. What it
puts into context.piped reaches the next step behind a '|'; between steps a
DataFrame travels as context.frame, lazily.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

OPERATORS = ("&&", "||", ";", "|")
#: Fixed value: the exit code that ends a whole line.
QUIT = 130
_TOKEN = re.compile(r"""\s*(?:(&&|\|\||;|\|)|((?:[^\s;&|"']|&(?!&)|"(?:[^"\\]|\\.)*"|'[^']*')+))""")
_PART = re.compile(r""""((?:[^"\\]|\\.)*)"|'([^']*)'|([^"']+)""")
_VARIABLE = re.compile(r"@\{([^{}]+)\}")


class SyntaxProblem(ValueError):
    """The line has an open quote or an operator without a step."""


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple[str, ...]
    before: str | None  # the operator before it


@dataclass
class Context:
    handlers: dict[str, Callable[[Context, list[str]], int]]
    variables: dict[str, Any] = field(default_factory=dict)
    piped: str | None = None
    frame: Any = None


def _plain(word: str) -> str:
    return "".join(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2] if m[2] is not None else m[3] for m in _PART.finditer(word))


def parse(line: str) -> list[Step]:
    """The steps of a line, each with the operator before it; an empty line has none."""
    steps: list[Step] = []
    words: list[str] = []
    before, at, text = None, 0, line.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        if m[1] is None:
            words.append(_plain(m[2]))
            continue
        if not words:
            raise SyntaxProblem(f"no step before {m[1]}")
        steps.append(Step(words[0], tuple(words[1:]), before))
        words, before = [], m[1]
    if words:
        steps.append(Step(words[0], tuple(words[1:]), before))
    elif before not in (None, ";"):
        raise SyntaxProblem(f"no step behind {before}")
    return steps


def expanded(word: str, variables: dict[str, Any]) -> str:
    """The word with each @{name} replaced; dots lead into nested values; an unknown name stays as it is."""

    def value(m: re.Match) -> str:
        if m[1] in variables:
            return str(variables[m[1]])
        found: Any = variables
        for part in m[1].split("."):
            if not isinstance(found, dict) or part not in found:
                return m[0]
            found = found[part]
        return str(found)

    return _VARIABLE.sub(value, word)


def run(line: str, context: Context) -> int:
    """Run a line and return the last exit code. A step that && or || rules out takes the whole pipe behind it along; QUIT ends the line."""
    code, skipped = 0, False
    for step in parse(line):
        if step.before == "&&":
            skipped = code != 0
        elif step.before == "||":
            skipped = code == 0
        elif step.before != "|":
            skipped = False
        if skipped:
            continue
        if step.before != "|":
            context.piped = None
        handler = context.handlers.get(step.name)
        if handler is None:
            code = 127
            continue
        given, context.piped = context.piped, None
        context.variables["pipe"] = given if given is not None else ""
        code = handler(context, [expanded(a, context.variables) for a in step.args])
        if code == QUIT:
            return code
    return code


def assign(context: Context, args: list[str]) -> int:
    """set NAME VALUE..."""
    if len(args) < 2:
        return 1
    context.variables[args[0]] = " ".join(args[1:])
    return 0


def show(context: Context, args: list[str]) -> int:
    """get NAME: its value goes into the pipe."""
    if len(args) != 1 or args[0] not in context.variables:
        return 1
    context.piped = str(context.variables[args[0]])
    return 0


def echo(context: Context, args: list[str]) -> int:
    context.piped = " ".join(args)
    return 0


#: Steps that need nothing but the context.
BASIC = {"set": assign, "get": show, "echo": echo}
