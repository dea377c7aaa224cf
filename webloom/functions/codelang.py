"""Language of code blocks: hints from classes, checks of hints, and scoring by telling patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import islice

from .language_patterns import PATTERNS

PREFIXES = ("language-", "lang-", "hljs-", "brush:")
WEIGHTS = {"unique": 10, "strong": 8, "medium": 5, "weak": 2, "against": -10}
HIGH, MEDIUM, LOW, MARGIN = 20, 12, 5, 0.3
HEAD, TAIL, LONG = 20_000, 10_000, 50_000
#: Bytes at the start in which literals are looked for.
LITERAL = 500
STARTS = (
    (("#!/bin/bash", "#!/usr/bin/env bash"), "bash"), (("#!/bin/sh", "#!/usr/bin/env sh"), "sh"), (("#!/usr/bin/env python", "#!/usr/bin/python"), "python"), (("#!/usr/bin/env node",), "javascript"),
    (("#!/usr/bin/env ruby", "#!/usr/bin/ruby"), "ruby"),
)


def literals(pattern: str) -> tuple[str, str, bool]:
    """(inside, lead, folded): the longest text that every match has in it, '' if there is none; the text that every match
    begins with, '' if there is none; whether case doesn't count, then the first is of lower-case ASCII and the second ''."""
    tree = re._parser.parse(pattern)
    folded = bool(tree.state.flags & re.IGNORECASE)
    best, now, lead, leading = "", "", "", True

    def walk(ops, top: bool) -> None:
        nonlocal best, now, lead, leading
        for op, value in ops:
            if op is re._constants.LITERAL and (not folded or value < 128):
                now += chr(value).lower() if folded else chr(value)
                best = max(best, now, key=len)
                if leading and top:
                    lead = now
            elif op is re._constants.SUBPATTERN and not value[1] & re.IGNORECASE:
                leading = False
                walk(value[3], False)
            elif op is re._constants.MAX_REPEAT and value[0] >= 1 and len(value[2]) == 1 and value[2][0][0] is re._constants.LITERAL and (not folded or value[2][0][1] < 128):
                c = chr(value[2][0][1])
                now += c.lower() if folded else c
                best, now = max(best, now, key=len), ""
                leading = False
            elif op is not re._constants.AT:
                now = ""
                leading = False

    walk(tree, True)
    return best, "" if folded else lead, folded


def literal(pattern: str) -> str:
    """The longest text that every match of a pattern has in it; '' if there is none or case doesn't count."""
    inside, _, folded = literals(pattern)
    return "" if folded else inside


#: What case-insensitive patterns take for an ASCII letter beside its two cases: dotted I, dotless i, long s, Kelvin sign.
FOLDS = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def fold(text: str) -> str:
    return (text if text.isascii() else text.translate(FOLDS)).lower()


@dataclass(frozen=True)
class Table:
    """The different patterns, found by what a text must have in it.

    ``uses``: of each pattern the (language, weight) pairs; ``always``: patterns to search in any text; ``plain`` and
    ``folded``: (literal, patterns) lists of a text as it is or folded, by the literal's first three characters, under ''
    where it is shorter."""

    patterns: list[tuple[re.Pattern, str]]
    uses: list[list[tuple[str, int]]]
    always: list[int]
    plain: dict[str, list[tuple[str, list[int]]]]
    folded: dict[str, list[tuple[str, list[int]]]]


@cache
def table() -> Table:
    uses: dict[str, list[tuple[str, int]]] = {}
    for lang, kinds in PATTERNS.items():
        for kind, own in kinds.items():
            for p in own:
                uses.setdefault(p, []).append((lang, WEIGHTS[kind]))
    patterns, always, by = [], [], ({}, {})
    for i, p in enumerate(uses):
        inside, lead, folded = literals(p)
        patterns.append((re.compile(p), lead))
        if inside:
            by[folded].setdefault(inside, []).append(i)
        else:
            always.append(i)
    out = ({}, {})
    for texts, starts in zip(by, out, strict=True):
        for text, which in texts.items():
            starts.setdefault(text[:3] if len(text) >= 3 else "", []).append((text, which))
    return Table(patterns, list(uses.values()), always, *out)


def candidates(code: str) -> list[int]:
    """The patterns that can match in a text."""
    t = table()
    out = list(t.always)
    for text, starts in ((code, t.plain), (fold(code), t.folded)):
        there = set(map("".join, zip(text, text[1:], text[2:], strict=False))) & starts.keys()
        for s in ("", *there):
            for part, which in starts.get(s, ()):
                if part in text:
                    out += which
    return out


def matches(p: re.Pattern, lead: str, code: str, most: int = 5) -> int:
    """How often a pattern matches, most times at most; only where its first characters stand, if they are known."""
    if not lead:
        return sum(1 for _ in islice(p.finditer(code), most))
    n, at = 0, code.find(lead)
    while at >= 0:
        if m := p.match(code, at):
            n += 1
            if n == most:
                break
            at = m.end() - 1  # a match has its first characters in it, so it is not empty
        at = code.find(lead, at + 1)
    return n


def from_class(value: str | None) -> str | None:
    """The language that a class list names."""
    for word in (value or "").split():
        for p in PREFIXES:
            if word.startswith(p) and len(word) > len(p):
                return word[len(p) :].lower().strip(";") or None
    m = re.search(r"brush:\s*([\w+#-]+)", value or "")
    return m[1].lower() if m else None


def by_literals(text: str) -> str | None:
    """What certain words near the start tell."""
    start = text.encode("utf-8", "surrogatepass")[:LITERAL].decode("utf-8", "ignore")
    for own, lang in STARTS:
        if start.startswith(own):
            return lang
    if "fn main()" in start and ("println!" in start or "let " in start):
        return "rust"
    if "#[derive(" in start or ("impl " in start and " for " in start):
        return "rust"
    if "package main" in start and "func " in start:
        return "go"
    if "<!DOCTYPE html" in start or start.startswith("<html"):
        return "html"
    return "xml" if start.startswith("<?xml") else None


def by_first_line(text: str) -> str | None:
    """What the first line tells, with a look at what follows."""
    lines = text.split("\n", 2)
    first = lines[0].strip()
    if first in ("[package]", "[dependencies]", "[workspace]"):
        return "toml"
    if first == "---" and len(lines) > 1 and ": " in lines[1] and not lines[1].lstrip().startswith("{"):
        return "yaml"
    if first.startswith(("{", "[")) and text.endswith(("}", "]")) and '":' in text:
        return "json"
    return "dockerfile" if first.startswith("FROM ") and ("RUN " in text or "COPY " in text) else None


def sample(text: str) -> str:
    """Of a long text whole lines of its first and last bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= LONG:
        return text
    head, tail = raw[:HEAD], raw[-TAIL:]
    head = head[:at] if (at := head.rfind(b"\n")) >= 0 else head
    tail = tail[at + 1 :] if (at := tail.find(b"\n")) >= 0 else tail
    return (head + b"\n...\n" + tail).decode("utf-8", "ignore")


def scores(code: str) -> dict[str, int]:
    """Of each language above 0, in the order of the table. Up to five matches count: the first for all, each second further one for as much again."""
    code, totals, t = sample(code), dict.fromkeys(PATTERNS, 0), table()
    for i in candidates(code):
        if n := matches(*t.patterns[i], code):
            for lang, weight in t.uses[i]:
                totals[lang] += weight * (1 + (n - 1) // 2)
    return {lang: total for lang, total in totals.items() if total > 0}


def infer(code: str | None) -> tuple[str, str] | None:
    """(language, confidence) or None: by literals, else the first line, else the best score, if it is clear enough."""
    text = (code or "").strip()
    if len(text.encode("utf-8", "surrogatepass")) < 5:
        return None
    if lang := by_literals(text) or by_first_line(text):
        return lang, "high"
    ranked = sorted(scores(text).items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < LOW:
        return None
    best = ranked[0][1]
    level = "high" if best >= HIGH else "medium" if best >= MEDIUM else "low"
    if level == "low" and len(ranked) > 1 and (best - ranked[1][1]) / best < MARGIN:
        return None
    return ranked[0][0], level


#: Parts of texts and the hints they contradict. A backtrace is no program, a manifest no shell script, and so on.
BACKTRACE = re.compile(r"panicked at|stack backtrace:|(?i:backtrace)")
SHELL = re.compile(r"^\s*(?:\$ |(?:brew|apt-get|apt|yum|npm|yarn|pnpm|cargo|pip|curl|wget|git|docker|kubectl) |export [A-Z_][A-Z_0-9]*=)", re.M)
POWERSHELL = re.compile(r"^PS [A-Z]:\\|\b(?:Get|Set|New|Remove|Invoke|Write|Start|Stop)-[A-Z]\w+|\b(?:irm|iex|iwr)\b|\[[A-Z]\w+(?:\.[A-Z]\w+)*\]::|\$PS(?:ScriptRoot|VersionTable)", re.M)
MANIFEST, ASSIGNED = re.compile(r"\[(?:package|dependencies)\]"), re.compile(" = [\"']")
RUST = re.compile(r"#\[derive|pub struct |impl |pub fn |-> |::|: (?:[ui](?:8|16|32|64|size)|bool|f32|f64)")
PROGRAMS = {"rust", "python", "javascript", "typescript", "java", "go", "cpp"}
NOT_SHELL = {"sql", "mysql", "postgres", "postgresql", "ruby", "php", "cpp", "c++", "toml", "css", "go"}
NOT_POWERSHELL = {"toml", "bash", "sh", "shell", "python", "ruby", "perl", "sql", "mysql", "postgres", "postgresql", "yaml", "json", "javascript", "typescript"}


def _settings(code: str) -> bool:
    return ": " in code and "  " in code or code.strip().startswith("{") and '":' in code


CONTRADICTIONS = (
    (BACKTRACE.search, PROGRAMS), (SHELL.search, NOT_SHELL), (POWERSHELL.search, NOT_POWERSHELL), (lambda c: ASSIGNED.search(c) and MANIFEST.search(c), {"bash", "sh", "shell"}),
    (_settings, {"rust", "python", "javascript", "typescript"}), (lambda c: RUST.search(c) or "struct " in c and ": " in c, {"yaml"}),
)


def hint_holds(hint: str, code: str) -> bool:
    """Whether a class's language can be that of the code."""
    return not any(hint.lower() in rejected and test(code) for test, rejected in CONTRADICTIONS)


def language(code: str, hint: str | None) -> str | None:
    """A hint that holds, else what the code looks like."""
    if hint and hint_holds(hint, code):
        return hint
    got = infer(code)
    return got[0] if got else None
