"""Rule catalogue: expressions for the JVM, globs, levels, and checks of custom rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed

CONTEXTS = ("path", "query", "body", "headers")
_WORD = "[A-Za-z0-9_]"
_BEFORE, _AFTER = f"(?<!{_WORD})", f"(?!{_WORD})"
_ASCII_BOUND = f"(?:(?<={_WORD}){_AFTER}|{_BEFORE}(?={_WORD}))"
#: Equal to an expression wherever only a match's existence counts, without its quadratic search.
_EXISTENCE = {r"[)(|*\\].*\(.*=": r"^[^)(|*\\]*+[)(|*\\][^(]*+\([^=]*+="}


@dataclass(frozen=True)
class Rule:
    label: str
    category: str | None
    expression: str
    flags: str
    level: str
    contexts: tuple[str, ...] = ()
    validator: str | None = None

    @property
    def java(self) -> str:
        return to_java(self.expression, self.flags)

    @property
    def exists(self) -> str:
        """For tests of whether there is a match at all."""
        return to_java_existence(self.expression, self.flags)

    @property
    def needs(self) -> tuple[str, ...]:
        """Texts of which one is in the lower-cased text wherever there is a match: a cheap test before the expression."""
        return required_literals(self.expression)


@lru_cache(maxsize=4096)
def required_literals(expression: str) -> tuple[str, ...]:
    """Lower-case texts of which all that the expression matches holds one at least; none if it names no such texts."""
    found = _literals(_parser.parse(expression))
    return found if all(t.isascii() for t in found) else ()


def _literals(parsed) -> tuple[str, ...]:
    options, run = [], ""
    for kind, value in parsed:
        if kind is op.LITERAL:
            run += chr(value).lower()
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):  # these take no room
            options.append((run,) if run else ())
            options.append(_literals_of(kind, value))
            run = ""
    options.append((run,) if run else ())
    return max(options, key=lambda o: (min(map(len, o), default=0), -len(o)))


def _literals_of(kind, value) -> tuple[str, ...]:
    if kind is op.SUBPATTERN:
        return _literals(value[-1])
    if kind is op.ATOMIC_GROUP:
        return _literals(value)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        return _literals(value[2]) if value[0] else ()
    if kind is op.BRANCH:
        parts = [_literals(x) for x in value[1]]
        return tuple(dict.fromkeys(t for x in parts for t in x)) if all(parts) else ()
    if kind is op.IN and len(value) <= 8 and all(k is op.LITERAL for k, _ in value):
        return tuple(dict.fromkeys(chr(v).lower() for _, v in value))
    return ()


def _starts_word(rest: str) -> bool:
    """Whether all that rest matches begins with a word character, as far as its first element tells."""
    if rest[:2] == r"\d" or rest[:1].isalnum() or rest[:1] == "_":
        return rest[1:2] not in ("?", "*") and rest[2:3] not in ("?", "*") if rest[:2] == r"\d" else rest[1:2] not in ("?", "*")
    if rest[:1] == "(" and rest[1:2] != "?" and ")" in rest:
        inner = rest[1 : rest.index(")")]
        return "(" not in inner and all(x[:1].isalnum() for x in inner.split("|")) and rest[rest.index(")") + 1 :][:1] not in ("?", "*")
    return bool(re.match(r"\[(?:[A-Za-z0-9_]-?)+\](?![?*])", rest))


def _ends_word(before: str) -> bool:
    if before[-2:] == r"\d":
        return True
    if before[-1:].isalnum() or before[-1:] == "_":
        return before[-2:-1] != "\\"
    if before[-1:] == ")" and "(" in before:
        inner = before[before.rindex("(") + 1 : -1]
        return not inner.startswith("?") and all(re.fullmatch(r"[A-Za-z0-9_]+", x) for x in inner.split("|"))
    return False


def to_java(expression: str, flags: str = "") -> str:
    """For java.util.regex: only \\n ends a line, and word bounds know ASCII letters alone."""
    out, at, in_class = [], 0, False
    while at < len(expression):
        c = expression[at]
        if c == "\\" and at + 1 < len(expression):
            pair = expression[at : at + 2]
            if pair == r"\b" and not in_class:
                pair = _BEFORE if _starts_word(expression[at + 2 :]) else _AFTER if _ends_word(expression[:at]) else _ASCII_BOUND
            out.append(pair)
            at += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(c)
        at += 1
    return f"(?d{flags})" + "".join(out)


def to_java_existence(expression: str, flags: str = "") -> str:
    return f"(?d{flags}){_EXISTENCE[expression]}" if expression in _EXISTENCE else to_java(expression, flags)


def to_re2(expression: str, flags: str = "") -> str:
    return (f"(?{flags})" if flags else "") + expression


def glob_to_regex(glob: str, fold: bool = False) -> str:
    """An anchored expression for a shell pattern in which * also crosses slashes."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            body = glob[at + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append("[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            at = end
        elif c == "\\" and at + 1 < len(glob):
            at += 1
            out.append(re.escape(glob[at]))
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        at += 1
    return f"(?s{'i' if fold else ''})^" + "".join(out) + r"\z"


def any_glob(value: Column, globs: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | value.rlike(glob_to_regex(g))
    return hit


def severity(label: str) -> str:
    low = label.lower()
    for level, keywords in fixed.SEVERITY_KEYWORDS.items():
        if any(k.lower() in low for k in keywords):
            return level
    return "low"


def default_rules() -> list[Rule]:
    return [Rule(label, c, e, f, severity(label)) for label, c, e, f in fixed.DEFAULT_RULES]


def evasion_rules() -> list[Rule]:
    return [Rule(label, None, e, f, "high") for label, _, e, f in fixed.EVASION_RULES]


def custom_rules(specs=tuple(fixed.CUSTOM_RULES), validators: dict | None = None) -> tuple[list[Rule], list[str]]:
    """Rules from (label, category, expression, flags) tuples or dicts with label, pattern, flags, level, contexts and
    validator; and what was wrong with those left out or mended."""
    known = {label: c for label, c, _, _ in [*fixed.DEFAULT_RULES, *fixed.CUSTOM_RULES]}
    rules, said = [], []
    for spec in specs:
        if not isinstance(spec, dict):
            label, category, expression, flags = spec
            spec = {"label": label, "pattern": expression, "flags": flags, "category": category}
        label, expression = spec.get("label"), spec.get("pattern", "")
        if not label:
            said.append(f"no label: {expression!r}")
            continue
        try:
            re.compile(expression)
        except re.error as wrong:
            said.append(f"{label}: {wrong}")
            continue
        level = spec.get("level")
        if level is not None and level not in ("high", "medium", "low"):
            said.append(f"{label}: level {level!r} derived instead")
            level = None
        contexts = tuple(c for c in spec.get("contexts", ()) if c in CONTEXTS)
        if len(contexts) < len(spec.get("contexts", ())):
            said.append(f"{label}: unknown contexts dropped")
        category = spec.get("category", known.get(label))
        rules.append(Rule(label, category, expression, spec.get("flags", ""), level or severity(label), contexts, spec.get("validator") or (validators or {}).get(label)))
    return rules, said


def catalogue(spark: SparkSession) -> DataFrame:
    """(ord, source, label, category, level, expression, flags) of all shipped rules."""
    rows = [(s, r) for s, rs in (("default", default_rules()), ("evasion", evasion_rules()), ("custom", custom_rules()[0])) for r in rs]
    return spark.createDataFrame([(k, s, r.label, r.category or "-", r.level, r.expression, r.flags) for k, (s, r) in enumerate(rows)], "ord int, source string, label string, category string, level string, expression string, flags string")
