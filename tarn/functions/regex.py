"""Patterns of contracts: RE2's syntax, matched from the start of the value by Java's engine.

A pattern is read once, character by character: what RE2 has and Java writes
otherwise is rewritten, what RE2 refuses is refused, and what is left must
compile in Java on the driver, so that no candidate can fail a job.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that RE2 allows behind a backslash; POSIX classes by Java's names; the most repetitions.
ESCAPES = "aftnrvAbBzdDsSwWpPQExC"
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
REPEATS = 1000
#: What a group may begin with: a capture, a name, no capture, or flags.
_GROUP = re.compile(r"\((?:\?P?<([A-Za-z_]\w*)>|\?(?:[imsU]*(?:-[imsU]+)?:|([imsU]+(?:-[imsU]+)?)\)))?")
_COUNT = re.compile(r"\{(\d+)(?:,(\d*))?\}")


class Unsupported(ValueError):
    """A pattern that RE2 refuses."""


def _escape(pattern: str, i: int, inside: bool) -> tuple[str, int]:
    """The escape at i and where it ends."""
    c = pattern[i + 1 : i + 2]
    if not c or c.isalnum() and c not in ESCAPES and c != "0":
        raise Unsupported(f"escape at {i}")
    if c == "v":
        return r"\x0B", i + 2
    if c == "s":
        return r"\t\n\f\r " if inside else r"[\t\n\f\r ]", i + 2
    if c == "S" and not inside:
        return r"[^\t\n\f\r ]", i + 2
    if c == "C":
        return "(?s:.)", i + 2
    if c == "Q":
        end = pattern.find(r"\E", i + 2)
        end = len(pattern) if end < 0 else end
        return re.sub(r"([^\w\s])", r"\\\1", pattern[i + 2 : end]), min(len(pattern), end + 2)
    if c in "pP":
        m = re.match(r"\{(\^?)(\w+)\}|\w", pattern[i + 2 :])
        if not m:
            raise Unsupported("property")
        name, c = (m[2], "P" if (c == "P") != bool(m[1]) else "p") if m[2] else (m[0], c)
        return rf"\{c}{{{name if len(name) < 3 else 'Is' + name}}}", i + 2 + m.end()
    return pattern[i : i + 2], i + 2


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The character class at i in Java's writing: brackets and ampersands inside stand for themselves."""
    out, j = ["["], i + 1
    if pattern[j : j + 1] == "^":
        out.append("^")
        j += 1
    first = True
    while first or pattern[j : j + 1] != "]":
        if j >= len(pattern):
            raise Unsupported("open class")
        posix = re.match(r"\[:(\^?)(\w+):\]", pattern[j:])
        if posix:
            if posix[2] not in POSIX and posix[2] != "word":
                raise Unsupported("class name")
            name = r"\w" if posix[2] == "word" else rf"\p{{{POSIX[posix[2]]}}}"
            out.append(name if not posix[1] else "\\" + name[1:].replace("p{", "P{").replace("w", "W") if posix[2] == "word" else rf"\P{{{POSIX[posix[2]]}}}" if posix[1] else name)
            j += posix.end()
        elif pattern[j] == "\\":
            part, j = _escape(pattern, j, True)
            out.append(part)
        else:
            out.append("\\" + pattern[j] if pattern[j] in "[]&^" else pattern[j])
            j += 1
        first = False
    return "".join(out) + "]", j + 1


def translated(pattern: str) -> str:
    """The pattern in Java's writing (with line ends as RE2 has them)."""
    out, i, lines, quantified = ["(?d)"], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        count = _COUNT.match(pattern, i) if c == "{" else None
        if c in "*+?" or count:
            if quantified and c != "?":
                raise Unsupported("repeated repetition")
            if count and (int(count[1]) > REPEATS or count[2] and (int(count[2]) > REPEATS or int(count[2]) < int(count[1]))):
                raise Unsupported("repetition count")
            end = count.end() if count else i + 1
            lazy = pattern[end : end + 1] == "?"
            out.append(pattern[i : end + lazy])
            i, quantified = end + lazy, True
            continue
        quantified = False
        if c == "\\":
            part, i = _escape(pattern, i, False)
            out.append(part)
        elif c == "[":
            part, i = _class(pattern, i)
            out.append(part)
        elif c == "(":
            m = _GROUP.match(pattern, i)
            if pattern[i + 1 : i + 2] == "?" and m.end() == i + 1:
                raise Unsupported("group")
            lines = lines or "m" in (m[2] or m[0]) and m[1] is None
            out.append("(" if m[1] else m[0].replace("U", "") if "U" not in m[0] else _refuse("flag U"))
            i = m.end()
        else:
            out.append(r"\z" if c == "$" and not lines else r"\{" if c == "{" else c)
            i += 1
    return "".join(out)


def _refuse(why: str) -> str:
    raise Unsupported(why)


def compiled(pattern: str) -> str | None:
    """What Java is given to match from the start of a value; None if the pattern is not RE2's or Java refuses it."""
    try:
        java = translated(pattern)
        re.compile(java.replace("(?d)", "").replace(r"\z", r"\Z")) if SparkContext._active_spark_context is None else None
    except (Unsupported, re.error):
        return None
    whole = f"^(?:{java})"
    sc = SparkContext._active_spark_context
    if sc is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(whole)
        except (Py4JJavaError, PySparkException):
            return None
    return whole


def valid(pattern: str) -> bool:
    return compiled(pattern) is not None


def matches(value: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start; an unsupported pattern matches nothing."""
    java = compiled(pattern)
    return F.lit(False) if java is None else F.coalesce(value.rlike(java), F.lit(False))
