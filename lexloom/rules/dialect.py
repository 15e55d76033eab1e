"""Rule regexes and globs as Java patterns.

Rules are written in a linear-time dialect without look-around or
backreferences.  Java accepts those and differs in defaults, so every pattern
is checked and rewritten; what has no equivalent is refused.
"""

from __future__ import annotations

import re

from .ast import RuleError

#: Unicode classes, and a dot that stops at line feeds only.
_FLAGS = "(?Ud)"


def java_regex(pattern: str) -> str:
    """The Java pattern that finds what ``pattern`` finds; RuleError if none does."""
    out, i, multiline = [], 0, False
    n, names = len(pattern), set()
    lazy = [False]  # whether greed is swapped, in each open group
    while i < n:
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            if i + 1 >= n:
                raise RuleError(f"invalid regex /{pattern}/: trailing backslash")
            nxt = pattern[i + 1]
            if nxt.isdigit() or nxt in "kGZQEXRhHV":
                raise RuleError(f"invalid regex /{pattern}/: \\{nxt} is not supported")
            if m := re.match(r"\\[pP]\{([^{}]*)\}", rest):
                out.append(_property(pattern, m[0][:2], m[1]))
                i += len(m[0])
                continue
            if m := re.match(r"\\([xu])\{([0-9A-Fa-f]+)\}", rest):
                out.append(rf"\x{{{m[2]}}}")
                i += len(m[0])
                continue
            out.append(c + nxt)
            i += 2
            continue
        if c == "[":
            java, i = _class(pattern, i)
            out.append(java)
            continue
        if rest.startswith("(?"):
            if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest):
                if m[1] in names:
                    raise RuleError(f"invalid regex /{pattern}/: two groups are named {m[1]}")
                names.add(m[1])
                out.append("(")  # nothing reads groups by name
                lazy.append(lazy[-1])
            elif m := re.match(r"\(\?([imsxUu-]*)(\)|:)", rest):
                on, _, off = m[1].partition("-")
                if "u" in off:
                    raise RuleError(f"invalid regex /{pattern}/: classes are those of Unicode")
                multiline |= "m" in on
                swapped = True if "U" in on else False if "U" in off else lazy[-1]
                on, off = (re.sub("[Uu]", "", flags) for flags in (on, off))
                kept = on + (f"-{off}" if off else "")
                if m[2] == ":":
                    lazy.append(swapped)
                    out.append(f"(?{kept}:")
                else:
                    lazy[-1] = swapped
                    out.append(f"(?{kept})" if kept else "")
            else:
                raise RuleError(f"invalid regex /{pattern}/: look-around and atomic groups are not supported")
            i += len(m[0])
            continue
        if c == "(":
            lazy.append(lazy[-1])
        elif c == ")":
            lazy.pop()
            if not lazy:
                raise RuleError(f"invalid regex /{pattern}/: unopened group")
        elif c in "*+?{" and (m := _REPEAT.match(pattern, i)):
            more = _REPEAT.match(pattern, m.end())
            if more and pattern[m.end()] == "+":
                raise RuleError(f"invalid regex /{pattern}/: possessive quantifiers are not supported")
            if more:
                raise RuleError(f"invalid regex /{pattern}/: a repetition is repeated; put it in a group")
            repeat, greedy = m[0].removesuffix("?") if len(m[0]) > 1 else m[0], len(m[0]) == 1 or not m[0].endswith("?")
            out.append(repeat if greedy != lazy[-1] else repeat + "?")
            i = m.end()
            continue
        elif c == "{":
            raise RuleError(f"invalid regex /{pattern}/: a brace that is no repetition needs a backslash")
        elif c == "$" and not multiline:
            out.append(r"\z")
            i += 1
            continue
        out.append(c)
        i += 1
    if len(lazy) > 1:
        raise RuleError(f"invalid regex /{pattern}/: unclosed group")
    translated = "".join(out)
    _check_with_jvm_rules(pattern, translated)
    return _FLAGS + translated


#: A class that nothing is in.
_NOTHING = r"[^\x{0}-\x{10FFFF}]"


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The Java class for the one that opens at ``i``, and the place behind it.

    Operators between the parts of a class, from the left: && is what both hold,
    -- what the first holds alone, ~~ what one of them holds.
    """
    i += 1
    negated = pattern[i : i + 1] == "^"
    i += negated
    operands: list[list[str]] = [[]]
    operators: list[str] = []
    first = True
    while True:
        rest, c = pattern[i:], pattern[i : i + 1]
        if not c:
            raise RuleError(f"invalid regex /{pattern}/: unclosed class")
        if c == "]" and not first:
            i += 1
            break
        if rest[:2] in ("--", "~~", "&&") and not first:
            operators.append(rest[:2])
            operands.append([])
            i += 2
            continue
        first = False
        if c == "[":
            if m := re.match(r"\[:(\^?)(\w+):\]", rest):
                if m[2] not in _POSIX:
                    raise RuleError(f"invalid regex /{pattern}/: unknown class {m[0]}")
                operands[-1].append(f"[{m[1]}{_POSIX[m[2]]}]")
                i += len(m[0])
            else:
                java, i = _class(pattern, i)
                operands[-1].append(java)
        elif c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if not nxt or nxt.isdigit() or nxt in "kGZQEXRhHVbBAz":
                raise RuleError(f"invalid regex /{pattern}/: \\{nxt} is not supported in a class")
            if m := re.match(r"\\[pP]\{([^{}]*)\}", rest):
                operands[-1].append(_property(pattern, m[0][:2], m[1]))
            elif m := re.match(r"\\[xu]\{([0-9A-Fa-f]+)\}", rest):
                operands[-1].append(rf"\x{{{m[1]}}}")
            else:
                m = re.match(r"\\.", rest, re.S)
                operands[-1].append(m[0])
            i += len(m[0])
        else:
            operands[-1].append("\\" + c if c in "]^&~" else c)
            i += 1
    parts = ["".join(o) for o in operands]
    if not operators:
        return "[" + "^" * negated + parts[0] + "]", i
    java, *others = (f"[{p}]" if p else _NOTHING for p in parts)
    for operator, other in zip(operators, others):
        alone = f"[{java}&&[^{other}]]"
        java = {"&&": f"[{java}&&{other}]", "--": alone, "~~": f"[{alone}[{other}&&[^{java}]]]"}[operator]
    return f"[^{java}]" if negated else java, i


#: Bracketed class names, which are ASCII whatever the flags.  Fixed values.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t-\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Properties that Java knows by these names.
_NAMED = {"Alpha", "Digit", "Alnum", "Upper", "Lower", "Punct", "Space", "XDigit", "Cntrl", "Graph", "Print", "Blank"}


#: One repetition, lazy or not.
_REPEAT = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??")


def _property(pattern: str, escape: str, name: str) -> str:
    """A Unicode property as Java names it: categories alike, scripts and binary ones behind "Is"."""
    if name.startswith("^"):
        escape, name = escape[0] + ("p" if escape[1] == "P" else "P"), name[1:]
    if not re.fullmatch(r"\w+(?:[=:]\w+)?", name):
        raise RuleError(f"invalid regex /{pattern}/: unknown property {name!r}")
    plain = len(name) <= 2 or "=" in name or name in _NAMED or name.startswith(("Is", "In"))
    return f"{escape}{{{name.replace(':', '=') if plain or ':' in name else 'Is' + name}}}"


def _check_with_jvm_rules(pattern: str, translated: str) -> None:
    """Catch what a job would fail on: by Java itself where a session runs, else the commonest errors."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import IllegalArgumentException

        try:
            context._jvm.java.util.regex.Pattern.compile(_FLAGS + translated)
        except (Py4JJavaError, IllegalArgumentException) as e:
            why = str(getattr(e, "java_exception", e)).split("\n")[0]
            raise RuleError(f"invalid regex /{pattern}/: {why}") from None
    for low, high in re.findall(r"(?<!\\)\[\^?(?:[^\]\\]*?)(\w)-(\w)", translated):
        if low > high:
            raise RuleError(f"invalid regex /{pattern}/: range {low}-{high} runs backwards")
    if re.match(r"(?:\(\?[imsx]*\))*[*+?]", translated) or re.search(r"(?<!\\)[(|][*+?](?!.*\])", translated.replace("(?", "")):
        raise RuleError(f"invalid regex /{pattern}/: nothing to repeat")
    for low, high in re.findall(r"(?<!\\)\{(\d+),(\d+)\}", translated):
        if int(low) > int(high):
            raise RuleError(f"invalid regex /{pattern}/: bad repetition {{{low},{high}}}")


def glob_regex(glob: str) -> str:
    """A whole-path Java pattern for ``glob``, in which * and ? also match slashes."""
    out, i, n, braces = [], 0, len(glob), 0
    while i < n:
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**/", i):
            out.append("/(?:.*/)?")
            i += 4
        elif glob[i:] == "/**":
            out.append("/.+")
            i = n
        elif glob[i] == "*":
            while i < n and glob[i] == "*":
                i += 1
            out.append(".*")
        elif glob[i] == "?":
            out.append(".")
            i += 1
        elif glob[i] == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!"))
            if end < 0:
                raise RuleError(f"invalid glob {glob!r}: unclosed class")
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            out.append("[" + "^" * negated + body + "]")
            i = end + 1
        elif glob[i] == "{":
            braces += 1
            out.append("(?:")
            i += 1
        elif glob[i] == "}":
            braces -= 1
            if braces < 0:
                raise RuleError(f"invalid glob {glob!r}: unopened alternates")
            out.append(")")
            i += 1
        elif glob[i] == "," and braces:
            out.append("|")
            i += 1
        elif glob[i] == "\\":
            if i + 1 >= n:
                raise RuleError(f"invalid glob {glob!r}: trailing backslash")
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(glob[i]))
            i += 1
    if braces:
        raise RuleError(f"invalid glob {glob!r}: unclosed alternates")
    return r"(?s)\A" + "".join(out) + r"\z"
