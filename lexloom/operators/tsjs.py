"""A scanner for TypeScript and JavaScript.

It yields the leaves that a full parser would, without parsing: lexing is
exact up to the choice between division and regular expression and between
comparison and element, and a stack of bracket roles tells blocks from objects, members from expressions and types
from values.  It never fails: whatever it cannot place is a symbol.
"""

from __future__ import annotations

import re

from .lexemes import Lexeme, links

# The reserved and contextual words of the language.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if "
    "import in instanceof new return switch throw try typeof var void while with yield let await enum async".split()
)
CONTEXTUAL = frozenset(
    "abstract accessor as asserts declare from get global implements infer interface is keyof module namespace of "
    "override private protected public readonly satisfies set static type unique using".split()
)
VALUES = {"true": "bool", "false": "bool", "null": "null", "undefined": "undefined", "this": "other", "super": "other"}
TYPES = frozenset("any number boolean string symbol unknown never object".split())
MODIFIERS = frozenset("static async get set public private protected readonly abstract override declare accessor".split())
PUNCTUATION = sorted(
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= ++ -- && || ?? ?. += -= *= /= %= &= |= ^= << >> ** "
    "{ } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split(),
    key=len,
    reverse=True,
)
# End of the fixed values.

_WORD = r"(?:[^\W\d]|\$)(?:\w|\$)*"
_LEX = re.compile(
    rf"""(?P<blank>\s+|﻿)
    |(?P<comment>//[^\n\r]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))
    |(?P<string>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))
    |(?P<number>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?n?)
    |(?P<private>\#{_WORD})
    |(?P<word>{_WORD}|\\u[0-9a-fA-F]{{4}}(?:\w|\$)*)
    |(?P<template>`)
    |(?P<punct>{"|".join(map(re.escape, PUNCTUATION))})
    |(?P<odd>.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/((?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+)/([A-Za-z]*)")
#: Kinds of pieces that brackets come as.
_BRACKETS = ("punct", "jsx_brace")
#: Behind these a value ends, so a slash divides and a bracket indexes or calls.
_VALUE_END = frozenset((")", "]", "}", "++", "--"))
_BEFORE_EXPRESSION = frozenset("= ( , [ ? => && || ?? ! : + - * / % & | ^ ~ < > == === != !== <= >= += -= *= /= %= **= ... ** << >> >>>".split())
_EXPRESSION_WORDS = frozenset("return typeof case in of delete void throw new instanceof await yield else do extends".split())


def _template_end(text: str, at: int) -> int:
    """The offset behind the template literal that opens at ``at``."""
    depth: list[int] = []  # braces open inside each substitution
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth or depth[-1] == -1:  # literal text
            if c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif text.startswith("${", i):
                depth.append(0)
                i += 1
        elif c == "`":
            depth.append(-1)
        elif c in "\"'":
            m = _LEX.match(text, i)
            i = m.end()
            continue
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            if depth[-1]:
                depth[-1] -= 1
            else:
                depth.pop()
        i += 1
    return n


_JSX = re.compile(
    r"""(?P<blank>\s+)
    |(?P<comment>//[^\n\r]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))
    |(?P<string>"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))
    |(?P<name>[^\W\d][\w$-]*|\$[\w$-]*)
    |(?P<jsx>/>|</|[<>=.:])
    |(?P<brace>\{)
    |(?P<odd>.)""",
    re.X | re.S,
)
_JSX_TEXT = re.compile(r"[^<>{}&]+")
_ENTITY = re.compile(r"&(?:\#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7})|[A-Za-z]{1,29});")
_TAG = re.compile(r"<\s*(?:(?P<name>[^\W\d][\w$.:-]*|\$[\w$.:-]*)|(?P<fragment>>))")
#: Type parameters of an arrow function, which look like a tag.
_GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|=(?![\s]*[\"'{<])|extends\b(?!\s*[=/>]))")


class _Splitter:
    """First pass: (start, end, lexical kind, text), blanks left out, regexes in their parts.

    Code may hold elements where ``jsx`` says so, and elements hold code in
    braces: a stack tells which is read.  Kinds of what an element is made of
    begin with "jsx".
    """

    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx
        self.out: list[tuple[int, int, str, str]] = []
        self.before: tuple[str, str] | None = None  # kind and text of the last lexeme that is no comment
        self.parens: list[bool] = []  # whether each open ( heads a statement
        self.after_head = False
        #: What encloses the place: ["code", braces open in it], "tag", "closing" or "children".
        self.inside: list = [["code", 0]]
        self.closings: dict[str, int] = {}  # where the last closing tag of a name stands

    def put(self, start: int, end: int, kind: str) -> int:
        self.out.append((start, end, kind, self.text[start:end]))
        if kind != "comment":
            self.before = (kind, self.text[start:end])
        return end

    def pieces(self) -> list[tuple[int, int, str, str]]:
        at, n = 0, len(self.text)
        if self.text.startswith("#!"):
            end = self.text.find("\n")
            at = n if end < 0 else end
            self.out.append((0, at, "hashbang", self.text[:at]))
        while at < n:
            mode = self.inside[-1]
            at = self.children(at) if mode == "children" else self.code(at) if isinstance(mode, list) else self.tag(at)
        return self.out

    def code(self, at: int) -> int:
        text = self.text
        m = _LEX.match(text, at)
        kind, value, end = m.lastgroup, m[0], m.end()
        if kind == "blank":
            return end
        if kind == "template":
            end = _template_end(text, at)
        elif kind == "punct" and value[0] == "/" and _regex_may_start(self.before, self.after_head) and (r := _REGEX.match(text, at)):
            self.out += [(at, at + 1, "slash", "/"), (at + 1, r.end(1), "pattern", r[1]), (r.end(1), r.end(1) + 1, "slash", "/")]
            if r[2]:
                self.out.append((r.start(2), r.end(), "flags", r[2]))
            self.before = ("regex", "/")
            return r.end()
        elif kind == "punct" and value[0] == "<" and self.element_starts(at):
            self.after_head = False
            self.inside.append("tag")
            return self.put(at, at + 1, "jsx")
        elif kind == "punct" and value == "}" and len(self.inside) > 1 and self.inside[-1][1] == 0:
            self.inside.pop()  # the code that an element holds ends
            return self.put(at, at + 1, "jsx_brace")
        opens = kind == "punct" and value in "{}"
        if opens:
            self.inside[-1][1] = max(0, self.inside[-1][1] + (1 if value == "{" else -1))
        head = self.before
        self.put(at, end, kind)
        if kind == "comment":
            return end
        self.after_head = False
        if value == "(":
            self.parens.append(head is not None and head[1] in ("if", "while", "for", "with"))
        elif value == ")" and self.parens:
            self.after_head = self.parens.pop()
        return end

    def element_starts(self, at: int) -> bool:
        """Whether an element opens at the "<" here: where a value is expected, and closed somewhere."""
        if not self.jsx or self.before is not None and self.before[1] == "}" or not _regex_may_start(self.before, self.after_head):
            return False
        m = _TAG.match(self.text, at)
        if not m or _GENERIC.match(self.text, at):
            return False
        name = m["name"] or ""
        if name not in self.closings:
            self.closings[name] = max((c.start() for c in re.finditer(r"</\s*" + re.escape(name), self.text)), default=-1)
            self.closings.setdefault("/>", self.text.rfind("/>"))
        bare = self.text[m.end() : m.end() + 1] == ">" or not name
        return self.closings[name] > at or not bare and self.closings["/>"] > at

    def tag(self, at: int) -> int:
        """A piece of an opening or closing tag."""
        m = _JSX.match(self.text, at)
        kind, value, end = m.lastgroup, m[0], m.end()
        if kind == "blank":
            return end
        if kind == "brace":
            self.inside.append(["code", 0])
            self.after_head = False
            return self.put(at, end, "jsx_brace")
        if kind == "name":
            last = self.before[1]
            return self.put(at, end, "jsx_name" if last in ("<", "</") else "jsx_property" if last == "." else "jsx_name" if last == ":" else "jsx_attribute")
        if kind == "jsx" and value == "<" and self.before[1] != "=":
            return self.put(at, end, "punct")  # a type argument
        if kind == "jsx" and value == "<":
            self.inside.append("tag")
        if kind == "jsx" and value in (">", "/>"):
            mode = self.inside.pop()
            if mode == "tag" and value == ">":
                self.inside.append("children")
            elif mode == "closing":
                self.inside.pop()  # the children that it closes
        return self.put(at, end, {"odd": "odd", "string": "string", "comment": "comment"}.get(kind, "jsx"))

    def children(self, at: int) -> int:
        """A piece between tags."""
        text = self.text
        if text.startswith("</", at):
            self.inside.append("closing")
            return self.put(at, at + 2, "jsx")
        if text[at] == "<":
            self.inside.append("tag")
            return self.put(at, at + 1, "jsx")
        if text[at] == "{":
            self.inside.append(["code", 0])
            self.after_head = False
            return self.put(at, at + 1, "jsx_brace")
        if m := _ENTITY.match(text, at):
            return self.put(at, m.end(), "jsx_entity")
        if m := _JSX_TEXT.match(text, at):
            # Blanks that a line break begins are no text.
            return self.put(at, m.end(), "jsx_text") if re.sub(r"\n\s*", "", m[0]) else m.end()
        return self.put(at, at + 1, "odd")


def _regex_may_start(before: tuple[str, str] | None, after_head: bool) -> bool:
    if before is None or after_head:
        return True
    kind, value = before
    if kind == "punct":
        return value not in _VALUE_END or value == "}"
    return kind == "word" and value in _EXPRESSION_WORDS


class _Scanner:
    """Second pass: roles of brackets, names, functions and depths."""

    def __init__(self, text: str, language: str, jsx: bool = False):
        self.source, self.pieces = text, _Splitter(text, jsx).pieces()
        self.behind: dict[int, int] = {}  # ends of type parameters that were looked for
        self.typed = language == "typescript"
        #: Indexes of pieces that are no comments, and back.
        self.real = [i for i, p in enumerate(self.pieces) if p[2] not in ("comment", "hashbang")]
        self.words = [self.pieces[i][3] for i in self.real]
        self.kinds = [self.pieces[i][2] for i in self.real]
        self.partner = self._partners()
        #: Arrows that return types lead to, looked for by opening parenthesis; parentheses of conditionals, which lead to none.
        self.ahead: dict[int, int | None] = {}
        self.values: set[int] = set()
        #: Colons of return types with their arrows, and those arrows.
        self.returns: dict[int, int] = {}
        self.arrows: set[int] = set()
        self.out: list[Lexeme] = []

    def _partners(self) -> list[int | None]:
        return links([w if k in _BRACKETS else "" for w, k in zip(self.words, self.kinds)])

    def word(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.kinds) and self.kinds[k] == "word"

    def starts_statement(self, k: int) -> bool:
        """Whether a declaration may begin at ``k``."""
        before = self.word(k - 1)
        if k and self.kinds[k - 1] != "punct":
            return before in ("export", "default", "declare", "async", "else", "do") or before not in _EXPRESSION_WORDS
        return before not in _BEFORE_EXPRESSION

    def generic_end(self, k: int) -> int:
        """Behind the type parameters at ``k``, or ``k`` itself."""
        if self.word(k) != "<":
            return k
        if k not in self.behind:
            self.behind[k] = self._angles_end(k)
        return self.behind[k]

    def _angles_end(self, k: int) -> int:
        depth, j = 0, k
        while j < len(self.words):
            w = self.words[j]
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(w, 0)
            if depth <= 0:
                return j + 1
            if w in ("(", "[", "{") and self.kinds[j] == "punct" and self.partner[j] is not None:
                j = self.partner[j]
            elif w in (";", "{", ")", "]", "}", "&&", "||"):
                break
            j += 1
        return k

    def scan(self) -> list[Lexeme]:
        frames: list[dict] = [{"role": "block", "curly": 0, "round": 0, "bracket": 0, "function": "", "type": False, "decl": False}]
        #: (role of the next "{", its function name) that a head has announced.
        pending: dict[int, tuple[str, str]] = {}
        functions: list[tuple[int, int, str]] = self._named_functions(pending)
        spans = iter(functions)
        active: list[tuple[int, str]] = []
        following = next(spans, None)
        names: dict[int, str] = {}
        for k in range(len(self.words)):
            while active and active[-1][0] <= k:
                active.pop()
            while following and following[0] <= k:
                active.append((following[1], following[2]))
                following = next(spans, None)
            names[k] = active[-1][1] if active else ""
        k = 0
        for i, (start, end, lexical, text) in enumerate(self.pieces):
            frame = frames[-1]
            if lexical in ("comment", "hashbang"):
                kind = "comment" if lexical == "comment" else "hash_bang_line"
                cls = "comment" if lexical == "comment" else "other"
                inside = names.get(k, "") if k and names.get(k - 1) == names.get(k) else ""
                self.out.append(Lexeme(start, end, text, kind, cls, True, inside, frame["curly"], frame["round"], frame["bracket"]))
                continue
            opened = None
            if lexical in _BRACKETS and text in "({[":
                opened = self._open(k, frame, pending)
                frames.append(opened)
                frame = opened
            kind, cls, named = self._classify(k, lexical, text, frames[-2] if opened else frame)
            self.out.append(Lexeme(start, end, text, kind, cls, named, names[k], frame["curly"], frame["round"], frame["bracket"]))
            if lexical in _BRACKETS and text in ")}]" and len(frames) > 1 and self.partner[k] is not None:
                while len(frames) > 1 and frames[-1]["at"] != self.partner[k]:
                    frames.pop()
                if len(frames) > 1:
                    frames.pop()
            else:
                self._follow(k, text, lexical, frames[-1], opened is not None)
            k += 1
        return self.out

    # -- functions ------------------------------------------------------

    def _named_functions(self, pending) -> list[tuple[int, int, str]]:
        """(first, behind the last, name) of declarations and methods; marks their bodies."""
        found = []
        for k, w in enumerate(self.words):
            if self.kinds[k] != "word" or self.word(k - 1) in (".", "?."):
                continue
            if w == "function":
                name = k + 1 + (self.word(k + 1) == "*")
                params = self.generic_end(name + 1 if self.is_name(name) else name)
                body = self._behind_params(params, pending, "params")
                first = k - (self.word(k - 1) == "async")
                if self.is_name(name) and self.starts_statement(first):
                    found.append((first, body, self.words[name]))
            elif w == "class" or w == "interface" and self.is_name(k + 1) or w == "enum" and self.is_name(k + 1):
                role = {"class": "class", "interface": "interface", "enum": "enum"}[w]
                if (j := self._next_brace(k + 1)) is not None:
                    pending[j] = (role, "")
                    if role == "class":
                        self._methods(j, pending, found)
            elif w in ("namespace", "module") and (self.is_name(k + 1) or self.kinds[k + 1 : k + 2] == ["string"]):
                if (j := self._next_brace(k + 1)) is not None:
                    pending[j] = ("block", "")
        self._object_methods(pending, found)
        return sorted(found, key=lambda f: (f[0], -f[1]))

    def _object_methods(self, pending, found) -> None:
        """Methods of object literals: a name, parameters and a body behind a brace or comma."""
        known = {first for first, _, _ in found}
        for k, w in enumerate(self.words):
            if self.word(k + 1) != "(" or self.kinds[k] not in ("word", "string", "number") or w in KEYWORDS - {"get", "set"}:
                continue
            first = k
            while self.word(first - 1) in ("async", "get", "set", "*"):
                first -= 1
            close = self.partner[k + 1]
            if self.word(first - 1) in ("{", ",") and first not in known and close is not None and self.word(close + 1) == "{":
                found.append((first, self._behind_params(k + 1, pending, "params"), w))

    def _next_brace(self, k: int) -> int | None:
        depth = 0
        while k < len(self.words):
            w = self.words[k]
            if w in ("(", "[") and self.kinds[k] == "punct":
                k = self.partner[k] or k
            elif w == "{" and depth <= 0:
                return k
            elif w == ";":
                return None
            depth += {"<": 1, ">": -1}.get(w, 0)
            k += 1
        return None

    def _behind_params(self, k: int, pending, role: str) -> int:
        """Marks parameters at ``k`` and the body behind them; returns its end."""
        if self.word(k) != "(" or self.partner[k] is None:
            return k + 1
        pending[k] = (role, "")
        j = self.partner[k] + 1
        if self.word(j) == ":":  # a return type, which may hold braces of its own
            j += 1
            while j < len(self.words) and self.words[j] not in (";", "}"):
                if self.words[j] == "{":
                    if self.word(j - 1) in (":", "|", "&", "is", "<", ",", "=>") and self.partner[j]:
                        pending[j] = ("interface", "")
                        j = self.partner[j]
                    else:
                        break
                elif self.words[j] in ("(", "[") and self.partner[j]:
                    j = self.partner[j]
                j += 1
        if self.word(j) == "{":
            pending[j] = ("block", "")
            return (self.partner[j] or len(self.words) - 1) + 1
        return j + (self.word(j) == ";")

    def _methods(self, brace: int, pending, found) -> None:
        """Methods among the members of a class body."""
        end = self.partner[brace]
        k, fresh = brace + 1, True
        while k < (len(self.words) if end is None else end):
            if not fresh:
                w = self.words[k]
                if w in ("(", "[", "{") and self.kinds[k] == "punct" and self.partner[k]:
                    k = self.partner[k]
                    fresh = self.words[k] == "}" and self._line_breaks(k)
                elif w == ";" or self._line_breaks(k - 1) and self.kinds[k] in ("word", "private") and self.word(k - 1) not in _BEFORE_EXPRESSION:
                    fresh = True
                    if w != ";":
                        continue
                k += 1
                continue
            if self.word(k) == "@":
                k += 2
                while self.word(k) == ".":
                    k += 2
                if self.word(k) == "(" and self.partner[k]:
                    k = self.partner[k] + 1
                continue
            first = k
            while self.word(k) in MODIFIERS and self.word(k + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}"):
                k += 1
            k += self.word(k) == "*"
            name = self.words[k] if k < len(self.words) else ""
            after = (self.partner[k] or k) + 1 if name == "[" else k + 1
            after += self.word(after) in ("?", "!")
            params = self.generic_end(after)
            if self.word(params) == "(" and (self.kinds[k] in ("word", "private", "string", "number") or name == "["):
                body = self._behind_params(params, pending, "params")
                found.append((first, body, name))
                k, fresh = max(body, k + 1), True
            elif name == "{" and self.partner[k]:  # static block
                pending[k] = ("block", "")
                k = self.partner[k] + 1
            else:
                k, fresh = max(after, k + 1), name == ";"

    def _line_breaks(self, k: int) -> bool:
        """Whether a line ends between real pieces ``k`` and ``k + 1``."""
        if k + 1 >= len(self.real):
            return True
        a, b = self.pieces[self.real[k]], self.pieces[self.real[k + 1]]
        return b[0] - a[1] > 0 and (self.real[k + 1] - self.real[k] > 1 or self._has_newline(a[1], b[0]))

    def _has_newline(self, a: int, b: int) -> bool:
        return "\n" in self.source[a:b]

    # -- brackets -------------------------------------------------------

    def _open(self, k: int, frame: dict, pending) -> dict:
        w, before = self.words[k], self.word(k - 1)
        before_kind = self.kinds[k - 1] if k else ""
        value_ended = before_kind in ("word", "private", "string", "template", "number") and before not in KEYWORDS - {"async"} or before_kind == "punct" and before in (")", "]")
        new = {**frame, "at": k, "type": False, "decl": False, "ternary": 0, "angles": 0}
        role = pending.get(k, ("", ""))[0]
        if self.kinds[k] == "jsx_brace":
            new["role"] = "jsx"
            return new
        if w == "(":
            if not role:
                if before in ("for", "catch") or before == "await" and self.word(k - 2) == "for":
                    role = "head"
                elif self._heads_arrow(k, frame, pending) or frame["role"] == "interface" and not frame["type"]:
                    role = "params"
                elif before in ("import", "super") or value_ended or before == ">":
                    role = "arguments"
                else:
                    role = "paren"
            if frame["type"] and role != "params":
                role = "type"
            new["round"] += role in ("params", "arguments", "paren")
            new["type"] = role == "type"
        elif w == "[":
            member = frame["role"] in ("object", "class", "interface") and self._member_start(k, frame)
            role = "computed" if member else "type" if frame["type"] else "subscript" if value_ended or before == "?." else "array"
            new["bracket"] += role == "array"
            new["type"] = role == "type"
        else:
            role = role or self._brace_role(k, before, frame)
            new["curly"] += role in ("block", "class")
        new["role"] = role
        return new

    def _heads_arrow(self, k: int, frame: dict, pending) -> bool:
        """Whether an arrow function begins at ``k``; marks its return type and body."""
        arrow = self._arrow_at(k)
        if arrow is None:
            return False
        colon = self.partner[k] + 1
        if arrow == colon or frame["type"]:
            return True
        if frame.get("ternary") and not self._else_follows(arrow):
            self.values.add(k)  # the colon is that of the conditional
            return False
        self.returns[colon] = arrow
        self.arrows.add(arrow)
        if self.word(arrow + 1) == "{":
            pending[arrow + 1] = ("block", "")
        return True

    def _arrow_params(self, k: int) -> bool:
        return self._arrow_at(k) is not None

    def _arrow_at(self, k: int) -> int | None:
        """The "=>" of which the parenthesis at ``k`` holds the parameters, directly before it or with a return type between."""
        close = self.partner[k]
        if close is None or k in self.values:
            return None
        if self.word(close + 1) == "=>":
            return None if close + 1 in self.arrows else close + 1
        if self.word(close + 1) != ":" or not self.typed or not self._may_head(k):
            return None
        if k not in self.ahead:
            self.ahead[k] = self._behind_return_type(close + 2)
        return self.ahead[k]

    def _may_head(self, k: int) -> bool:
        """Whether parameters may begin at ``k``, and not a call's arguments."""
        if self.kinds[k - 1 : k] != ["word"]:
            return True
        before = self.word(k - 1)
        return before == "default" or before in _EXPRESSION_WORDS - {"case"} or before == "async" and self.word(k - 2) not in (".", "?.")

    def _behind_return_type(self, j: int) -> int | None:
        while j < len(self.words):
            w = self.words[j]
            if w == "=>":
                if not self._ends_function_type(j):
                    return j
            elif w == "<" and self.generic_end(j) > j:
                j = self.generic_end(j)
                continue
            elif w in ("(", "[", "{") and self.kinds[j] == "punct" and self.partner[j] is not None:
                if w == "{" and self.word(j - 1) not in (":", "|", "&", "is", "extends", "=>"):
                    return None
                j = self.partner[j]
            elif w in (";", ":", ",", ")", "]", "}", "?", "=", "(", "[", "{"):
                return None
            j += 1
        return None

    def _ends_function_type(self, arrow: int) -> bool:
        """Whether the parentheses before an "=>" in a return type are parameters of a function type."""
        begins = self.partner[arrow - 1] if self.word(arrow - 1) == ")" else None
        if begins is None or self.word(begins - 1) not in (":", "|", "&", "=>", "new", ">"):
            return False
        return self.word(begins + 1) in (")", "...") or self.is_name(begins + 1) and self.word(begins + 2) in (":", ",", "?", "=", ")")

    def _else_follows(self, arrow: int) -> bool:
        """Whether the body of an arrow function is followed by the other branch of a conditional."""
        j, open_ = arrow + 1, 0
        while j < len(self.words):
            w = self.words[j]
            if w in ("(", "[", "{") and self.kinds[j] == "punct" and self.partner[j] is not None:
                j = self.partner[j]
            elif w == ":":
                if not open_:
                    return True
                open_ -= 1
            elif w in (";", ",", ")", "]", "}"):
                return False
            open_ += w == "?"
            j += 1
        return False

    def _brace_role(self, k: int, before: str, frame: dict) -> str:
        if frame["type"]:
            return "interface"
        if before in ("import", "export") or before == "type" and self.word(k - 2) in ("import", "export") or before == "," and self.word(k - 3) == "import":
            return "names"
        if before == ")":
            open_paren = self.partner[k - 1]
            head = self.word(open_paren - 1) if open_paren is not None else ""
            return "switch" if head == "switch" else "block"
        if before in ("=>", "else", "do", "try", "finally", "catch", ";", "{", "}", ""):
            inside_object = before == "{" and frame["role"] in ("object", "names")
            return "object" if inside_object else "block"
        if before == ":" and frame["role"] in ("block", "switch"):
            # a label or case body, unless a conditional or an annotation led here
            return "object" if frame.get("else") == k - 1 else "interface" if frame["decl"] and self.typed else "block"
        if before == "=" and self.typed and self.word(k - 3) == "type":
            return "interface"
        if self.kinds[k - 1] == "word" and before not in KEYWORDS and self._line_breaks(k - 1):
            return "block"
        return "object"

    # -- names ----------------------------------------------------------

    def _member_start(self, k: int, frame: dict) -> bool:
        """Whether ``k`` begins the name of a member in its frame."""
        before = self.word(k - 1)
        if before in ("{", ",", ";", "*") and self.kinds[k - 1] == "punct" or before in MODIFIERS:
            return True
        if frame["role"] in ("class", "interface"):
            return before in ("}", ")") or self._line_breaks(k - 1) and before not in _BEFORE_EXPRESSION
        return False

    def _follow(self, k: int, w: str, lexical: str, frame: dict, opened: bool) -> None:
        """Keep track of declarations, conditionals and type positions."""
        if opened or lexical not in ("punct", "word"):
            return
        if k in self.returns or k in self.arrows:
            frame["type"], frame["angles"] = k in self.returns, 0
            return
        if frame["type"] and w in ("<", ">", ">>", ">>>"):
            frame["angles"] = max(0, frame.get("angles", 0) + (1 if w == "<" else -len(w)))
            return
        if frame["type"] and frame.get("angles") and w in (",", "=", "?", ":"):
            return
        if w in ("const", "let", "var"):
            frame["decl"], frame["type"] = True, False
        elif w == "?" and self.word(k + 1) not in (":", ".", ")", ",", ";") and not frame["type"]:
            frame["ternary"] = frame.get("ternary", 0) + 1
        elif w == ":":
            if frame.get("ternary"):
                frame["ternary"], frame["else"] = frame["ternary"] - 1, k
            elif self.typed:
                annotates = frame["role"] in ("params", "class", "interface") or frame["decl"] or frame["role"] == "head"
                returns = self.word(k - 1) == ")" and frame["role"] in ("block", "class", "interface", "object", "arguments", "paren")
                frame["type"] = annotates or returns and self._returns(k)
        elif self.typed and w in ("as", "satisfies", "implements", "is", "keyof") and lexical == "word" and self.kinds[k - 1] != "punct":
            frame["type"] = True
        elif self.typed and w == "type" and self.is_name(k + 1) and self.word(k + 2) in ("=", "<"):
            frame["alias"] = True
        elif w == "=":
            frame["type"] = bool(frame.pop("alias", False))
            frame["decl"] = False
        elif frame["role"] == "type":  # brackets of a type hold nothing else
            return
        elif w in (";", ",", "=>", "}") and not (w == "=>" and frame["type"]):
            frame["type"] = False
            if w == ";":
                frame["decl"], frame["ternary"] = False, 0
        elif frame["type"] and self._line_breaks(k - 1) and lexical == "word" and frame["role"] in ("block", "class"):
            frame["type"] = False

    def _returns(self, k: int) -> bool:
        open_paren = self.partner[k - 1]
        return open_paren is not None and (self._arrow_params(open_paren) or self._declares(open_paren))

    def _declares(self, open_paren: int) -> bool:
        j = open_paren - 1
        if self.word(j) == ">":  # type parameters
            while j > 0 and self.word(j) != "<":
                j -= 1
            j -= 1
        return self.word(j) == "function" or self.word(j - 1) in ("function", "*") or self.kinds[j : j + 1] == ["word"]

    def _classify(self, k: int, lexical: str, w: str, frame: dict) -> tuple[str, str, bool]:
        """(node kind, class, named) of one piece."""
        simple = {
            "string": ("string", "str", True),
            "template": ("template_string", "str", True),
            "number": ("number", "num", True),
            "private": ("private_property_identifier", "other", True),
            "pattern": ("regex_pattern", "other", True),
            "flags": ("regex_flags", "other", True),
            "jsx_text": ("jsx_text", "other", True),
            "jsx_entity": ("html_character_reference", "other", True),
            "jsx_name": ("identifier", "ident", True),
            "jsx_property": ("property_identifier", "prop", True),
            "jsx_attribute": ("property_identifier", "prop", True),
        }
        if lexical in simple:
            return simple[lexical]
        if lexical != "word":
            return w, "symbol", False
        before, after = self.word(k - 1), self.word(k + 1)
        role = frame["role"]
        if before in (".", "?.") and self.kinds[k - 1] == "punct":
            return ("type_identifier", "other", True) if frame["type"] else ("property_identifier", "prop", True)
        if role in ("object", "class", "interface", "enum") and not frame["type"] and self._member_start(k, frame):
            if w in MODIFIERS and after not in ("(", "=", ";", ":", "?", "!", "<", ",", "}"):
                return w, "symbol", False
            if role != "object":
                return "property_identifier", "prop", True
            if after in (":", "(", "<", "?"):
                return "property_identifier", "prop", True
            if after in (",", "}", "=") and w not in KEYWORDS:
                shorthand = "shorthand_property_identifier"
                return (f"{shorthand}_pattern", "other", True) if self._is_pattern(frame) else (shorthand, "prop", True)
        if w in VALUES:
            kind = {"bool": w}.get(VALUES[w], w)
            return kind, VALUES[w], True
        if self.typed and (frame["type"] or self._names_type(k)):
            if w in TYPES or w == "void":
                return w, {"number": "num", "string": "str"}.get(w, "symbol"), False
            if w not in KEYWORDS and w not in ("keyof", "infer", "is", "asserts", "readonly", "unique", "as"):
                return "type_identifier", "other", True
        if w in KEYWORDS:
            if w == "async" and after in (")", ",", ";", "=", "."):
                return "identifier", "ident", True
            return w, "symbol", False
        if w in CONTEXTUAL and self._is_contextual(k, before, after):
            return w, "symbol", False
        if after == ":" and before in (";", "{", "}", "") and role == "block" and not frame["decl"]:
            return "statement_identifier", "other", True
        if before in ("break", "continue") and not self._line_breaks(k - 1):
            return "statement_identifier", "other", True
        return "identifier", "ident", True

    def _is_pattern(self, frame: dict) -> bool:
        """Whether an object's braces take values apart instead of building one."""
        at = frame["at"]
        before = self.word(at - 1)
        if before in ("const", "let", "var"):
            return True
        close = self.partner[at]
        after = self.word(close + 1) if close is not None else ""
        if after == "=" or after == "of":
            return True
        outer = self._enclosing(at)
        return before in ("(", ",", "...") and outer is not None and self.words[outer] == "(" and (self._arrow_params(outer) or self._declares_params(outer))

    def _declares_params(self, open_paren: int) -> bool:
        close = self.partner[open_paren]
        return close is not None and self.word(close + 1) == "{" and self.word(open_paren - 1) not in ("if", "while", "for", "switch", "with")

    def _enclosing(self, k: int) -> int | None:
        j = k - 1
        while j >= 0:
            if self.kinds[j] == "punct" and self.words[j] in (")", "]", "}") and self.partner[j] is not None:
                j = self.partner[j]
            elif self.kinds[j] == "punct" and self.words[j] in ("(", "[", "{"):
                return j
            j -= 1
        return None

    def _names_type(self, k: int) -> bool:
        """Names of declared types, and of types in angle brackets."""
        before = self.word(k - 1)
        if before in ("class", "interface", "implements") or before == "type" and self.word(k + 1) in ("=", "<"):
            return True
        if before == "<" and self.kinds[k - 2 : k - 1] == ["word"] and k >= 2:
            return self.generic_end(k - 1) > k - 1 and self.word(self.generic_end(k - 1)) in ("(", ")", "{", ";", ",", "=", ">", "[", "extends", "implements", "")
        return False

    def _is_contextual(self, k: int, before: str, after: str) -> bool:
        w = self.words[k]
        if w == "of":
            return self.is_name(k - 1) or before in ("]", "}")
        if w == "from":
            return before in ("}", "*") or self.kinds[k + 1 : k + 2] == ["string"]
        if w in ("as", "satisfies"):
            return k > 0 and (self.kinds[k - 1] != "punct" or before in (")", "]", "}", "*")) and (self.is_name(k + 1) or after in ("{", "[", "("))
        if w in ("type", "interface", "namespace", "module", "declare", "abstract", "global"):
            return (self.is_name(k + 1) or w == "declare" or w == "type" and after == "{" and before in ("import", "export")) and self.word(k + 1) not in ("in", "of", "instanceof")
        if w == "implements":
            return self.is_name(k + 1)
        return False


def scan(text: str, language: str) -> list[Lexeme]:
    """Lexemes of a source text; an empty text is one empty leaf, its root."""
    return _Scanner(text, language).scan() or [Lexeme(0, 0, "", "program", "other", True)]


def scan_jsx(text: str, language: str) -> list[Lexeme]:
    """The same for files whose expressions may be elements."""
    return _Scanner(text, language, True).scan() or [Lexeme(0, 0, "", "program", "other", True)]
