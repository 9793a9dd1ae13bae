"""Character-level work on program text, without Spark: masking, tokens, literals, conditional compilation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, NamedTuple

PAIRS = {"[": "]", "(": ")", "{": "}", "<": ">"}
_Q = re.compile(r"[nN]?[qQ]'(.)", re.S)


def q_end(text: str, at: int) -> int:
    """End of the q-quoted literal that starts at ``at``, or -1 if none does."""
    m = _Q.match(text, at)
    if not m or m[1].isspace():
        return -1
    close = PAIRS.get(m[1], m[1]) + "'"
    end = text.find(close, m.end())
    return len(text) if end < 0 else end + 2


def quote_end(text: str, at: int) -> int:
    """End of the literal whose opening quote is at ``at``; two quotes inside stand for one."""
    i = at + 1
    while True:
        i = text.find("'", i)
        if i < 0:
            return len(text)
        if text[i + 1 : i + 2] != "'":
            return i + 1
        i += 2


def blank(s: str) -> str:
    return re.sub(r"[^\r\n]", " ", s)


def mask(text: str | None) -> str | None:
    """A copy of the same length without comments, q-quoted literals and what stands inside other literals."""
    if text is None:
        return None
    out, last = [], 0
    for m in re.finditer(r"--|/\*|'|[nN]?[qQ]'", text):
        i = m.start()
        if i < last:
            continue
        if m[0] == "--":
            end = next((k for k in range(i, len(text)) if text[k] in "\r\n"), len(text))
            piece = blank(text[i:end])
        elif m[0] == "/*":
            end = text.find("*/", i + 2)
            end = len(text) if end < 0 else end + 2
            piece = blank(text[i:end])
        elif m[0] == "'" or (i and (text[i - 1].isalnum() or text[i - 1] in "_$#")) or q_end(text, i) < 0:
            i = m.end() - 1
            end = quote_end(text, i)
            closed = end - 1 > i and text[end - 1] == "'"
            piece = "'" + blank(text[i + 1 : end - closed]) + "'" * closed
        else:
            end = q_end(text, i)
            piece = blank(text[i:end])
        out += [text[last:i], piece]
        last = end
    return "".join(out) + text[last:]


class Token(NamedTuple):
    kind: str  # id, quoted, number, string, bind, op, directive
    text: str
    up: str  # keywords are compared by this: upper case for ids, the text for operators, else empty
    start: int
    end: int
    line: int


class Comment(NamedTuple):
    text: str
    start: int
    end: int
    line: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>--[^\r\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<q>[nN]?[qQ]'(?=\S))|(?P<string>[nN]?')
    |(?P<quoted>"[^"]*"?)|(?P<directive>\$\$\w+|\$(?:if|then|elsif|else|end|error)\b)|(?P<bind>:\s*(?:[^\W\d]\w*|\d+|"[^"]*"))
    |(?P<number>(?:\d+(?:\.(?!\.)\d*)?|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?)|(?P<id>[^\W\d_][\w$#]*)
    |(?P<op>:=|=>|\.\.|\*\*|\|\||<>|!=|~=|\^=|<=|>=|<<|>>|\(\+\)|.)""",
    re.X | re.S | re.I,
)


def tokens(text: str) -> tuple[list[Token], list[Comment]]:
    out, comments, line, i = [], [], 1, 0
    n = len(text)
    while i < n:
        m = _TOKEN.match(text, i)
        kind, end = m.lastgroup, m.end()
        if kind == "q":
            end = q_end(text, i)
            kind = "string"
        elif kind == "string":
            end = quote_end(text, end - 1)
        s = text[i:end]
        if kind in ("line", "block"):
            comments.append(Comment(s, i, end, line))
        elif kind == "id":
            if s.upper() == "REM" and not text[text.rfind("\n", 0, i) + 1 : i].strip():
                end = text.find("\n", i)
                end = n if end < 0 else end
                comments.append(Comment(text[i:end], i, end, line))
                s = text[i:end]
            else:
                out.append(Token("id", s, s.upper(), i, end, line))
        elif kind != "space":
            out.append(Token(kind, s, s if kind == "op" else s.lower() if kind == "directive" else "", i, end, line))
        line += s.count("\n")
        i = end
    return out, comments


def literal(s: str) -> str:
    """The value of a string literal."""
    if s[:1] in "nN":
        s = s[1:]
    if s[:2].lower() == "q'":
        return s[3:-2]
    return s[1 : -1 if len(s) > 1 and s.endswith("'") else None].replace("''", "'")


# --- conditional compilation -------------------------------------------------------------------------------------

#: The database version that conditions are decided for, and the highest release that VER_LE names are known for.
TARGET = (19, 0)
_DIRECTIVE = re.compile(r"\$(if|then|elsif|else|end|error)\b", re.I)
_ATOM = re.compile(r"\s*(?:(<=|>=|<>|!=|=|<|>|\(|\))|('(?:[^']|'')*')|(\d+(?:\.\d+)?)|(\$\$\w+|[A-Za-z_][\w$#.]*))")


@dataclass
class Condition:
    line: int
    text: str
    decided: bool
    value: bool | None


@dataclass
class Variant:
    name: str
    text: str
    conditions: list[Condition]
    issues: list[tuple[int, str]]


def parse_flag(item: str) -> tuple[str, Any]:
    """``name`` or ``name=value`` to a lower-case name and a typed value: true alone, booleans, numbers, else text."""
    name, eq, value = item.partition("=")
    value = value.strip()
    if not eq or value.lower() in ("true", "false"):
        typed: Any = not eq or value.lower() == "true"
    elif re.fullmatch(r"-?\d+(\.\d+)?", value):
        typed = float(value)
    else:
        typed = value
    return name.strip().lower(), typed


class _Eval:
    """Three-valued conditions. NOT binds to the next operand; names that nobody defined are ``default``."""

    def __init__(self, text: str, flags: dict[str, Any], default: Any):
        self.known, self.flags, self.default, self.items, at = True, flags, default, [], 0
        text = text.strip()
        while at < len(text):
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError(text)
            self.items.append(m[0].strip())
            at = m.end()
        self.i = 0

    def word(self, *words: str) -> bool:
        if self.i < len(self.items) and self.items[self.i].lower() in words:
            self.i += 1
            return True
        return False

    def whole(self) -> Any:
        v = self.either()
        if self.i != len(self.items):
            raise ValueError("rest")
        return v

    def either(self) -> Any:
        v = self.both()
        while self.word("or"):
            w = self.both()
            v = True if v is True or w is True else False if v is False and w is False else None
        return v

    def both(self) -> Any:
        v = self.test()
        while self.word("and"):
            w = self.test()
            v = False if v is False or w is False else True if v is True and w is True else None
        return v

    def test(self) -> Any:
        v = self.atom()
        if self.word("is"):
            negated = self.word("not")
            if not self.word("null"):
                raise ValueError("is")
            return (v is not None) if negated else v is None
        for op in ("<=", ">=", "<>", "!=", "=", "<", ">"):
            if self.word(op):
                w = self.atom()
                if v is None or w is None:
                    return None
                if op in ("=", "<>", "!="):
                    return (v == w) == (op == "=")
                if type(v) is not type(w):
                    return None
                return {"<": v < w, ">": v > w, "<=": v <= w, ">=": v >= w}[op]
        return v

    def atom(self) -> Any:
        if self.word("not"):
            v = self.atom()
            return None if v is None else not v
        if self.word("("):
            v = self.either()
            if not self.word(")"):
                raise ValueError("parenthesis")
            return v
        if self.i >= len(self.items):
            raise ValueError("end")
        item = self.items[self.i]
        self.i += 1
        low = item.lower()
        if item[0] == "'":
            return literal(item)
        if item[0].isdigit():
            return float(item)
        if low in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[low]
        if m := re.fullmatch(r"(?:sys\.)?dbms_db_version\.(?:ver_le_(\d+)(?:_(\d+))?|(version|release))", low):
            if m[3]:
                return float(TARGET[m[3] == "release"])
            return TARGET <= (int(m[1]), int(m[2]) if m[2] else 99)
        if low.startswith("$$") and low[2:] in self.flags:
            return self.flags[low[2:]]
        self.known = False
        return self.default


def evaluate(text: str, flags: dict[str, Any] | None = None, default: Any = None) -> tuple[bool | None, bool]:
    """(value, whether every name in it was known). What cannot be read is unknown."""
    try:
        e = _Eval(text, flags or {}, default)
        v = e.whole()
        return (v if isinstance(v, bool) else None), e.known
    except ValueError:
        return None, False


def variants(text: str, flags: dict[str, Any] | None = None) -> list[Variant]:
    """One variant of a text, or two where a condition depends on an unknown name.

    In ``primary`` unknown names are null, in ``alternate`` true. Left-out text and directives become blanks, so lines
    and offsets stay. ``$error`` takes its own ``$end``; a stray ``$else``, ``$elsif`` or ``$end`` is an issue.
    """
    flags = flags or {}
    if "$" not in text:
        return [Variant("primary", text, [], [])]
    masked = mask(text)
    marks = list(_DIRECTIVE.finditer(masked))
    if not marks:
        return [Variant("primary", text, [], [])]
    first = _branch(text, masked, marks, flags, None, "primary")
    if all(c.decided for c in first.conditions):
        return [first]
    return [first, _branch(text, masked, marks, flags, True, "alternate")]


def _branch(text, masked, marks, flags, default, name) -> Variant:
    out, conditions, issues = [], [], []
    frames: list[list[bool]] = []  # of each open $if: whether the text now counts, whether a branch was taken
    line_of = lambda at: text.count("\n", 0, at) + 1
    on = lambda: all(f[0] for f in frames)
    at, k = 0, 0
    while k < len(marks):
        m = marks[k]
        if m.start() < at:
            k += 1
            continue
        out.append(text[at : m.start()] if on() else blank(text[at : m.start()]))
        word, end = m[1].lower(), m.end()
        if word in ("if", "elsif"):
            then = next((x for x in marks[k + 1 :] if x[1].lower() == "then"), None)
            end = then.end() if then else len(text)
            said = text[m.end() : then.start() if then else len(text)]
            outer = all(f[0] for f in frames) if word == "if" else all(f[0] for f in frames[:-1])
            value, known = evaluate(masked_condition(said), flags, default)
            if word == "elsif" and not frames:
                issues.append((line_of(m.start()), "$elsif without $if"))
            else:
                taken = False if word == "if" else frames[-1][1]
                if outer and not taken:
                    conditions.append(Condition(line_of(m.start()), " ".join(said.split()), known, value))
                if word == "if":
                    frames.append([value is True, value is True])
                else:
                    frames[-1] = [value is True and not taken, taken or value is True]
        elif word == "else":
            if frames:
                frames[-1] = [not frames[-1][1], True]
            else:
                issues.append((line_of(m.start()), "$else without $if"))
        elif word == "end":
            if frames:
                frames.pop()
            else:
                issues.append((line_of(m.start()), "$end without $if"))
        elif word == "error":
            stop = next((x for x in marks[k + 1 :] if x[1].lower() == "end"), None)
            end = stop.end() if stop else len(text)
            if on():
                issues.append((line_of(m.start()), "$error is reached"))
        out.append(blank(text[m.start() : end]))
        at = end
        k += 1
    out.append(text[at:] if on() else blank(text[at:]))
    if frames:
        issues.append((line_of(len(text)), "$if without $end"))
    return Variant(name, "".join(out), conditions, issues)


def masked_condition(text: str) -> str:
    return re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
