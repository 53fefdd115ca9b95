"""Source and configuration text as name-literal pairs, with constants propagated.

``pairs`` reads a text of any language once: names, quoted strings, operators. What an assignment (``name = ...``,
``name: ...``, ``"name": ...``, ``name := ...``, ``name => ...``, ``obj["name"] = ...``, a type in between or not), a
comparison, an option (``--name value``), a definition (``#define name ...``), a call with a key (``set("name", ...)``),
an element (``<name>...</name>``), a key beside a value (``name: X`` / ``value: ...``) or the user part of an address
gives to a name is its value: alternatives of pieces, where a piece is a literal with its place in the text or a
reference to another name (plain, or ``${name}`` and its like inside a string). A plain word that no assignment explains
is a literal only if it has a digit. References take what the name held at
that point, else what it holds at the end of the text; chains are followed, circles end. Pieces put together give one
literal that keeps the places of all its parts.

Every step looks at a character a bounded number of times: a quote that is not closed makes further quotes of its kind
on that line ordinary characters, so no line is searched for a closing quote twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""(?P<l>\n)|(?P<b>[^\S\n]+)|(?P<n>[A-Za-z_$][A-Za-z0-9_$]*(?:-[A-Za-z0-9_$]+)*)|(?P<d>[0-9][A-Za-z0-9_]*)
|(?P<o>:=|=>|->|::|===|==|!==|!=|<=|>=|\|\||\?\?|&&|\+=|--|[=:+.?|&])|(?P<q>["'`])|(?P<p>[^\n])""", re.X)
_STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\[\s\S])*+){q}") for q in "\"'`"}
_BARE = re.compile(r"""(?:\$\{[^{}\n]*\}|\{\{[^{}\n]*\}\}|[^\s,;'"`(){}\[\]<>])+""")
_REFERENCE = re.compile(r"\$\{\s*([\w.]+)[^{}]*\}|\{\{\s*([\w.]+)\s*\}\}|#\{\s*([\w.]+)\s*\}|%\(([\w.]+)\)s|\$([A-Za-z_]\w*)")
_BRACED = re.compile(r"\{\s*([A-Za-z_][\w.]*)[^{}]*\}")
_ADDRESS = re.compile(r"://[^\s:/@'\"]++:([^\s:/@'\"]++)@")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>\n]*+)</\1\s*>")
_ASSIGN, _COMPARE = {"=", ":=", "=>", ":", "+="}, {"==", "===", "!=", "!=="}
_JOIN, _ELSE = {"+", ".", "&"}, {"||", "??", "or", "?", ":"}
#: Calls whose first argument names a place where the value is kept, and names of keys and of values.
_FETCH = {"getenv", "get", "env", "fetch", "lookup", "require", "prompt", "input", "getproperty", "getattr", "secret_from", "var"}
_KEY_NAMES, _VALUE_NAMES = {"key", "name", "id", "param"}, {"value", "content", "default", "val"}


@dataclass
class Piece:
    """A literal at start..end, or (``name`` given) a reference."""

    start: int
    end: int
    text: str
    name: str | None = None


@dataclass
class Pair:
    """``name`` is given ``text``, put together from the literals at ``spans``; ``hops`` names were followed."""

    name: str
    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    hops: int = 0


@dataclass
class _Token:
    kind: str
    start: int
    end: int
    text: str
    spaced: bool = False  # blanks before it
    template: bool = False


def tokens(text: str) -> list[_Token]:
    """Names (n), numbers (d), strings (s, places without the quotes), operators (o), newlines (l), the rest (p)."""
    out: list[_Token] = []
    closed = dict.fromkeys("\"'`", 0)  # up to here no quote of this kind opens a string
    at, n, spaced = 0, len(text), False
    while at < n:
        m = _TOKEN.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "b":
            spaced = True
            continue
        start, value, template = m.start(), m.group(), False
        if kind == "q":
            q = value
            kind = "p"
            after_word = bool(out) and not spaced and out[-1].kind in "nd" and out[-1].end == start
            prefix = out[-1].text.lower() if after_word else ""
            if start >= closed[q] and (not after_word or q != "'" or prefix in {"f", "b", "r", "u", "rb", "br", "fr", "rf", "l"}):
                if text.startswith(q * 3, start) and q != "`":
                    end = text.find(q * 3, start + 3)
                    found = (start + 3, end, end + 3) if end >= 0 else None
                    if found is None:
                        closed[q] = n
                else:
                    s = _STRING[q].match(text, start)
                    found = (start + 1, s.end() - 1, s.end()) if s else None
                    if found is None:
                        line = text.find("\n", start)
                        closed[q] = line if line >= 0 else n
                if found:
                    kind, start, value, template = "s", found[0], text[found[0]:found[1]], q == "`" or "f" in prefix
                    if prefix in {"f", "b", "r", "u", "rb", "br", "fr", "rf", "l"}:
                        out.pop()
                    out.append(_Token("s", found[0], found[1], value, spaced, template))
                    at, spaced = found[2], False
                    continue
        out.append(_Token(kind, start, at, value, spaced, template))
        spaced = False
    return out


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens = text, tokens(text)
        self.given: list[tuple[str, list[list[Piece]]]] = []  # (name, alternatives)
        self.held: dict[str, int] = {}  # the last assignment to a name so far
        self.deep, self.closing, open_ = 0, {}, []
        for i, t in enumerate(self.tokens):
            if t.kind == "p" and t.text in "([{":
                open_.append(i)
            elif t.kind == "p" and t.text in ")]}" and open_:
                self.closing[open_.pop()] = i
        self.seen: list[dict[str, int]] = []  # for each assignment, what its references held then

    def token(self, i: int) -> _Token | None:
        return self.tokens[i] if 0 <= i < len(self.tokens) else None

    def target(self, i: int) -> str | None:
        """The name that stands before token i."""
        while (t := self.token(i - 1)) and t.kind == "p" and t.text in "?!":  # optional fields
            i -= 1
        if t is None:
            return None
        if t.kind == "s":
            return t.text if re.fullmatch(r"[\w .:/-]+", t.text) else None
        if t.kind == "p" and t.text == "]":
            key = self.token(i - 2)
            return key.text if key and key.kind == "s" else None
        if t.kind != "n":
            return None
        name, k = t.text, i - 2
        while (dot := self.token(k)) and dot.kind == "o" and dot.text in {".", "->", "::"} and (base := self.token(k - 1)) and base.kind == "n":
            name, k = f"{base.text}.{name}", k - 2
        return name

    def literal(self, t: _Token) -> list[Piece]:
        """A string as literals and the references inside it."""
        refs = [*_REFERENCE.finditer(t.text), *(_BRACED.finditer(t.text) if t.template else [])]
        out, at = [], 0
        for m in sorted(refs, key=lambda m: m.start()):
            if m.start() < at:
                continue
            if m.start() > at:
                out.append(Piece(t.start + at, t.start + m.start(), t.text[at:m.start()]))
            out.append(Piece(t.start + m.start(), t.start + m.end(), m.group(), next(g for g in m.groups() if g)))
            at = m.end()
        if at < len(t.text) or not t.text:
            out.append(Piece(t.start + at, t.end, t.text[at:]))
        return out

    def bare(self, i: int) -> tuple[list[Piece], int]:
        """An unquoted value that begins with token i, and the token after it."""
        t = self.tokens[i]
        m = _BARE.match(self.text, t.start)
        if not m:
            return [], i + 1
        value = m.group()
        j = i
        while (u := self.token(j)) and u.start < m.end():
            j += 1
        if re.fullmatch(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*", value) and not value.startswith("$"):
            return [Piece(t.start, m.end(), value, value.replace("->", ".").replace("::", "."))], j
        return self.literal(_Token("s", m.start(), m.end(), value)), j

    def call(self, i: int, called: str) -> tuple[list[list[Piece]], int]:
        """The literals among the arguments that begin at token i (after the bracket), and the token after the last."""
        skip = called.rsplit(".", 1)[-1].lower() in _FETCH
        out: list[list[Piece]] = []
        argument = depth = 0
        deep = i >= self.deep  # calls within a call that was read already are read without what is nested in them
        while t := self.token(i):
            self.deep = max(self.deep, i) if deep else self.deep
            if t.kind == "p" and t.text in "([{":
                if not deep:
                    i = self.closing.get(i, len(self.tokens)) + 1
                    continue
                depth += 1
            elif t.kind == "p" and t.text in ")]}":
                if not depth:
                    return out, i + 1
                depth -= 1
            elif t.kind == "p" and t.text in ",;":
                argument += not depth
                if t.text == ";":
                    return out, i
            elif t.kind == "l" and not depth and not out and argument == 0 and (b := self.token(i + 1)) and b.kind == "l":
                return out, i
            elif t.kind == "s" and not (skip and argument == 0):
                out.append(self.literal(t))
            elif t.kind == "n" and t.text in self.held:
                out.append([Piece(t.start, t.end, t.text, t.text)])
            i += 1
        return out, i

    def value(self, i: int) -> tuple[list[list[Piece]], int]:
        """The alternatives of the expression that begins at token i, and the token after it."""
        out: list[list[Piece]] = []
        pieces: list[Piece] = []
        want, choices = True, 0  # an operand comes next; "?" that wait for ":"
        while t := self.token(i):
            if t.kind == "s":
                pieces += self.literal(t)
                want, i = False, i + 1
            elif t.kind == "o" and t.text in _JOIN and not want:
                want, i = True, i + 1
            elif not want and (t.text in _ELSE and t.kind in "on"):
                if t.text == ":" and not choices:
                    break  # what was read is a key
                choices += (t.text == "?") - (t.text == ":")
                out.append(pieces)
                pieces, want, i = [], True, i + 1
            elif want and t.kind == "p" and t.text == "(":
                i += 1
            elif want and t.kind == "n":
                after = self.token(i + 1)
                name, j = t.text, i + 1
                while after and after.kind == "o" and after.text in {".", "->", "::"} and (part := self.token(j + 1)) and part.kind == "n":
                    name, j = f"{name}.{part.text}", j + 2
                    after = self.token(j)
                if after and after.kind == "p" and after.text == "(" and not after.spaced:
                    found, i = self.call(j + 1, name)
                    out += found[1:]
                    pieces += found[0] if found else []
                elif t.text in {"new", "await", "return", "not", "String", "const"} and after and after.kind in "ns":
                    i += 1
                    continue
                else:
                    found, i = self.bare(i)
                    pieces += found
                want = False
            elif want and t.kind in "dop" and t.text not in ",;)]}" and (t.kind != "p" or t.text not in "([{<"):
                found, i = self.bare(i)
                pieces += found
                want = False
                if not found:
                    break
            elif want and t.kind == "l" and pieces:  # the line goes on after an operator
                i += 1
            else:
                break
        if pieces:
            out.append(pieces)
        return out, i

    def note(self, name: str, alternatives: list[list[Piece]]) -> None:
        refs = {p.name for a in alternatives for p in a if p.name}
        self.seen.append({r: self.held[r] for r in refs if r in self.held})
        self.given.append((name, alternatives))

    def give(self, name: str, alternatives: list[list[Piece]]) -> None:
        if not alternatives:
            return
        self.note(name, alternatives)
        self.held[name] = self.held[name.rsplit(".", 1)[-1]] = len(self.given) - 1

    def read(self) -> None:
        typed: tuple[str, int] | None = None  # name: type = value
        key: tuple[str, int] | None = None  # the key that a value beside it belongs to
        i, line = 0, 0
        while t := self.token(i):
            step = i + 1
            if t.kind == "l":
                line += 1
            elif t.kind == "o" and t.text in _ASSIGN | _COMPARE:
                name = self.target(i)
                if t.text == "=" and typed and typed[1] == line:
                    name = typed[0]
                after, first = self.token(i + 1), i + 1
                if after and after.kind == "l" and t.text not in _COMPARE and (s := self.token(i + 2)) and s.kind == "s":
                    after, first = s, i + 2
                if name and not (t.text == ":" and self.text.startswith("//", t.end)) and after and after.kind != "l":
                    found, end = self.value(first)
                    step = max(step, end)
                    short = name.rsplit(".", 1)[-1].lower()
                    typed = (name, line) if t.text == ":" and found and found[-1][-1].name else None
                    plain = found[0][0].text if found and len(found[0]) == 1 else None
                    if short in _KEY_NAMES and plain:
                        key = (plain, line)
                    elif short in _VALUE_NAMES and key and line - key[1] <= 1:
                        name = key[0]
                    if t.text in _COMPARE:
                        if found:
                            self.note(name, found)
                    else:
                        self.give(name, found)
            elif t.kind == "o" and t.text == "--" and (n := self.token(i + 1)) and n.kind == "n" and not n.spaced:
                after = self.token(i + 2)
                if after and after.spaced and after.kind in "snd":
                    self.give(n.text, [self.literal(after)] if after.kind == "s" else [self.bare(i + 2)[0]])
            elif t.kind == "n" and t.text == "define" and (n := self.token(i + 1)) and n.kind == "n":
                self.give(n.text, self.value(i + 2)[0])
            elif t.kind == "p" and t.text == "(" and (k := self.token(i + 1)) and k.kind == "s" and (c := self.token(i + 2)) \
                    and c.text == "," and (v := self.token(i + 3)) and v.kind in "sn":
                called = self.token(i - 1)
                if called and called.kind == "n" and re.fullmatch(r"[\w.-]+", k.text):
                    self.give(k.text, self.value(i + 3)[0])
            i = step
        for m in _ELEMENT.finditer(self.text):
            value = m.group(2).strip()
            at = m.start(2) + m.group(2).find(value)
            self.give(m.group(1), [[Piece(at, at + len(value), value)]] if value else [])
        for m in _ADDRESS.finditer(self.text):
            self.give("password", [[Piece(m.start(1), m.end(1), m.group(1))]])

    def resolved(self, k: int) -> list[Pair]:
        """What the assignment ``k`` gives its name, references followed without recursion."""
        name, alternatives = self.given[k]
        out = []
        for pieces in alternatives:
            text, spans, hops, used = [], [], 0, {k}
            stack = [(p, k) for p in reversed(pieces)]
            while stack:
                piece, by = stack.pop()
                source = None
                if piece.name:
                    short = piece.name.rsplit(".", 1)[-1]
                    source = self.seen[by].get(piece.name, self.held.get(piece.name, self.held.get(short)))
                if source is not None and source not in used:
                    used.add(source)
                    hops += 1
                    stack += [(p, source) for p in reversed(self.given[source][1][-1])]
                elif source is None and (not piece.name or piece.text == piece.name and re.search("[0-9]", piece.text)):
                    text.append(piece.text)
                    if piece.text:
                        spans.append((piece.start, piece.end))
            if spans:
                out.append(Pair(name, "".join(text), spans, hops))
        return out


def pairs(text: str, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[Pair]:
    """The name-literal pairs of a text whose name is ``wanted``, constants propagated.

    Following references costs a step for each piece a name is made of in the end, for each wanted assignment.
    """
    reader = _Reader(text)
    reader.read()
    return (p for k, (name, _) in enumerate(reader.given) if wanted(name) for p in reader.resolved(k))
