"""Syntax trees of code in languages with braces: tokens, bracket groups, and the declarations, blocks and calls in them.

A text becomes tokens, tokens become groups by their brackets, and a reader goes over each group once. It knows how declarations, control flow and calls begin and
where they end; expressions are told apart only as far as that needs. A text whose brackets don't match still has a tree: what is left open ends
with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

SCRIPTS = frozenset(["javascript", "typescript", "tsx"])
_word = r"(?P<word>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*)"
_rest = rf"""|{_word}|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<mark>=>|::|->|\.\.\.|\?\.|\+\+|--|&&|\|\||\?\?|[=!<>]=+|[-+*/%&|^]=|[^\s\w])|(?P<line>\n)"""
_comment = r"(?P<skip>//[^\n]*|/\*(?s:.)*?(?:\*/|\Z))"


def _token(kinds: str) -> re.Pattern[str]:
    """A token with the blanks behind it, which so need no match of their own; or blanks alone."""
    return re.compile(rf"(?:{kinds})[^\S\n]*|[^\S\n]+")


#: Of each family of languages what hides its content: comments, strings and characters; a quote that stays open on its line hides nothing.
TOKENS = {
    "script": _token(_comment + r"""|(?P<text>"(?:\\(?s:.)|[^"\\\n])*"|'(?:\\(?s:.)|[^'\\\n])*')""" + _rest),
    "go": _token(_comment + r"""|(?P<text>"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\[^'\n]+|[^'\\\n])')""" + _rest),
    "rust": _token(r"""(?P<skip>//[^\n]*)|(?P<deep>/\*)|(?P<raw>b?r\#*")|(?P<text>b?"(?:\\(?s:.)|[^"\\])*"|b?'(?:\\[^'\n]+|[^'\\\n])')|'\w+""" + _rest),
    "java": _token(_comment + r'''|(?P<text>"""(?s:.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\[^'\n]+|[^'\\\n])')''' + _rest),
}
PATTERN = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n]){0,500}\]|[^/\\\[\n]){1,2000}/[a-z]*")
CLOSING = {"(": ")", "[": "]", "{": "}"}
CLOSERS = frozenset(CLOSING.values())
#: After these a line doesn't end the statement, and, but for a mark that opens or closes an element, a slash begins a pattern.
OPEN_ENDED = frozenset("( [ { , ; : ? . ?. = => ! ~ + - * / % & | ^ < && || ?? == === != !== <= >= += -= *= /= %= |= &= ^= return typeof case in of instanceof new delete throw await yield extends implements else do as".split())
#: Before these a line doesn't end the statement either.
GOES_ON = frozenset(". ?. , ? : = => + - * / % & | ^ < > && || ?? == === != !== <= >= += -= ( [ in instanceof as satisfies extends implements".split())
#: Of each family the words that no call begins with.
NO_CALL = {
    "script": frozenset("if for while switch catch return typeof new await async function else do throw in of delete void yield case with let const var".split()),
    "go": frozenset("if for switch select return func go defer range case map chan interface struct else var const type".split()),
    "rust": frozenset("if while for match loop return fn unsafe move impl where dyn as in let mut ref else async await pub".split()),
    "java": frozenset("if for while switch catch return new else do throw synchronized assert case try yield".split()),
}
MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp sealed readonly override async get set declare accessor pub const unsafe extern transient volatile".split())
_before = MODIFIERS | {"export"}
#: How deep brackets may be nested; texts beyond have no tree.
DEEPEST = 150


class Token:
    __slots__ = ("kind", "text", "line", "at", "end", "last", "items")

    def __init__(self, kind: str, text: str, line: int, at: int, end: int = 0, last: int = 0) -> None:
        self.kind = kind  # word, number, text, mark, or group
        self.text, self.line, self.at, self.end = text, line, at, end
        self.last = last  # the line in which it ends
        self.items: Sequence[Token] = ()  # a group's only


@dataclass(slots=True)
class Node:
    kind: str
    name: str
    line: int
    last: int
    at: int
    end: int
    params: int = 0
    exported: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def tokens(text: str, language: str) -> Iterator[Token]:
    """The tokens of a text, lines from 0. Templates are tokens for each stretch of text, with the code of their holes between brackets."""
    script = language in SCRIPTS
    match, total = TOKENS["script" if script else language].match, len(text)
    at, line, holes, before, unclosed = 0, 0, [], "", set()
    while at < total:
        if script:
            c = text[at]
            if c == "`" or c == "}" and holes and holes[-1] == 0:
                if c == "}":
                    holes.pop()
                    yield Token("mark", ")", line, at, at + 1, line)
                begin, first = at, line
                at += 1
                while at < total and text[at] != "`" and not text.startswith("${", at):
                    line += text[at] == "\n"
                    at += 2 if text[at] == "\\" else 1
                hole = text.startswith("${", at)
                yield Token("text", text[begin : at + 1], first, begin, min(at + 1, total), line)
                at, before = at + 1 + hole, "`"
                if hole:
                    holes.append(0)
                    yield Token("mark", "(", line, at, at, line)
                    before = "("
                continue
            if c == "/" and (not before or before in OPEN_ENDED and before != "<") and (m := PATTERN.match(text, at)):
                yield Token("text", m[0], line, at, m.end(), line)
                at, before = m.end(), "/x/"
                continue
        m = match(text, at)
        at, kind = m.end(), m.lastgroup
        if kind == "word" or kind == "mark" or kind == "number":
            begin, end = m.span(kind)
            said = text[begin:end]
            if holes and (said == "{" or said == "}"):
                holes[-1] += 1 if said == "{" else -1
            yield Token(kind, said, line, begin, end, line)
            before = said if kind != "number" else "x"
        elif kind == "line":
            line += 1
        elif kind == "text":
            begin, end = m.span(kind)
            said, last = text[begin:end], line
            if "\n" in said:
                last += said.count("\n")
            yield Token(kind, said, line, begin, end, last)
            line, before = last, "x"
        elif kind == "skip":
            line += m[0].count("\n")
        elif kind == "raw":  # to the quote with as many marks; where none follows, it hides nothing
            begin, at = m.span(kind)
            mark = '"' + m["raw"].lstrip("br")[:-1]
            end = -1 if mark in unclosed else text.find(mark, at)
            if end < 0:
                unclosed.add(mark)
                yield Token("word", "r", line, begin, at, line)
                continue
            first, at = line, end + len(mark)
            line += text.count("\n", begin, at)
            yield Token("text", text[begin:at], first, begin, at, line)
        elif kind == "deep":  # comments inside comments
            begin, at = m.span(kind)
            open_ = 1
            while open_ and at < total:
                step = 2 if text.startswith(("/*", "*/"), at) else 1
                open_ += text.startswith("/*", at) - text.startswith("*/", at)
                at += step
            line += text.count("\n", begin, at)


def groups(text: str, language: str) -> list[Token]:
    """Tokens with those between brackets as one group; a closing bracket that fits none is left out, and one that fits an outer group ends the inner ones."""
    top: list[Token] = []
    open_: list[Token] = []
    items = top
    end, line = len(text), text.count("\n")
    for t in tokens(text, language):
        if t.kind != "mark":
            items.append(t)
        elif t.text in CLOSING:
            t.kind, t.end, t.last, t.items = "group", end, line, []
            items.append(t)
            open_.append(t)
            items = t.items
            if len(open_) > DEEPEST:
                raise RecursionError("brackets are nested too deep")
        elif t.text in CLOSERS:
            fits = next((k for k in range(len(open_) - 1, -1, -1) if CLOSING[open_[k].text] == t.text), None)
            if fits is not None:
                for g in open_[fits:]:
                    g.end, g.last = t.end, t.line
                del open_[fits:]
                items = open_[-1].items if open_ else top
        else:
            items.append(t)
    return top


class Reader:
    """Goes over the items of one group; `inside` says what they are: code, the members of a class, or types that hold no code."""

    def __init__(self, items: list[Token], language: str, inside: str = "code", bracket: str = "") -> None:
        self.items, self.language, self.inside, self.bracket, self.i, self.out = items, language, inside, bracket, 0, []
        self.script, self.typed = language in SCRIPTS, language in ("typescript", "tsx")
        self.no_call = NO_CALL["script" if self.script else language]
        self.step_word = getattr(self, f"step_{'script' if self.script else language}")

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.items) and self.items[i].text in texts and self.items[i].kind != "text"

    def group(self, i: int, bracket: str) -> bool:
        return 0 <= i < len(self.items) and self.items[i].kind == "group" and self.items[i].text == bracket

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.items) and self.items[i].kind == "word"

    def all(self) -> list[Node]:
        while self.i < len(self.items):
            self.step()
        return self.out

    def of(self, token: Token, inside: str = "code") -> list[Node]:
        return Reader(token.items, self.language, inside, token.text).all()

    def new_line(self, i: int) -> bool:
        """Whether a statement may end between items i - 1 and i, by the end of a line."""
        if not 0 < i < len(self.items):
            return True
        a, b = self.items[i - 1], self.items[i]
        if a.last == b.line or self.language in ("rust", "java"):
            return False
        return not (a.kind != "text" and a.kind != "group" and a.text in OPEN_ENDED) and (self.language == "go" or not (b.kind != "text" and b.text in GOES_ON))

    def to_end(self, stop: tuple[str, ...] = (";",)) -> None:
        """Reads on to the end of a statement or expression."""
        while self.i < len(self.items) and not self.is_(self.i, *stop):
            begin = self.i
            self.step()
            if self.i > begin and self.new_line(self.i):
                return
        if self.is_(self.i, ";") and ";" in stop:
            self.i += 1

    def angle(self, i: int) -> int:
        """The place after the type arguments that begin at i, or i."""
        depth = 0
        for k in range(i, min(len(self.items), i + 400)):
            t = self.items[k]
            if t.kind == "mark" and t.text in ("<", ">"):
                depth += 1 if t.text == "<" else -1
                if not depth:
                    return k + 1
            elif t.kind == "mark" and t.text not in (",", ".", "?", "&", "|", "::", ":", "=", "=>", "->", "+", "*", "@", "'"):
                return i
            if not depth:
                return i
        return i

    def skip_type(self, stop: tuple[str, ...], body: bool = False) -> None:
        """Over a type, to one of these marks; with `body`, a group in braces ends it too, but for one that is the type's own first part."""
        depth, begin = 0, self.i
        while self.i < len(self.items):
            t = self.items[self.i]
            if self.i > begin and self.new_line(self.i):
                return
            if depth <= 0 and (t.kind == "mark" and t.text in stop or body and t.kind == "group" and t.text == "{" and self.i > begin and not self.is_(self.i - 1, "|", "&", "=>", "keyof")):
                return
            depth += (t.kind == "mark") * ((t.text == "<") - (t.text == ">"))
            self.i += 1

    def add(self, kind: str, name: str, first: int, children: list[Node], params: int = 0) -> Node:
        last = self.items[self.i - 1]
        node = Node(kind, name, self.items[first].line, last.last, self.items[first].at, last.end, params, [], children)
        self.out.append(node)
        return node

    def within(self, read) -> list[Node]:
        """What `read` finds, apart from what was found so far."""
        held, self.out = self.out, []
        read()
        held, self.out = self.out, held
        return held

    def params(self, token: Token) -> tuple[int, list[Node]]:
        """How many parameters a group has, and what their defaults hold."""
        count, named, depth, length, found = 0, 0, 0, 0, []
        for t in [*token.items, Token("mark", ",", 0, 0)]:
            depth += (t.kind == "mark") * ((t.text == "<") - (t.text == ">"))
            if t.kind == "mark" and t.text == "," and depth <= 0:
                count, named, length = count + (length > 0), named + (length > 1), 0
            else:
                length += t.text not in ("...", "*")
        reader = Reader(token.items, self.language)
        if self.script:
            while reader.i < len(reader.items):
                if self.typed and reader.is_(reader.i, ":"):
                    reader.skip_type((",", "="))
                else:
                    reader.step()
            found = reader.out
        return (named if self.language == "go" and named else count), found

    def function(self, first: int, kind: str, name: str, at: int, ends: tuple[str, ...] = (";",)) -> bool:
        """A function whose parameters are the group at `at`: its type, and its body if it has one."""
        n, found = self.params(self.items[at])
        self.i = at + 1
        if self.script:
            if self.is_(self.i, ":"):
                self.i += 1
                self.skip_type((";", ",", "="), True)
        else:
            while self.i < len(self.items) and not self.group(self.i, "{") and not self.is_(self.i, *ends) and not (self.language == "go" and self.new_line(self.i)):
                self.i += 1
                if self.language == "go" and self.is_(self.i - 1, "interface", "struct") and self.group(self.i, "{"):
                    self.i += 1
        body = self.group(self.i, "{")
        if body:
            found += self.of(self.items[self.i])
            self.i += 1
        elif self.is_(self.i, ";"):
            self.i += 1
        if body or self.language in ("java", "go"):
            self.add(kind, name, first, found, n)
        return body

    def block(self) -> None:
        """One statement: a group in braces, or whatever stands there."""
        if self.group(self.i, "{"):
            self.out += self.of(self.items[self.i])
            self.i += 1
        elif self.script or self.language == "java":
            if self.word(self.i) and self.items[self.i].text in ("if", "for", "while", "do", "try", "switch"):
                self.step()
            else:
                self.to_end()

    def condition(self) -> None:
        if self.script or self.language == "java":
            self.i += self.is_(self.i, "await")
            if self.group(self.i, "("):
                self.out += self.of(self.items[self.i])
                self.i += 1
        else:
            while self.i < len(self.items) and not self.group(self.i, "{"):
                self.step()

    def control(self, word: str) -> None:
        first = self.i
        self.i += 1

        def read() -> None:
            if word in ("if", "for", "while"):
                self.condition()
                self.block()
                if word == "if" and self.is_(self.i, "else"):
                    self.i += 1
                    if self.is_(self.i, "if"):
                        self.control("if")
                    else:
                        self.block()
            elif word == "do":
                self.block()
                if self.is_(self.i, "while"):
                    self.i += 1
                    self.condition()
                    self.i += self.is_(self.i, ";")
            elif word == "loop":
                self.block()
            else:
                if self.group(self.i, "("):
                    self.out += self.of(self.items[self.i])
                    self.i += 1
                self.block()
                while self.is_(self.i, "catch", "finally"):
                    self.i += 1
                    self.i += self.group(self.i, "(")
                    self.block()

        self.add(word, "", first, self.within(read))

    def type_like(self, first: int, word: str, kind: str, members: str) -> None:
        """A class or what looks like one: its name, and its members in the first group in braces."""
        name = self.items[self.i].text if self.word(self.i) and self.items[self.i].text not in ("extends", "implements") else ""
        found = []
        while self.i < len(self.items) and not self.group(self.i, "{") and not self.is_(self.i, ";"):
            if self.script and self.group(self.i, "("):
                found += self.of(self.items[self.i])  # a class may extend what a call returns
            self.i += 1
        if self.group(self.i, "{"):
            found += self.of(self.items[self.i], members)
        self.i += self.i < len(self.items)
        self.add(kind, name, first, found)

    def step(self) -> None:
        """Reads what begins at the next item, and at least that."""
        if self.i >= len(self.items):
            return
        i, t = self.i, self.items[self.i]
        if self.inside == "types":
            self.i += 1
        elif t.kind == "group":
            if t.text == "(" and (end := self.arrow_after(i)):
                self.arrow(i, self.params(t)[1], end)
            else:
                self.i += 1
                self.out += self.of(t)
        elif t.kind == "word" and not self.is_(i - 1, ".", "?.") and not (self.script and self.is_(i + 1, ":") and self.is_(i - 1, ",", "{")):
            self.step_word(i, t)
        elif t.kind == "word":
            self.named(i, t)
        elif self.language == "rust" and t.text == "#" and self.group(i + 1, "["):
            self.i += 2
        elif t.text == "@" and self.word(i + 1):
            self.i += 2
            while self.is_(self.i, ".") and self.word(self.i + 1):
                self.i += 2
            if self.group(self.i, "("):
                self.out += self.of(self.items[self.i])
                self.i += 1
        self.i = max(self.i, i + 1)

    def begin(self, i: int) -> int:
        """Where a declaration begins whose word is at i: at the modifiers and annotations before it."""
        while i > 0:
            if self.word(i - 1) and self.items[i - 1].text in _before:
                i -= 1
            elif self.group(i - 1, "(") and self.is_(i - 2, "pub"):
                i -= 2
            elif self.language == "rust" and self.items[i - 1].kind == "text" and self.is_(i - 2, "extern"):
                i -= 1
            else:
                k = i - 1 - self.group(i - 1, "(")
                while self.is_(k - 1, ".") and self.word(k - 2):
                    k -= 2
                if not (self.word(k) and self.is_(k - 1, "@")):
                    return i
                i = k - 1
        return i

    def named(self, i: int, t: Token) -> None:
        """A name: that of a call if a group in parentheses follows, its type arguments between."""
        k = i + 1
        if self.is_(k, "<") and (self.typed or self.language == "java"):
            k = self.angle(k)
        elif self.language == "rust" and self.is_(k, "::") and self.is_(k + 1, "<"):
            k = self.angle(k + 1)
        elif self.language == "go" and self.group(k, "[") and self.group(k + 1, "("):
            k += 1
        k += self.script and self.is_(k, "?.")
        member = self.is_(i - 1, ".", "?.")
        if self.language == "rust" and self.is_(i + 1, "!") and i + 2 < len(self.items) and self.items[i + 2].kind == "group":
            self.i = i + 3  # a macro's arguments are tokens, not code
            return
        self.i = i + 1
        if not self.group(k, "(") or t.text in self.no_call and not member or self.created(i) or self.language == "java" and t.text in ("super", "this") and not member:
            return
        if self.language == "rust" and self.arm(k + 1):
            self.i = k + 1
            return
        path, at = [t.text], i
        while self.is_(at - 1, ".", "::", "?.") and self.word(at - 2):
            at -= 2
            path.insert(0, self.items[at].text)
        node = Node("call", ".".join(path), t.line, t.last, t.at, t.end)
        self.out += [node, *self.of(self.items[k])]
        self.i = k + 1

    def arm(self, i: int) -> bool:
        """Whether what ends before i is the pattern of a match arm."""
        for k in range(i, min(len(self.items), i + 40)):
            if self.is_(k, ",", ";", "=", "let", "return") or self.group(k, "{"):
                return False
            if self.is_(k, "=>"):
                return True
        return False

    def created(self, i: int) -> bool:
        """Whether the name at i is that of what `new` makes."""
        while self.is_(i - 1, ".") and self.word(i - 2):
            i -= 2
        return self.is_(i - 1, "new")

    def arrow_after(self, i: int) -> int:
        """The place after `=>`, if the group at i holds the parameters of an arrow function."""
        if not self.script:
            return 0
        if self.is_(i + 1, "=>"):
            return i + 2
        if self.typed and self.is_(i + 1, ":") and not self.is_(i - 1, "?"):
            held, self.i = self.i, i + 2
            self.skip_type(("=>", ",", ";", "=", ":", "?"))
            end, self.i = self.i, held
            return end + 1 if self.is_(end, "=>") else 0
        return 0

    def arrow(self, first: int, found: list[Node], at: int) -> None:
        self.i = at
        if self.group(at, "{"):
            found = found + self.of(self.items[at])
            self.i = at + 1
        else:
            found = found + self.within(lambda: self.to_end((",", ";")))
            self.i -= self.i > at and self.is_(self.i - 1, ";")
        if self.i > first:
            self.add("arrow", "", first, found)

    def member(self, i: int) -> bool:
        """Reads a method of a class or an object, if one begins at i."""
        k = i
        while self.word(k) and self.items[k].text in MODIFIERS and not self.group(k + 1, "(") and not self.is_(k + 1, "=", ":", ";", "?", "!"):
            k += 1
        k += self.is_(k, "*")
        if not (k < len(self.items) and (self.items[k].kind in ("word", "text", "number") or self.group(k, "["))):
            return False
        name = self.items[k].text if self.items[k].kind == "word" else ""
        at = k + 1 + self.is_(k + 1, "?", "!")
        if self.typed and self.is_(at, "<"):
            at = self.angle(at)
        if not self.group(at, "(") or self.inside != "class" and not self.group(at + 1, "{") and not (self.typed and self.is_(at + 1, ":")):
            return False
        self.function(i, "method", name, at)
        return True

    def step_script(self, i: int, t: Token) -> None:
        first = self.begin(i)
        key = self.bracket == "{" and (i == 0 or self.is_(i - 1, ",")) and (t.text not in self.no_call or t.text == "async")
        if self.inside == "class" or self.inside == "code" and key:
            if self.member(i):
                return
            if self.inside == "class":  # a field
                while self.word(self.i) and self.items[self.i].text in MODIFIERS and not self.is_(self.i + 1, "=", ":", ";"):
                    self.i += 1
                self.i += 1
                if self.typed and (self.is_(self.i, ":") or self.is_(self.i, "?", "!") and self.is_(self.i + 1, ":")):
                    self.skip_type(("=", ";"), False) if not self.new_line(self.i) else None
                if self.is_(self.i, "="):
                    self.inside = "code"
                    self.to_end()
                    self.inside = "class"
                return
        after = self.items[i + 1] if i + 1 < len(self.items) else None
        if t.text == "function" and after:
            k = i + 1 + self.is_(i + 1, "*")
            name = self.items[k].text if self.word(k) else ""
            k += bool(name)
            k = self.angle(k) if self.typed and self.is_(k, "<") else k
            if self.group(k, "("):
                self.function(first, "function", name, k)
            else:
                self.i += 1
        elif t.text == "class" and after and not self.is_(i + 1, ":", "=", ",", ")"):
            self.i += 1
            self.type_like(first, t.text, "class", "class")
        elif self.typed and t.text in ("interface", "enum") and self.word(i + 1):
            self.i += 1
            self.type_like(first - (t.text == "enum" and self.is_(first - 1, "const")), t.text, t.text, "types" if t.text == "interface" else "code")
        elif self.typed and t.text == "type" and self.word(i + 1) and self.is_(i + 2, "=", "<"):
            name = self.items[i + 1].text
            self.inside, self.i = "types", i + 2
            self.to_end()
            self.inside = "code"
            self.add("type", name, first, [])
        elif t.text in ("const", "let", "var") and after and not (t.text == "const" and self.is_(i + 1, "enum")):
            names, self.i = [], i + 1

            def declared() -> None:
                while self.i < len(self.items):
                    if self.word(self.i):
                        names.append(self.items[self.i].text)
                        self.i += 1
                    elif self.items[self.i].kind == "group":
                        self.step()
                    if self.typed and (self.is_(self.i, ":") or self.is_(self.i, "!")):
                        self.skip_type(("=", ";", ","))
                    if self.is_(self.i, "=", "in", "of"):
                        self.i += 1
                        self.to_end((",", ";"))
                    if not self.is_(self.i, ","):
                        break
                    self.i += 1
                self.i += self.is_(self.i, ";")

            found = self.within(declared)
            node = self.add("var" if t.text == "var" else "declaration", names[0] if names else "", first, found)
            node.exported = names
        elif t.text == "export" and self.inside == "code":
            self.export(first)
        elif t.text == "import" and self.inside == "code" and not self.group(i + 1, "(") and not self.is_(i + 1, "."):
            self.inside = "types"
            self.to_end()
            self.inside = "code"
            self.add("import", next((x.text[1:-1] for x in self.items[i : self.i] if x.kind == "text"), ""), first, [])
            names, last = self.out[-1].exported, None
            for x in self.items[i + 1 : self.i]:
                for y in x.items if x.kind == "group" else [x]:
                    if y.kind == "word" and last != "as" and y.text not in ("as", "from", "type") or last == "as" and x.kind != "group":
                        names.append(y.text)
                    last = y.text
        elif t.text in ("if", "for", "while", "do", "try") and not self.is_(i + 1, ":", ",", "="):
            self.control(t.text)
        elif self.is_(i + 1, "=>"):
            self.arrow(i, [], i + 2)
        else:
            self.named(i, t)

    def export(self, first: int) -> None:
        i = self.i
        self.i += 1
        self.i += self.is_(self.i, "default")
        names, found = [], []
        if self.group(self.i, "{"):
            last = ","
            for x in self.items[self.i].items:
                if x.kind == "word" and last == "," and x.text != "type":
                    names.append(x.text)
                last = x.text if x.text != "type" else last
            self.to_end()
        else:
            def read() -> None:
                while self.word(self.i) and self.items[self.i].text in ("async", "abstract", "declare") and self.word(self.i + 1) or self.is_(self.i, "@"):
                    self.i += 1 if self.word(self.i) else 2
                self.i = begin = min(self.i, len(self.items))
                self.step()
                if not (self.out and self.out[-1].kind in ("function", "class", "interface", "type", "enum", "declaration", "var") and self.out[-1].end == self.items[self.i - 1].end) and self.i > begin and not self.new_line(self.i):
                    self.to_end()

            found = self.within(read)
            if found and found[-1].kind in ("function", "class", "interface", "type", "enum", "declaration", "var"):
                names = found[-1].exported or [found[-1].name] * bool(found[-1].name)
        node = self.add("export", names[0] if names else "", first if first < i else i, found)
        node.exported = names

    def step_go(self, i: int, t: Token) -> None:
        if t.text == "func":
            k, kind = i + 1, "function"
            if self.group(k, "(") and self.word(k + 1) and (self.group(k + 2, "(") or self.group(k + 2, "[")):
                k, kind = k + 1, "method"
            if self.word(k):
                at = k + 1 + self.group(k + 1, "[")
                if self.group(at, "("):
                    self.function(i, kind, self.items[k].text, at)
                    return
            elif self.group(k, "("):  # without a name: only what it holds counts
                held = self.within(lambda: self.function(i, "literal", "", k))
                self.out += held[-1].children if held else []
                return
            self.i += 1
        elif t.text == "type" and (self.word(i + 1) or self.group(i + 1, "(")):
            name = self.items[i + 1].text if self.word(i + 1) else next((x.text for x in self.items[i + 1].items if x.kind == "word"), "")
            self.i, self.inside = i + 1, "types"
            self.to_end()
            self.inside = "code"
            self.add("type", name, i, [])
        elif t.text == "import" and (i + 1 < len(self.items)):
            self.i += 1
            self.inside = "types"
            self.to_end()
            self.inside = "code"
            flat = [y for x in self.items[i + 1 : self.i] for y in (x.items if x.kind == "group" else [x])]
            for x in flat:
                if x.kind == "text":
                    self.out.append(Node("import", x.text[1:-1], x.line, x.last, x.at, x.end))
        elif t.text in ("if", "for"):
            self.control(t.text)
        else:
            self.named(i, t)

    def step_rust(self, i: int, t: Token) -> None:
        first = self.begin(i)
        public = any(x.text == "pub" for x in self.items[first:i])
        if t.text == "fn" and self.word(i + 1):
            at = i + 2
            at = self.angle(at) if self.is_(at, "<") else at
            if self.group(at, "("):
                if self.function(first, "function", self.items[i + 1].text, at):
                    self.out[-1].exported = [self.out[-1].name] * public
            else:
                self.i += 1
        elif t.text in ("struct", "enum", "trait", "mod", "union") and self.word(i + 1):
            self.i += 1
            self.type_like(first, t.text, {"mod": "module"}.get(t.text, t.text), {"struct": "types", "enum": "types"}.get(t.text, "code"))
            self.out[-1].exported = [self.out[-1].name] * public
        elif t.text == "impl" and self.inside == "code" and (i == 0 or first != i or not self.is_(i - 1, ":", "->", "=", "&", "<", ",", "+")):
            self.i = self.angle(i + 1) if self.is_(i + 1, "<") else i + 1
            words, k = [], self.i
            while k < len(self.items) and self.items[k].text != "{":
                words += [self.items[k].text] * self.word(k)
                k += 1
            target = words[words.index("for") + 1 :] if "for" in words else words
            self.type_like(first, t.text, "impl", "code")
            self.out[-1].name = target[0] if target else ""
        elif t.text == "let":  # what is bound is no call
            self.i += 1
            while self.i < len(self.items) and not self.is_(self.i, "=", ";"):
                self.i += 1
        elif t.text == "use" and self.inside == "code":
            self.i += 1
            begin = self.i
            while self.i < len(self.items) and not self.is_(self.i, ";"):
                self.i += 1
            path = "".join(x.text for x in self.items[begin : self.i] if x.kind != "group").removesuffix("::")
            self.i += self.i < len(self.items)
            self.add("import", path, first, [])
        elif t.text in ("if", "for", "while", "loop") and not (t.text == "for" and self.is_(i + 1, "<")) and not (t.text == "if" and self.arm(i + 1)):
            self.control(t.text)
        else:
            self.named(i, t)

    def step_java(self, i: int, t: Token) -> None:
        first = self.begin(i)
        if t.text in ("class", "interface", "enum", "record") and self.word(i + 1) and not self.is_(i - 1, "."):
            self.i += 1
            self.type_like(first, t.text, t.text, "class")
            self.out[-1].exported = [self.out[-1].name] * any(x.text == "public" for x in self.items[first:i])
        elif t.text in ("import", "package") and self.inside == "code" and self.word(i + 1):
            self.i += 1
            begin = self.i + self.is_(self.i, "static")
            while self.i < len(self.items) and not self.is_(self.i, ";"):
                self.i += 1
            path = "".join(x.text for x in self.items[begin : self.i]).removesuffix(".*")
            self.i += self.i < len(self.items)
            if t.text == "import":
                self.add("import", path, first, [])
        elif t.text in ("if", "for", "while", "do", "try"):
            self.control(t.text)
        elif self.group(i + 1, "(") and t.text not in self.no_call and self.java_method(i):
            pass
        elif self.inside == "class" and self.group(i + 1, "(") and (self.group(i + 2, "{") or self.is_(i + 2, "throws")):  # a constructor, or a constant with a body
            held = self.within(lambda: self.function(first, "constructor", t.text, i + 1))
            self.out += held[-1].children if held else []
        elif self.inside == "class" and self.group(i + 1, "(") and (i == 0 or self.is_(i - 1, ",", ";", "{")):  # a constant of an enum
            self.out += self.of(self.items[i + 1])
            self.i = i + 2
        elif self.created(i) and self.group(i + 1, "(") and self.group(i + 2, "{"):  # a class without a name
            self.out += self.of(self.items[i + 1]) + self.of(self.items[i + 2], "class")
            self.i = i + 3
        elif self.created(i) and self.is_(i + 1, "<") and self.group(k := self.angle(i + 1), "(") and self.group(k + 1, "{"):
            self.out += self.of(self.items[k]) + self.of(self.items[k + 1], "class")
            self.i = k + 2
        else:
            self.named(i, t)

    def java_method(self, i: int) -> bool:
        """A name before parameters is a method's if a type stands before it, and a body, an end or `throws` behind them."""
        before = self.items[i - 1] if i else None
        is_type = before is not None and (before.kind == "word" and before.text not in MODIFIERS | self.no_call or before.text in (">", "[") and before.kind != "text")
        if not is_type or not (self.group(i + 2, "{") or self.is_(i + 2, "throws") or self.inside == "class" and self.is_(i + 2, ";", "default")):
            return False
        first = i - 1  # back over the type, modifiers and annotations
        while first > 0 and not self.is_(first - 1, ";", "{"):
            first -= 1
        self.function(first, "method", self.items[i].text, i + 1)
        return True


def tree(text: str, language: str) -> list[Node]:
    """What a text declares, imports, runs and calls at its top level, in its order; nothing where brackets are nested deeper than a parser goes."""
    try:
        return Reader(groups(text, language), language).all()
    except RecursionError:
        return []


def depth(nodes: list[Node], kinds: frozenset[str]) -> int:
    return max((depth(n.children, kinds) + (n.kind in kinds) for n in nodes), default=0)


def below(node: Node) -> Iterator[Node]:
    """All nodes inside a node, in their order."""
    for child in node.children:
        yield child
        yield from below(child)
