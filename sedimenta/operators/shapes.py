"""Declarations of texts by the shape of their pieces: what a parser finds in a piece is found once for all pieces that differ only in their words.

A text becomes its shape by one pattern: each name that no parser compares with anything becomes a mark, all else stays. Shapes are cut at the top level. A piece of a shape that
wasn't met before is parsed with a letter of its own in the place of each such word, and what was found becomes a function of the words. In languages with braces a parser may look beyond a piece, at what
stands before and behind it: the last two items before and the word behind are part of what a piece is known by, and a reader notes whether it looked further. Where it did, and wherever else a piece
doesn't stand by itself, the text is left to the parser as a whole, so that the results are those of whole texts in any case; only the time hangs on how often shapes repeat.
"""

from __future__ import annotations

import ast
import keyword
import re
import types
from collections.abc import Callable
from dataclasses import dataclass, field

from sedimenta.operators import syntax
from sedimenta.operators.syntax import CLOSERS, CLOSING, SCRIPTS, Node, Reader, Token, groups, tokens

#: What stands for a word in a shape, the letters for the words of a piece that is parsed, and the one for words of its neighbours.
MARK, FIRST, MOST_WORDS, FOREIGN = "一", 0x4E01, 20_000, "㐀"
LETTER = re.compile(f"[{chr(FIRST)}-{chr(FIRST + MOST_WORDS)}]")
#: How many characters of shapes a worker keeps; after how many of new shapes, if those of known ones aren't three times as many, it parses texts whole, and how many texts so before it tries again.
MOST_SIZE, PATIENCE, REST = 4_000_000, 200_000, 1_000
#: Patterns of JavaScript are read as such up to a length, so words of a piece with a slash count by their length beyond this.
SHORT = 500
FAILS = (RecursionError, SyntaxError, ValueError, MemoryError, IndexError)


@dataclass(slots=True)
class Found:
    """A declaration that is a chunk, lines from 1. Names may come twice; `exported` is None where the name says whether it is exported."""

    first: int
    last: int
    kind: str
    name: str
    exported: list[str] | None
    calls: list[str]
    nesting: int
    loops: int
    params: int
    has_async: bool
    refs: list[tuple[str, str, int]]
    at: int = 0
    end: int = 0


@dataclass(slots=True)
class Import:
    """A module, and the names that are taken from it on a line; those of a higher rank come later."""

    module: str
    names: list[str] = field(default_factory=list)
    line: int = 1
    rank: int = 0


def chunks(file_id: str, text: str, imports: list[Import], found: list[Found], public: Callable[[str], bool]) -> list[tuple]:
    """The chunks of a file (see chunks.CODE), each name once; what the file imports counts for the first."""
    cut = text.split("\n")
    held = [
        (
            file_id, f.first, f.last, f.kind, [f.name] if f.name else [], "\n".join(cut[f.first - 1 : f.last]), [], f.exported if f.exported is not None else [f.name] if public(f.name) else [],
            list(dict.fromkeys(f.calls)), f.nesting, f.loops, f.params, f.has_async, list(dict.fromkeys(f.refs)),
        )
        for f in found
    ]
    return _with_imports(held, imports)


def _with_imports(held: list[tuple], imports: list[Import]) -> list[tuple]:
    if held and imports:
        imports = sorted(imports, key=lambda i: i.rank)
        modules = list(dict.fromkeys(i.module for i in imports if i.module))
        said = [(m, "import", 1) for m in modules] + [(name, "import", i.line) for i in imports for name in i.names]
        held[0] = (*held[0][:6], modules, *held[0][7:13], list(dict.fromkeys(held[0][13] + said)))
    return held


def compared(module: types.ModuleType) -> frozenset[str]:
    """All words in strings of a module's code: those that it may compare with words of a text."""
    seen: set[str] = set()

    def walk(value: object) -> None:
        if isinstance(value, str):
            seen.update(re.findall(r"[^\W\d]\w*", value))
        elif isinstance(value, (tuple, list, set, frozenset)):
            for x in value:
                walk(x)
        elif isinstance(value, dict):
            walk([*value, *value.values()])
        elif isinstance(value, re.Pattern):
            walk(value.pattern)
        elif isinstance(value, types.CodeType):
            walk(value.co_consts)
        elif isinstance(value, types.FunctionType):
            walk([value.__code__, value.__defaults__])
        elif isinstance(value, type) and value.__module__ == module.__name__:
            walk([x for x in vars(value).values() if not isinstance(x, type)])

    walk([x for k, x in vars(module).items() if not k.startswith("__")])
    return frozenset(seen)


NAME = re.compile(r"[A-Za-z_]\w*", re.A).fullmatch


class _Marks(dict):
    """Of a run of letters its mark if it is a name, or the run where it isn't or a parser may compare it."""

    def __init__(self, kept: frozenset[str]) -> None:
        self.kept = kept

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = MARK if NAME(word) and word not in self.kept and not word.startswith("async") else word
        return found


class Alone(Exception):
    """What a piece declares can't be told from the piece and its neighbours."""


class Shapes:
    """What was made of the shapes met so far in a language."""

    def __init__(self, words: str, kept: frozenset[str], public: Callable[[str], bool]) -> None:
        self.split, self.marks, self.public = re.compile(words, re.A).split, _Marks(kept), public
        self.made: dict = {}
        self.old = self.new = self.size = self.rest = 0

    def find(self, file_id: str, text: str) -> list[tuple] | None:
        """The chunks of a text, or None where it has to be parsed as a whole."""
        if self.new > PATIENCE and 3 * self.new > self.old:
            self.made.clear()
            self.old, self.new, self.size, self.rest = 0, 0, 0, REST
        if self.rest or not text.isascii():
            self.rest = max(self.rest - 1, 0)
            return None
        parts = self.split(text)
        words = parts[1::2]
        parts[1::2] = map(self.marks.__getitem__, words)
        try:
            held, imports = self.pieces(file_id, "".join(parts), words, text.split("\n"))
        except Alone:
            return None
        return _with_imports(held, imports)

    def pieces(self, file_id: str, shape: str, words: list[str], cut: list[str]) -> tuple[list[tuple], list[Import]]:
        raise NotImplementedError

    def kept(self, key: object, make: Callable, *of: object) -> object:
        """What was made of a shape before, or is made now; that one can't be told alone is kept too."""
        found, length = self.made.get(key), len(key if isinstance(key, str) else key[0])
        if found is None:
            self.new += length
            try:
                found = make(*of)
            except (Alone, *FAILS):
                found = Alone
            self.size += length + 200
            if self.size > MOST_SIZE:
                self.made.clear()
                self.size = 0
            self.made[key] = found
        else:
            self.old += length
        if found is Alone:
            raise Alone
        return found

    def lettered(self, cut: list[str]) -> tuple[str, int]:
        """Lines of a text with a letter for each word that is marked in a shape, the one of its number among all words; and how many words there are."""
        parts = self.split("\n".join(cut))
        words = parts[1::2]
        if len(words) > MOST_WORDS:
            raise Alone
        parts[1::2] = [chr(FIRST + j) if self.marks[w] == MARK else w for j, w in enumerate(words)]
        return "".join(parts), len(words)

    def function(self, text: str, imports: list[Import], found: list[Found]) -> tuple[Callable | None, Callable | None]:
        """What was found in a lettered text as functions of words (w), file (f), first line from 0 (n) and the file's lines (c): its chunks without imports, and its imports; None for none."""
        made = f"lambda w, f, n, c: [{', '.join(self._chunk(text, x) for x in found)}]" if found else ""
        taken = f"lambda w, n: [{', '.join(f'I({_said(i.module)}, [{', '.join(map(_said, i.names))}], {_line(i.line) if i.names else 1}, {i.rank})' for i in imports)}]" if imports else ""
        if FOREIGN in made or FOREIGN in taken:
            raise Alone
        known = {"I": Import, "d": dict.fromkeys, "p": self.public, "j": "\n".join}
        return tuple(eval(x, known) if x else None for x in (made, taken))  # made of what a parser found, with texts as literals

    def _chunk(self, text: str, x: Found) -> str:
        name = _said(x.name)
        lines = f"c[n+{x.first - 1}]" if x.first == x.last else f"j(c[n+{x.first - 1}:n+{x.last}])"
        exported = f"[{', '.join(map(_said, x.exported))}]" if x.exported is not None else f"[{name}] if p({name}) else []"
        refs = [f"({_said(s)}, {kind!r}, {_line(line)})" for s, kind, line in x.refs]
        return f"(f, {_line(x.first)}, {_line(x.last)}, {x.kind!r}, {f'[{name}]' if x.name else '[]'}, {lines}, [], {exported}, {_once([_said(c) for c in x.calls])}, {x.nesting}, {x.loops}, {x.params}, {self.has_async(text, x)}, {_once(refs)})"

    def has_async(self, text: str, x: Found) -> str:
        return str(x.has_async)


def _said(text: str) -> str:
    """A string of a lettered text as an expression of its words."""
    parts = [f"w[{ord(x) - FIRST}]" if LETTER.match(x) else repr(x) for x in re.split(f"({LETTER.pattern})", text) if x]
    return "+".join(parts) or "''"


def _line(line: int) -> str:
    return f"n+{line}"


def _once(parts: list[str]) -> str:
    parts = list(dict.fromkeys(parts))
    return f"[{', '.join(parts)}]" if len(parts) < 2 else f"[*d(({', '.join(parts)}))]"


# Python


class PythonShapes(Shapes):
    """Pieces begin at each line that isn't indented and doesn't close a bracket; one that doesn't parse by itself leaves the text to the parser."""

    def __init__(self, found: Callable[[ast.Module], tuple[list[Import], list[Found]]], public: Callable[[str], bool]) -> None:
        super().__init__(r"""([\w\\]+['"]?)""", frozenset([*keyword.kwlist, *keyword.softkwlist, "r", "s", "a", "__debug__", "__future__"]), public)  # prefixes of strings and escapes are no names
        self.found, self.cut = found, re.compile(r"\n(?=[^\s#)\]}])").split

    def pieces(self, file_id, shape, words, cut):
        if "\r" in shape or "\f" in shape or "\0" in shape:
            raise Alone
        parts = self.cut(shape)
        if shape.startswith("@") or "\n@" in shape:
            whole, parts = parts, []
            for part in whole:
                if parts and parts[-1].rpartition("\n")[2].startswith("@"):
                    parts[-1] += "\n" + part
                else:
                    parts.append(part)
        held, imports, k, n = [], [], 0, 0
        for part in parts:
            n_lines, n_words, made, taken = self.kept(part, self.piece, cut, n, part.count("\n") + 1)
            if made:
                held += made(words[k : k + n_words], file_id, n, cut)
            if taken:
                imports += taken(words[k : k + n_words], n)
            k += n_words
            n += n_lines
        return held, imports

    def piece(self, cut: list[str], n: int, n_lines: int) -> tuple:
        text, n_words = self.lettered(cut[n : n + n_lines])
        return n_lines, n_words, *self.function(text, *self.found(ast.parse(text)))


# languages with braces


@dataclass(slots=True)
class Line:
    """The brackets that a line closes and opens (as those that close them), and the piece that it is if it does neither."""

    closes: list[str]
    opens: list[str]
    piece: Piece | None


@dataclass(slots=True)
class Piece:
    """How many words and lines a piece has, its first item if it has any, and its last two; items as (kind, text)."""

    n_words: int
    n_lines: int
    head: tuple[str, str] | None
    tail: tuple[tuple[str, str], ...]


class BraceShapes(Shapes):
    """Pieces are lines, and runs of lines up to the one that closes what they open. A line that begins or ends within a comment, string or template, or whose quotes don't match, leaves the text to the parser."""

    def __init__(self, language: str, found: Callable[[list[Node], str, str], tuple[list[Import], list[Found]]], public: Callable[[str], bool]) -> None:
        # elsewhere than in scripts a word beside a single quote is a character or a lifetime, by its length
        super().__init__(r"([\w$#\\]+)" if language in SCRIPTS else r"([\w$#\\']+)", compared(syntax), public)
        self.language, self.found, self.script = language, found, language in SCRIPTS

    def pieces(self, file_id, shape, words, cut):
        shapes, parts, open_, begin = shape.split("\n"), [], [], 0
        for n, line in enumerate(shapes):
            at = self.kept(line, self.line, cut, n)
            piece = at.piece
            if open_ or piece is None:
                for x in at.closes:
                    if not open_ or open_.pop() != x:
                        raise Alone
                open_ += at.opens
                if open_:
                    continue
                line = "\n".join(shapes[begin : n + 1])
                piece = self.kept((line, None), self.piece, cut, begin, n + 1)
            parts.append((begin, line, piece))
            begin = n + 1
        if open_:
            raise Alone
        held, imports, k, before = [], [], 0, ()
        heads = [p.head for _, _, p in parts]
        after, behind = None, []
        for head in reversed(heads):  # of each piece the first item behind it
            behind.append(after)
            after = head or after
        behind.reverse()
        for (n, line, piece), head, after in zip(parts, heads, behind, strict=True):
            if head:
                made, taken, slashes = self.kept((line, before, after), self.read, cut, n, piece, before, after)
                if slashes and sum(map(len, cut[n : n + piece.n_lines])) > SHORT:
                    raise Alone
                if made:
                    held += made(words[k : k + piece.n_words], file_id, n, cut)
                if taken:
                    imports += taken(words[k : k + piece.n_words], n)
                before = piece.tail if len(piece.tail) == 2 else (before + piece.tail)[-2:]
            k += piece.n_words
        return held, imports

    def line(self, cut: list[str], n: int) -> Line:
        """A line by itself. The word behind its end tells whether the line ends within something."""
        text, _ = self.lettered(cut[n : n + 1])
        found = list(tokens(f"{text}\n{FOREIGN}", self.language))
        if text.endswith("\\") or not found or found.pop().text != FOREIGN or any(x.text == FOREIGN for x in found):
            raise Alone
        if found and found[0].text.startswith("/"):
            raise Alone
        closes, opens, holes = [], [], 0
        for x in found:
            if x.kind == "mark" and x.text in ('"', "'", "`") or x.kind == "word" and x.text == "r" and x.end != x.at + 1:
                raise Alone
            if x.kind == "mark" and x.text in CLOSING:
                opens.append(CLOSING[x.text])
                holes += x.end == x.at  # the hole of a template
            elif x.kind == "mark" and x.text in CLOSERS:
                holes -= text[x.at] != x.text
                if not opens:
                    closes.append(x.text)
                elif opens.pop() != x.text:
                    raise Alone
        if holes:
            raise Alone
        return Line(closes, opens, None if closes or opens else self.piece(cut, n, n + 1))

    def piece(self, cut: list[str], n: int, end: int) -> Piece:
        text, n_words = self.lettered(cut[n:end])
        items = [self.item(x) for x in groups(text, self.language)]
        return Piece(n_words, end - n, items[0] if items else None, tuple(items[-2:]))

    def item(self, x: Token) -> tuple[str, str]:
        """What a reader may ask of an item; of words that it compares with nothing, numbers and strings not more than that they are such."""
        return (x.kind, LETTER.sub(FOREIGN, x.text) if x.kind == "word" else {"number": "0", "text": "''"}.get(x.kind, x.text))

    def read(self, cut: list[str], n: int, piece: Piece, before: tuple, after: tuple[str, str] | None) -> tuple:
        text, _ = self.lettered(cut[n : n + piece.n_lines])
        if re.search(r"\basync\w", text) or after and not (after[0] == "word" or after in (("mark", "@"), ("mark", "#"))):
            raise Alone
        items = groups(text, self.language)
        held = [Token(kind, said, -1, -1, -1, -1) for kind, said in before]
        behind = [Token(*after, piece.n_lines, len(text) + 1, len(text) + 1, piece.n_lines)] if after else []
        reader = Watched([*held, *items, *behind], self.language, len(held), len(held) + len(items), bool(before), bool(behind))
        nodes = reader.alone()
        return *self.function(text, *self.found(nodes, text, self.language)), self.script and "/" in text

    def has_async(self, text: str, x: Found) -> str:
        """`async` counts within the first 200 characters."""
        m = re.search(r"\basync\b", text[x.at : x.end])
        if not m:
            return "False"
        words = [ord(w) - FIRST for w in LETTER.findall(text[x.at : x.at + m.end()])]
        length = m.end() - len(words)
        return str(length <= 200) if not words else f"({length}+{'+'.join(f'len(w[{j}])' for j in words)} <= 200)"


class _Asked(list):
    """Items, of which the furthest that was asked for is noted."""

    furthest = -1

    def __getitem__(self, i):
        if isinstance(i, int):
            self.furthest = max(self.furthest, i)
        return list.__getitem__(self, i)


class Watched(Reader):
    """A reader of a piece between a few items of its neighbours; `far` once it went or looked beyond those, or began a declaration before the piece."""

    def __init__(self, items: list[Token], language: str, start: int, stop: int, begun: bool, goes_on: bool) -> None:
        self.start, self.stop, self.begun, self.goes_on, self.total, self.far = start, stop, begun, goes_on, len(items), False
        super().__init__(_Asked(items), language)
        self.i = start

    @property
    def i(self) -> int:
        return self._i

    @i.setter
    def i(self, value: int) -> None:
        self._i = value
        self.look(value)

    def look(self, i: int) -> None:
        self.far = self.far or self.goes_on and i >= self.total or self.begun and i < 0

    def alone(self) -> list[Node]:
        while self.i < self.stop:
            self.step()
        if self.far or self.i != self.stop:
            raise Alone
        return self.out

    def is_(self, i: int, *texts: str) -> bool:
        self.look(i)
        return super().is_(i, *texts)

    def group(self, i: int, bracket: str) -> bool:
        self.look(i)
        return super().group(i, bracket)

    def word(self, i: int) -> bool:
        self.look(i)
        return super().word(i)

    def new_line(self, i: int) -> bool:
        self.look(i)
        self.look(i - 1)
        return super().new_line(i)

    def ahead(self, read: Callable[[int], int | bool], i: int) -> int | bool:
        """A search through the items from i on, which is told by them alone if it didn't come to what is behind the piece."""
        before, self.items.furthest = self.items.furthest, -1
        found = read(i)
        self.far = self.far or self.goes_on and self.items.furthest >= self.stop
        self.items.furthest = max(before, self.items.furthest)
        return found

    def angle(self, i: int) -> int:
        return self.ahead(super().angle, i)

    def arm(self, i: int) -> bool:
        return self.ahead(super().arm, i)

    def begin(self, i: int) -> int:
        first = super().begin(i)
        self.far = self.far or self.begun and first < self.start
        return first

    def add(self, kind: str, name: str, first: int, children: list[Node], params: int = 0) -> Node:
        self.far = self.far or self.begun and first < self.start
        return super().add(kind, name, first, children, params)
