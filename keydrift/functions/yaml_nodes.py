"""The first YAML document of a text as its leaves, in one pass over the text.

The state is a stack of open collections, which no regular expression can hold: this is the part of the YAML reading
that runs in Python, row by row inside an Arrow function. Types, kinds of files and everything behind the leaves are
expressions (``operators.yaml``, ``operators.definitions``).

Block and flow style, compact nesting, quoted, plain and block scalars over several lines, comments, tags, anchors and
merge keys are read. A text that is no YAML, an alias without an anchor or inside its own anchor, a key twice in one
mapping, or a merge of what is no mapping make the whole text invalid.
"""

from __future__ import annotations

import re

#: Plain scalars that are not strings (null, booleans, integers, floats, dates and times).
NULL = r"(?:|~|null|Null|NULL)"
BOOL = r"(?:true|True|TRUE|false|False|FALSE)"
INT = r"[-+]?(?:0|[1-9][0-9_]*)"
RADIX = r"[-+]?0(?:[xX][0-9a-fA-F_]{1,15}|[bB][01_]{1,62}|[oO]?[0-7_]{1,20})"  # what fits 63 bits
FLOAT = r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"
SPECIAL = r"(?:[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))"
DATE = r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
TIME = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|\s+)[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}.*"
TYPED = re.compile("|".join((NULL, BOOL, INT, RADIX, FLOAT, SPECIAL, DATE, TIME)))

#: A document may take this share of its nodes from aliases, by the number of nodes.
FREE_NODES, FEW_NODES, MANY_NODES = 100, 400_000, 4_000_000
FEW_SHARE, MANY_SHARE = 0.99, 0.10
#: Fixed value: collections nested deeper than this make a text invalid.
DEEPEST = 10_000

ITEM = "-"
_NOT_PRINTABLE = re.compile("[^\t\n\x20-\x7e\x85\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_START = re.compile(r"(?:(?:[ \t]*(?:#[^\n]*)?|%[^\n]*)\n)*---(?=[ \t\n]|\Z)")
_END = re.compile(r"^(?:---|\.\.\.)(?=\s|\Z)", re.M)
_BLANK = re.compile(r"[ \t]*(?:(?<![^ \t\n])#[^\n]*)?(\n)?")
_CLEAR = re.compile(r"[ \t]*(?=\n|\Z)|[ \t]+(?=#)")
_PROPERTY = re.compile(r"&([^\s,\[\]{}]+)|!(<[^>\s]*>|[^\s,\[\]{}]*)")
_ALIAS = re.compile(r"\*([^\s,\[\]{}]+)")
_DOUBLE = re.compile(r'"((?:[^"\\]|\\.)*+)"', re.S)
_SINGLE = re.compile(r"'((?:[^']|'')*+)'")
_FIRST = re.compile(r"""[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=\S)""")
_PLAIN = re.compile(r"(?:[^\n:#]|:(?=\S)|(?<=\S)#)++")
_FLOW_FIRST = re.compile(r"""[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=[^\s,\[\]{}])""")
_FLOW_PLAIN = re.compile(r"(?:[^\n:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)++")
_COLON = re.compile(r"[ \t]*:(?=\s|\Z)")
_HEADER = re.compile(r"([|>])(?:([1-9])?([-+])?|([-+])([1-9]))[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|\Z)")
_BREAKS = re.compile(r"[ \t]*\n[ \t\n]*")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|\n[ \t]*|(.))|[ \t]*\n[ \t\n]*", re.S)
_ESCAPES = dict(zip('0abt\tnvfre "/\\N_LP', '\0\a\b\t\t\n\v\f\r\x1b "/\\\x85\xa0\u2028\u2029', strict=True))


class Invalid(ValueError):
    """The text is no YAML."""


class Node:
    """A scalar (``text``, and ``string`` where it can only be one), a list (``items``) or a map: ``pairs``, of which the
    first ``own`` are no merged ones, and ``strings`` where all own keys are strings."""

    __slots__ = ("items", "kind", "open", "own", "pairs", "string", "strings", "text")

    def __init__(self, kind: str, text: str = "", string: bool = False) -> None:
        self.kind, self.text, self.string = kind, text, string
        self.items: list[Node | Alias] = []
        self.pairs: list[tuple[Node | Alias, Node | Alias]] = []
        self.open, self.own, self.strings = kind != "scalar", 0, True

    def finish(self) -> None:
        """A map's keys are checked, and what it merges is added behind its own pairs."""
        self.open = False
        if self.kind != "map":
            return
        names, merged, own = set(), [], []
        for key, value in self.pairs:
            k = _target(key)
            if k.kind != "scalar" or k.text in names:
                raise Invalid
            names.add(k.text)
            if k.text == "<<" and not k.string:
                merged = value.items if value.__class__ is Node and value.kind == "list" else [value]
            else:
                own.append((key, value))
                self.strings = self.strings and (k.string or not TYPED.fullmatch(k.text))
        self.own, self.pairs = len(own), own
        for source in map(_target, merged):
            if source.kind != "map" or source.open:
                raise Invalid
            for key, value in source.pairs:
                if _target(key).text not in names:
                    names.add(_target(key).text)
                    own.append((key, value))


class Alias:
    """Stands for an earlier node."""

    __slots__ = ("node",)

    def __init__(self, node: Node) -> None:
        self.node = node


def _target(node: Node | Alias) -> Node:
    return node.node if isinstance(node, Alias) else node


class _Frame:
    """An open collection and what it waits for: 'ready' for an entry, a 'key', the 'colon' behind one, a 'value', or, in
    flow style, 'done' until a comma."""

    __slots__ = ("indent", "key", "node", "state")

    def __init__(self, node: Node, indent: int, state: str = "ready") -> None:
        self.node, self.indent, self.state = node, indent, state
        self.key: Node | Alias | None = None

    def put(self, value: Node | Alias, then: str = "ready") -> None:
        if self.state == "key":
            self.key, self.state = value, "colon"
        elif self.state != "value":
            raise Invalid
        elif self.node.kind == "map":
            self.node.pairs.append((self.key, value))
            self.state = then
        else:
            self.node.items.append(value)
            self.state = then


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.pos, self.bol = text, 0, 0
        self.anchors: dict[str, Node] = {}
        self.properties: tuple[str | None, str | None, int, int] | None = None  # anchor, tag, line, column

    # ------------------------------------------------------------ pieces

    def skip(self) -> bool:
        """Past blanks, comments and line breaks; whether a line was begun."""
        crossed = False
        while True:
            m = _BLANK.match(self.text, self.pos)
            self.pos = m.end()
            if not m[1]:
                return crossed
            crossed, self.bol = True, self.pos

    def property(self) -> None:
        m = _PROPERTY.match(self.text, self.pos)
        if not m or (m.end() < len(self.text) and self.text[m.end()] not in " \t\n,]}"):
            raise Invalid
        anchor, tag, line, column = self.properties or (None, None, self.bol, self.pos - self.bol)
        if m[1] is not None and anchor is None:
            anchor = m[1]
        elif m[2] is not None and tag is None:
            tag = m[2]
        else:
            raise Invalid
        self.properties, self.pos = (anchor, tag, line, column), m.end()

    def named(self, node: Node) -> Node:
        """The node with the properties read before it."""
        if self.properties:
            anchor, tag, *_ = self.properties
            if anchor is not None:
                self.anchors[anchor] = node
            if tag is not None and node.kind == "scalar":
                # a tag of an own kind, or none, leaves a string
                node.string = tag.strip("<>").removeprefix("tag:yaml.org,2002:").removeprefix("!") not in ("int", "float", "bool", "null", "timestamp")
            self.properties = None
        return node

    def alias(self) -> Alias:
        m = _ALIAS.match(self.text, self.pos)
        node = self.anchors.get(m[1]) if m else None
        if node is None or node.open or self.properties:
            raise Invalid
        self.pos = m.end()
        return Alias(node)

    def quoted(self) -> Node:
        double = self.text[self.pos] == '"'
        m = (_DOUBLE if double else _SINGLE).match(self.text, self.pos)
        if not m:
            raise Invalid
        self.pos = m.end()
        line = self.text.rfind("\n", m.start(), m.end())
        self.bol = line + 1 if line >= 0 else self.bol
        if double:
            return Node("scalar", _ESCAPE.sub(self._escape, m[1]), True)
        return Node("scalar", _BREAKS.sub(self._fold, m[1]).replace("''", "'"), True)

    @staticmethod
    def _fold(m: re.Match) -> str:
        return "\n" * (m[0].count("\n") - 1) or " "

    def _escape(self, m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            if int(code, 16) > 0x10FFFF or 0xD800 <= int(code, 16) <= 0xDFFF:
                raise Invalid
            return chr(int(code, 16))
        if m[4]:
            if m[4] not in _ESCAPES:
                raise Invalid
            return _ESCAPES[m[4]]
        return "" if m[0].startswith("\\") else self._fold(m)

    def plain(self, indent: int, pattern: re.Pattern = _PLAIN) -> Node:
        """A plain scalar; lines below that are deeper than ``indent`` belong to it."""
        text = self.text
        m = pattern.match(text, self.pos)
        parts = [m[0].rstrip(" \t")]
        self.pos = m.start() + len(parts[0])
        while True:
            m = _BREAKS.match(text, self.pos)
            if not m or m.end() == len(text):
                break
            bol = text.rfind("\n", m.start(), m.end()) + 1
            ahead = text[m.end()]
            if m.end() - bol <= indent or ahead == "#" or "\t" in text[bol : m.end()] and indent >= 0 and m.end() == bol:
                break
            more = pattern.match(text, m.end())
            if not more or (pattern is _PLAIN and _COLON.match(text, more.end())):
                if pattern is _PLAIN:
                    raise Invalid
                break
            line = more[0].rstrip(" \t")
            parts += [self._fold(m), line]
            self.pos, self.bol = more.start() + len(line), bol
        return Node("scalar", "".join(parts))

    def block(self, indent: int) -> Node:
        """A literal or folded scalar."""
        text, m = self.text, _HEADER.match(self.text, self.pos)
        if not m:
            raise Invalid
        more, chomp = m[2] or m[5], m[3] or m[4]
        least = max(indent, 0) + int(more) if more else 0
        pos, lines, broken = m.end(), [], True  # broken: the last line that isn't empty ends in a line break
        while pos < len(text):
            end = text.find("\n", pos)
            end = len(text) if end < 0 else end
            bare = pos
            while bare < end and text[bare] == " " and (not least or bare - pos < least):
                bare += 1
            if bare < end:
                if not least and bare - pos <= max(indent, 0) and bare - pos < max(indent + 1, 1):
                    break
                least = least or bare - pos
                if bare - pos < least:
                    break
            lines.append(text[bare:end])
            broken = broken if not lines[-1] else end < len(text)
            pos = end + 1
        self.pos = self.bol = min(pos, len(text))
        body = len(lines)
        while body and not lines[body - 1]:
            body -= 1
        if m[1] == "|":
            out = "\n".join(lines[:body])
        else:
            out, breaks, before = [], 0, None
            for line in lines[:body]:
                if not line:
                    breaks += 1
                    continue
                spaced = line[0] in " \t"
                if before is None:
                    out.append("\n" * breaks)
                elif spaced or before:
                    out.append("\n" * (breaks + 1))
                else:
                    out.append("\n" * breaks or " ")
                out.append(line)
                breaks, before = 0, spaced
            out = "".join(out)
        if chomp == "+":
            out += "\n" * (len(lines) - body + (body > 0 and broken))
        elif chomp != "-" and body and broken:
            out += "\n"
        return Node("scalar", out, True)

    def empty(self) -> Node:
        """A null, with the properties that stand for it."""
        return self.named(Node("scalar"))

    def settle(self, frame: _Frame) -> None:
        """Whatever the collection still waits for is null."""
        if frame.state == "key":
            frame.put(self.empty())
        if frame.state == "colon":
            frame.state = "value"
        if frame.state == "value":
            frame.put(self.empty())

    # ------------------------------------------------------------ flow style

    def _flow_put(self, frame: _Frame, node: Node | Alias) -> None:
        """A key, a value or an item; an item with a colon behind it is a map of one pair."""
        if frame.state == "ready":
            if frame.node.kind == "map":
                frame.key, frame.state = node, "colon"
            else:
                frame.node.items.append(node)
                frame.state = "done"
        elif frame.state == "value" and frame.node.kind == "list":
            pair = Node("map")
            pair.pairs.append((frame.key, node))
            pair.finish()
            frame.node.items.append(pair)
            frame.state = "done"
        else:
            frame.put(node, "done")

    def _flow_colon(self, frame: _Frame) -> None:
        if frame.state in ("ready", "key"):
            frame.key = self.empty()
        elif frame.node.kind == "list" and frame.state == "done":
            frame.key = frame.node.items.pop()
        elif frame.state != "colon":
            raise Invalid
        frame.state = "value"

    def _flow_entry_ends(self, frame: _Frame) -> None:
        if frame.state == "key":
            frame.put(self.empty())
        if frame.state == "colon":
            frame.state = "value"
        if frame.state == "value" or self.properties:
            self._flow_put(frame, self.empty())

    def flow(self) -> Node:
        text, stack = self.text, []
        adjacent = False  # behind a quoted scalar or a collection, where a colon needs no blank
        while True:
            if self.skip() and self.pos == self.bol and _END.match(text, self.pos):
                raise Invalid
            c = text[self.pos : self.pos + 1]
            top = stack[-1] if stack else None
            if not c or len(stack) > DEEPEST:
                raise Invalid
            if c in "[{":
                node = self.named(Node("list" if c == "[" else "map"))
                if top:
                    self._flow_put(top, node)
                stack.append(_Frame(node, -1))
                self.pos, adjacent = self.pos + 1, False
            elif c in "]}":
                if (c == "]") != (top.node.kind == "list"):
                    raise Invalid
                self._flow_entry_ends(top)
                top.node.finish()
                stack.pop()
                self.pos, adjacent = self.pos + 1, True
                if not stack:
                    return top.node
            elif c == ",":
                self._flow_entry_ends(top)
                if top.state != "done":
                    raise Invalid
                top.state = "ready"
                self.pos, adjacent = self.pos + 1, False
            elif c == ":" and (adjacent or not _FLOW_FIRST.match(text, self.pos)):
                self._flow_colon(top)
                self.pos, adjacent = self.pos + 1, False
            elif c == "?" and not _FLOW_FIRST.match(text, self.pos):
                if top.state != "ready":
                    raise Invalid
                top.state = "key"
                self.pos, adjacent = self.pos + 1, False
            elif c in "&!":
                self.property()
            else:
                if c == "*":
                    node = self.alias()
                elif c in "\"'":
                    node = self.named(self.quoted())
                elif _FLOW_FIRST.match(text, self.pos):
                    node = self.named(self.plain(-1, _FLOW_PLAIN))
                else:
                    raise Invalid
                self._flow_put(top, node)
                adjacent = c in "\"'"

    # ------------------------------------------------------------ block style

    def _open(self, stack: list[_Frame], kind: str, column: int) -> None:
        top = stack[-1]
        # a list may stand as far left as the map whose value it is
        level = kind == "list" and top.node.kind == "map" and column == top.indent
        if top.state not in ("value", "key") or not (column > top.indent or level) or len(stack) > DEEPEST:
            raise Invalid
        node = self.named(Node(kind))
        top.put(node)
        stack.append(_Frame(node, column))

    def _close(self, stack: list[_Frame]) -> None:
        self.settle(stack[-1])
        stack.pop().node.finish()

    def _line_begins(self, stack: list[_Frame], column: int, c: str, indicator: bool) -> None:
        """Collections that stand further right end; what the one at this column waited for is null."""
        if "\t" in self.text[self.bol : self.pos]:
            raise Invalid
        dash = c == "-" and indicator
        while stack[-1].indent > column or (stack[-1].indent == column and stack[-1].node.kind == "list" and not dash):
            self._close(stack)
        top = stack[-1]
        if top.indent == column and top.state != "ready":
            if top.node.kind == "map" and (dash and top.state == "value" or c == ":" and indicator and top.state != "value"):
                return
            self.settle(top)

    def document(self) -> Node | None:
        """The root of the first document; None when there is nothing in it."""
        text, started = self.text, _START.match(self.text)
        if started:
            self.pos = started.end()
            self.bol = self.pos - 3
        stack = [_Frame(Node("list"), -1, "value")]
        # a block collection may begin at a line's start and behind '- ', '? ' and ': ', not behind 'key: '
        fresh, line = False, self.bol if started else -1
        while True:
            self.skip()
            if self.pos == len(text) or (self.pos == self.bol and _END.match(text, self.pos)):
                break
            c, column = text[self.pos], self.pos - self.bol
            indicator = c in "-?:" and text[self.pos + 1 : self.pos + 2] in ("", " ", "\t", "\n")
            if self.bol != line:
                self._line_begins(stack, column, c, indicator)
                fresh, line = True, self.bol
            top = stack[-1]
            if indicator:
                if not fresh:
                    raise Invalid
                kind = "list" if c == "-" else "map"
                if c == ":" and top.indent == column and top.state in ("key", "colon"):
                    if top.state == "key":
                        top.put(self.empty())
                    top.state = "value"
                elif c == ":":
                    raise Invalid
                else:
                    if not (top.node.kind == kind and top.indent == column and top.state == "ready"):
                        self._open(stack, kind, column)
                    stack[-1].state = "value" if c == "-" else "key"
                self.pos += 1
            elif c in "&!":
                self.property()
            elif c in "|>":
                top.put(self.named(self.block(top.indent)))
                line = -1
            else:
                fresh = self._scalar(stack, c, column, fresh)
                line = self.bol
        while len(stack) > 1:
            self._close(stack)
        return _target(stack[0].node.items[0]) if stack[0].node.items else None

    def _scalar(self, stack: list[_Frame], c: str, column: int, fresh: bool) -> bool:
        """A scalar, an alias or a flow collection: a key where a colon follows on its line, or a value."""
        top, line, given = stack[-1], self.bol, self.properties
        plain = False
        if c in "[{":
            node = self.flow()
        elif c == "*":
            node = self.alias()
        elif c in "\"'":
            node = self.quoted()
        elif _FIRST.match(self.text, self.pos):
            m = _PLAIN.match(self.text, self.pos)
            plain = not _COLON.match(self.text, m.end())
            node = self.plain(top.indent) if plain else Node("scalar", m[0].rstrip(" \t"))
            self.pos = self.pos if plain else m.end()
        else:
            raise Invalid
        colon = None if plain else _COLON.match(self.text, self.pos)
        if not colon:
            top.put(self.named(node) if isinstance(node, Node) and c not in "[{" else node)
            if not _CLEAR.match(self.text, self.pos):
                raise Invalid
            return fresh
        if not fresh or self.bol != line or c in "[{":
            raise Invalid
        beside = given if given and given[2] == line else None
        column = beside[3] if beside else column
        if not (top.node.kind == "map" and top.indent == column and top.state == "ready"):
            # properties on the key's own line are the key's, those above it the map's
            self.properties = None if beside else given
            self._open(stack, "map", column)
        elif given and not beside:
            raise Invalid
        self.properties = beside
        stack[-1].key, stack[-1].state = self.named(node) if isinstance(node, Node) else node, "value"
        self.pos = colon.end()
        return False


# ---------------------------------------------------------------- leaves


def _share(nodes: int) -> float:
    """How much of a document may come from aliases."""
    along = min(max((nodes - FEW_NODES) / (MANY_NODES - FEW_NODES), 0.0), 1.0)
    return FEW_SHARE - (FEW_SHARE - MANY_SHARE) * along


def _printed(node: Node | Alias) -> str:
    """A collection in one piece: ``map[a:1 b:2]``, keys ascending, ``[x y]``, ``<nil>`` for null."""
    pieces: list[str] = []
    todo: list[Node | Alias | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            pieces.append(x)
            continue
        x = _target(x)
        if len(pieces) > FEW_NODES:
            raise Invalid
        if x.kind == "scalar":
            pieces.append("<nil>" if not x.string and re.fullmatch(NULL, x.text) else x.text)
            continue
        entries = [["", item] for item in x.items]
        entries += [[f"{_target(k).text}:", v] for k, v in sorted(x.pairs, key=lambda p: _target(p[0]).text)]
        todo.append("]")
        for k, (name, value) in reversed(list(enumerate(entries))):
            todo += [value, (" " if k else "") + name]
        todo.append("[" if x.kind == "list" else "map[")
    return "".join(pieces)


def leaves(text: str, whole: int | None = None) -> list[tuple[list[str], str, bool, bool, bool]]:
    """(path, value, quoted, named, collection) of every leaf in the order of the text; none when the text is invalid.

    ``quoted``: the value can only be a string; ``named``: all maps on the path below the outermost have strings as keys.
    Items of lists have the path's part ``ITEM``. An alias stands for all leaves of its node. A collection at a path of
    length ``whole`` is one leaf, printed in one piece (``collection``).
    """
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    try:
        if _NOT_PRINTABLE.search(text):
            raise Invalid
        root = _Reader(text).document()
        if root is None or root.kind != "map":
            return []
        found: list[tuple[list[str], str, bool, bool, bool]] = []
        todo: list[tuple[Node | Alias, tuple[str, ...], bool, bool]] = [(root, (), True, False)]
        nodes = aliased = 0
        while todo:
            node, path, named, inside = todo.pop()
            if isinstance(node, Alias):
                nodes, aliased = nodes + 1, aliased + inside
                node, inside = node.node, True
            # a map counts with its keys
            visits = 1 + len(node.pairs)
            nodes, aliased = nodes + visits, aliased + visits * inside
            if aliased > FREE_NODES and nodes > 10 * FREE_NODES and aliased / nodes > _share(nodes):
                raise Invalid
            if node.kind == "scalar":
                found.append((list(path), node.text or ("" if node.string else "null"), node.string, named, False))
            elif len(path) == whole:
                found.append((list(path), _printed(node), True, named, True))
            elif node.kind == "list":
                todo += [(item, (*path, ITEM), named, inside) for item in reversed(node.items)]
            else:
                named = named and (node.strings or not path)
                pairs = [(value, (*path, _target(key).text), named, inside or k >= node.own) for k, (key, value) in enumerate(node.pairs)]
                todo += reversed(pairs)
    except Invalid:
        return []
    return found
