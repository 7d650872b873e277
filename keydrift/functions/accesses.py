"""The environment accesses of a file and their arguments, by one pass over its tokens.

Strings, comments, regular expression literals, interpolated strings with holes, elements and brackets are told apart with a
stack of what is open: brackets may nest to any depth, a hole may hold any code, and that code further interpolated strings.
No regular expression keeps such a stack, so this part runs in Python, row by row inside an Arrow function; what an argument
is (a key, a variable, a composed name) is left to the expressions of ``operators.usages``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

from keydrift.functions.languages import Language

_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: Kinds of tokens that matter only as parts of an argument.
_PASSED = frozenset("klc")
#: Words behind which an operand follows, or whose bracket is none.
_BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do instanceof yield await default extends".split())
_CONDITION = re.compile(r"(?<![\w$.])(?:if|while|for|with)\Z")
_BLOCK = re.compile(r"(?<![\w$.])(?:else|do|try|finally)\Z")
#: A character or word that an operator of some language holds.
_OPERATOR = re.compile(r"[-+*/%|&^<>=!?@~]|\b(?:in|instanceof)\b")
_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/\w*+"
_ELEMENT = r"<(?P<tag>(?:[^\W\d]|\$)[\w$.:-]*+)?(?=[\s/>])(?!\s+extends\b)"


class _Open:
    """Something open: a bracket ('(', '[' or '{'), a template ('t'), a tag ('<') or the text of an element ('>').

    Of an access, ``seen`` is where the argument at hand begins and ``parts`` are its literals, groups and comments;
    ``last`` if the call behind it counts no more.
    """

    __slots__ = ("access", "end", "kind", "last", "parts", "seen", "start")

    def __init__(self, kind: str, start: int, end: str = "", access: int = -1, last: bool = False) -> None:
        self.kind, self.start, self.end, self.access, self.last = kind, start, end, access, last
        self.parts: list[tuple[int, int, str]] = []
        self.seen = access


@lru_cache(maxsize=16)
def _patterns(rule: Language) -> dict[str, re.Pattern]:
    def group(name: str, parts: tuple[str, ...]) -> list[str]:
        return [f"(?P<{name}>{'|'.join(parts)})"] if parts else []

    parts = [
        *(group("n", (rule.nested[0],)) if rule.nested else []),
        *group("c", rule.comments),
        *group("t", (rule.template,) if rule.template else ()),
        *group("k", rule.keys),
        *group("l", rule.literals),
        *([f"(?P<d>{rule.expanded(rule.dotted)})"] if rule.dotted else []),
        *group("a", (rule.expanded(rule.bracketed),)),
        r"(?P<o>[(\[{])",
        r"(?P<e>[)\]}])",
        *([r"(?P<s>[/<])"] if rule.slashes else []),
    ]
    found = {"code": re.compile("|".join(parts)), "listed": re.compile("|".join([*parts, "(?P<m>,)"]))}
    # outside of all accesses and holes brackets tell nothing, but for what a slash is
    found["flat"] = found["code"] if rule.slashes else re.compile("|".join(p for p in parts if p[:5] not in ("(?P<o", "(?P<e")))
    for name in ("code", "flat"):
        found["over " + name] = _passed_over(rule, brackets=rule.slashes or name == "code")
    if rule.chained:
        found["chained"] = re.compile(rule.expanded(rule.chained))
    if rule.nested:
        found["nested"] = re.compile("|".join(rule.nested))
    if rule.template:
        for quote in ("`", '"', "'", '"""', "'''"):
            found[quote] = re.compile(f"{rule.escape}|(?P<h>{rule.hole})|(?P<q>{re.escape(quote)})")
    found["regex"], found["element"] = re.compile(_REGEX), re.compile(_ELEMENT)
    found["<"] = re.compile(r"""(?P<o>\{)|(?P<end>/\s*>)|(?P<text>>)|"[^"]*"|'[^']*'|//[^\n]*+|/\*[\s\S]*?\*/""")
    found[">"] = re.compile(r"(?P<o>\{)|(?P<close></[^>]*>)|(?P<element><(?=[\w$>]))")
    return found


def _passed_over(rule: Language, brackets: bool) -> re.Pattern:
    """A run of text that holds no token but literals and comments. It may end early, where a mark or a word needs a search.

    Marks and words are tried where they begin: what starts with a letter starts no token inside a word.
    """
    marks = "\"'`/<#" + (r"()\[\]{}" if brackets else "")
    accesses = [*([rule.expanded(rule.dotted)] if rule.dotted else []), rule.expanded(rule.bracketed)]
    before_literals = [*([rule.nested[0]] if rule.nested else []), *([rule.template] if rule.template else [])]
    not_before = f"(?!{'|'.join(before_literals)})" if before_literals else ""
    comment = (f"(?!{rule.nested[0]})" if rule.nested else "") + f"(?:{'|'.join(rule.comments)})"
    literal = "|".join((*rule.keys, *rule.literals))
    return re.compile(rf"(?:[^\w{marks}]++|{comment}|{not_before}(?:{literal}|(?!{'|'.join(accesses)})\w++))*+")


class _Scan:
    def __init__(self, text: str, rule: Language, elements: bool) -> None:
        self.text, self.rule, self.elements = text, rule, elements
        self.patterns = _patterns(rule)
        self.stack: list[_Open] = []
        self.found: list[tuple[int, str, str, bool, bool]] = []
        self.comments: dict[int, int] = {}  # end -> start
        self.over = (0, 0, "flat")  # what was passed over last, its comments not told apart yet
        self.pending: list[dict[str, int]] = [{}]  # closers waited for, in each hole
        self.brackets: dict[int, int] = {}  # closing -> opening

    def part(self, start: int, end: int, kind: str) -> None:
        """A token of the argument at hand, where one is open directly."""
        if self.stack and self.stack[-1].access >= 0:
            self.stack[-1].parts.append((start, end, kind))

    def argument(self, top: _Open, end: int) -> None:
        """The argument at hand ends: its text between its first and last token, and the same with 0 for literals and
        groups. One without an operator that is no literal nor name names nothing."""
        text, first, parts = self.text, top.seen, top.parts
        comments = {s: e for s, e, kind in parts if kind == "c"}
        while first < end and (text[first].isspace() or first in comments):
            first = comments.get(first, first + 1)
        last, ends = end, {e: s for s, e in comments.items()}
        while last > first and (text[last - 1].isspace() or last in ends):
            last = ends.get(last, last - 1)
        pieces, at = [], first
        for s, e, kind in parts:
            if s >= first and e <= last:
                pieces += [text[at:s], " " if kind == "c" else "0"]
                at = e
        pieces.append(text[at:last])
        blank, key = "".join(pieces), any(kind == "k" and (s, e) == (first, last) for s, e, kind in parts)
        if key or (last > first and (not parts or _OPERATOR.search(blank))):
            self.found.append((first, text[first:last], blank, key, True))

    def operand_expected(self, pos: int) -> bool:
        """Whether a slash or '<' here starts an operand instead of dividing or comparing."""
        text, at = self.text, pos - 1
        while at >= 0:
            start = self.comment_before(at + 1)
            if start is None and not text[at].isspace():
                break
            at = (at if start is None else start) - 1
        if at < 0:
            return True
        c = text[at]
        if c in ")]}":
            return at in self.brackets and self.leaves_none(self.brackets[at])
        if c.isalnum() or c in "_$":
            first = at
            while first > 0 and at - first < 12 and (text[first - 1].isalnum() or text[first - 1] in "_$"):
                first -= 1
            return text[first : at + 1] in _BEFORE_OPERAND and text[first - 1 : first] != "."
        return c not in "\"'`" and not (c in "+-" and text[at - 1 : at] == c)

    def comment_before(self, pos: int) -> int | None:
        """Where the comment starts that ends here. Those of what was passed over last are told apart when one may end here;
        what ended the pass is no white space, so no walk goes back behind it."""
        at, end, name = self.over
        if at < pos <= end and (self.text[pos] == "\n" or self.text[pos - 1] == "/"):
            search = self.patterns[name].search
            while at < end and (m := search(self.text, at, end)):
                at = m.end()
                if m.lastgroup == "c":
                    self.comments[at] = m.start()
            self.over = (end, end, name)
        return self.comments.get(pos)

    def open(self, kind: str, start: int, access: int = -1, last: bool = False) -> None:
        end = _CLOSES[kind]
        self.pending[-1][end] = self.pending[-1].get(end, 0) + 1
        self.stack.append(_Open(kind, start, end, access, last))

    def hole(self, start: int) -> None:
        self.stack.append(_Open("{", start, "hole"))
        self.pending.append({})

    def leaves_none(self, pos: int) -> bool:
        """Whether the bracket opened here is no operand: a condition or a block."""
        before = self.text[max(0, pos - 40) : pos].rstrip()
        if self.text[pos] == "(":
            return bool(_CONDITION.search(before))
        return self.text[pos] == "{" and (not before or before[-1] in ");{}" or before.endswith("=>") or bool(_BLOCK.search(before)))

    def close(self, start: int, end: int) -> int:
        """The end of the innermost open bracket of this kind; one that is not open is passed over."""
        c, waiting = self.text[start], self.pending[-1]
        if self.stack and self.stack[-1].end == c and self.stack[-1].access < 0:
            top = self.stack.pop()
            waiting[c] -= 1
            if self.rule.slashes:
                self.brackets[start] = top.start
            if self.stack and self.stack[-1].access >= 0:
                self.stack[-1].parts.append((top.start, end, "g"))
            return end
        if c == "}" and not waiting.get("}") and len(self.pending) > 1:
            while self.stack.pop().end != "hole":
                pass
            self.pending.pop()
            return end
        if not waiting.get(c):
            return end
        while True:
            top = self.stack.pop()
            waiting[top.end] = waiting.get(top.end, 0) - 1
            if top.end == c:
                break
        if self.rule.slashes:
            self.brackets[start] = top.start
        if top.access >= 0:
            self.argument(top, start)
        self.part(top.start, end, "g")
        chained = self.patterns.get("chained")
        if top.access >= 0 and chained and not top.last:
            m = chained.match(self.text, end)
            if m:
                self.open("(", start, m.end(), last=True)
                return m.end()
        return end

    def code(self, pos: int) -> int:
        """The next token of code that changes what is open or is part of an access; -1 at the end."""
        top = self.stack[-1] if self.stack else None
        inside = top is not None and top.access >= 0
        if inside:
            m = self.patterns["code" if self.rule.one_argument else "listed"].search(self.text, pos)
        else:
            # literals and comments change nothing here and are passed over at once
            text, comments, name = self.text, self.comments, "code" if top else "flat"
            search, over = self.patterns[name].search, self.patterns["over " + name].match
            end = over(text, pos).end()
            self.over = pos, end, name
            m = search(text, end)
            while m and (kind := m.lastgroup) in _PASSED:
                pos = m.end()
                if kind == "c":
                    comments[pos] = m.start()
                end = over(text, pos).end()
                self.over = pos, end, name
                m = search(text, end)
        if not m:
            return -1
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "o":
            self.open(m[0], start)
        elif kind == "e":
            return self.close(start, end)
        elif kind == "c":
            self.comments[end] = start
            self.part(start, end, "c")
        elif kind == "n":
            depth, nested = 1, self.patterns["nested"]
            while depth:
                inner = nested.search(self.text, end)
                end = inner.end() if inner else len(self.text)
                depth = depth + (1 if inner[0].startswith("/") else -1) if inner else 0
            self.comments[end] = start
            self.part(start, end, "c")
        elif kind in "kl":
            self.part(start, end, kind)
        elif kind == "t":
            self.stack.append(_Open("t", start, m["q"]))
        elif kind == "d":
            name = m.group(m.re.groupindex["d"] + 1)
            self.found.append((m.end() - len(name), name, name, False, False))
        elif kind == "a":
            self.open(self.text[end - 1], start, end)
        elif kind == "m":
            self.argument(top, start)
            top.seen, top.parts = end, []
        elif kind == "s" and self.operand_expected(start):
            if m[0] == "/":
                literal = self.patterns["regex"].match(self.text, start)
                if literal:
                    self.part(start, literal.end(), "l")
                    return literal.end()
            elif self.elements:
                element = self.patterns["element"].match(self.text, start)
                if element:
                    self.stack.append(_Open("<", start))
                    return element.end()
        return end

    def ended(self, top: _Open, end: int) -> int:
        """A template or an element is one literal of what it stands in."""
        self.part(top.start, end, "k" if top.kind == "t" and self.rule.template_is_key else "l")
        return end

    def other(self, top: _Open, pos: int) -> int:
        """The next token inside a template, a tag or an element's text."""
        m = self.patterns[top.end if top.kind == "t" else top.kind].search(self.text, pos)
        if not m:
            return -1
        if top.kind == "t":
            if m.lastgroup == "h":
                self.hole(m.start())
            elif m.lastgroup == "q":
                self.stack.pop()
                return self.ended(top, m.end())
        elif m.lastgroup == "o":
            self.hole(m.start())
        elif m.lastgroup == "text":
            top.kind = ">"
        elif m.lastgroup == "element":
            element = self.patterns["element"].match(self.text, m.start())
            if element:
                self.stack.append(_Open("<", m.start()))
                return element.end()
        elif m.lastgroup in ("end", "close"):
            self.stack.pop()
            return self.ended(top, m.end())
        return m.end()

    def run(self) -> bool:
        """False where an element's end never came: what looked like one was none."""
        pos = 0
        while pos >= 0:
            top = self.stack[-1] if self.stack else None
            pos = self.other(top, pos) if top is not None and top.kind in "t<>" else self.code(pos)
        return not any(o.kind in "<>" for o in self.stack)


def accesses(text: str, rule: Language) -> list[tuple[int, str, str, bool, bool]]:
    """(place, text, blank, literal, bracketed) of every argument of every access, by place."""
    scan = _Scan(text, rule, rule.slashes)
    if not scan.run():
        scan = _Scan(text, rule, False)
        scan.run()
    return sorted(scan.found)


def placed(text: str, rule: Language, white_space: str) -> tuple[list[str], list[tuple[int, int, str, str, bool, bool]]]:
    """The lines that hold an argument, trimmed, and each argument as (line, index of its line, text, blank, literal,
    bracketed). Lines are cut once each, however many accesses stand on them."""
    found = accesses(text, rule)
    if not found:
        return [], []
    ends = [m.start() for m in re.finditer("\n", text)]
    lines: list[str] = []
    at: dict[int, int] = {}
    out = []
    for place, expr, blank, literal, bracketed in found:
        line = bisect_right(ends, place - 1) if place else 0
        if line not in at:
            at[line] = len(lines)
            first = ends[line - 1] + 1 if line else 0
            lines.append(text[first : ends[line] if line < len(ends) else len(text)].strip(white_space))
        out.append((line + 1, at[line], expr, blank, literal, bracketed))
    return lines, out
