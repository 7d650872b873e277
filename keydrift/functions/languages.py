"""Access patterns of each language as data: what ``functions.accesses`` reads in a file and ``operators.usages`` classifies.

``~`` in a pattern stands for white space and comments. Patterns of tokens run in Python, those of operands, names and
operators in Spark's expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
WORD = r"[\p{L}\p{N}_$]++"
DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"
TRIPLE_DQ = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+(?:"""|\Z)'
TRIPLE_SQ = r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+(?:'''|\Z)"
RAW_BACKTICK = r"`[^`]*+`"
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"
HASH_COMMENT = r"#[^\n]*+"



def _alone(first: str, before: str = r"\w") -> str:
    """A first character or word that no character of ``before`` precedes; the look back stands behind it, so that a search
    passes over all text that starts with something else."""
    return rf"{first}(?<![{before}]{first})"


def _free(word: str) -> str:
    """A word that is not the tail of a longer name nor a member of something else ('...x' is a spread)."""
    return _alone(word, r"\w$") + rf"(?<!(?<!\.\.)\.{word})"


@dataclass(frozen=True)
class Language:
    """How one language reads environment variables.

    names         values of the ``language`` column
    needles       alternatives; a file lacking all texts of each holds no access
    bracketed     an access up to the bracket that its arguments stand in
    dotted        an access whose key is its only group
    chained       what turns the call behind an access into one, up to its bracket
    keys          literals that can be a key
    literals      all other literals that may hide brackets or quotes
    comments      comment forms
    nested        opening and closing of comments that nest
    template      start of a literal with holes in it; group 'q' is what ends it
    hole, escape  in such a literal: a hole's start, and what is no hole nor end
    template_is_key  such a literal can be a key
    slashes       a slash may start a regular expression literal, '<' an element
    operators     operators of the binary node kind
    prefixes      unary operators allowed before an operand
    operand       one operand after blanking
    keywords      words that are not identifier nodes
    one_argument  the bracket holds a single expression, not a list
    """

    names: tuple[str, ...]
    needles: tuple[tuple[str, ...], ...]
    bracketed: str
    keys: tuple[str, ...]
    comments: tuple[str, ...]
    operators: str
    prefixes: str
    keywords: tuple[str, ...]
    literals: tuple[str, ...] = ()
    dotted: str | None = None
    chained: str | None = None
    nested: tuple[str, str] | None = None
    template: str | None = None
    hole: str = r"\{"
    escape: str = r"\\[\s\S]"
    template_is_key: bool = False
    slashes: bool = False
    operand: str = WORD
    one_argument: bool = False

    def expanded(self, pattern: str) -> str:
        """The pattern with white space and comments for ``~``."""
        return pattern.replace("~", r"(?:\s|" + "|".join(self.comments) + ")*+")

    @property
    def name_regex(self) -> str:
        return rf"^(?!(?:{'|'.join(self.keywords)})$){NAME}$"

    @property
    def binary_regex(self) -> str:
        operand = rf"(?:{self.prefixes})*+{self.operand}(?:\s*(?:\?\.|\.|::)\s*{WORD})*+"
        return rf"^{operand}(?:\s*(?:{self.operators})\s*{operand})++$"


JAVASCRIPT = Language(
    names=("javascript", "typescript"),
    needles=(("process", "env"),),
    bracketed=_free("process") + r"~\??\.~env~(?:\?\.~)?\[",
    dotted=_free("process") + r"~\??\.~env~\??\.~((?:[^\W\d]|\$)[\w$]*+)",
    keys=(DQ, SQ),
    comments=(LINE_COMMENT, BLOCK_COMMENT),
    template="(?P<q>`)",
    hole=r"\$\{",
    slashes=True,
    operators=r">>>|===|!==|\*\*|\?\?|\|\||&&|==|!=|<<|>>|<=|>=|[-+*/%|&^<>]|\bin\b|\binstanceof\b",
    prefixes=r"[-+!~]\s*|(?:typeof|await|void|delete|new)\s+",
    keywords=("true", "false", "null", "undefined", "this", "super"),
    one_argument=True,
)
GO = Language(
    names=("go",),
    needles=(("Getenv",),),
    bracketed=_free("os") + r"~\.~Getenv~\(",
    keys=(DQ,),
    literals=(SQ, RAW_BACKTICK),
    comments=(LINE_COMMENT, BLOCK_COMMENT),
    operators=r"&\^|\|\||&&|==|!=|<<|>>|<=|>=|[-+*/%|&^<>]",
    prefixes=r"[-+!^*&]\s*|<-\s*",
    keywords=("true", "false", "nil", "iota"),
)
PYTHON = Language(
    names=("python",),
    needles=(("environ",), ("getenv",)),
    bracketed=_free("os") + r"~\.~(?:environ~\[|getenv~\()",
    keys=(*(_alone("[rRbBuU]") + "[rRbB]?" + q for q in (TRIPLE_DQ, TRIPLE_SQ, DQ, SQ)), TRIPLE_DQ, TRIPLE_SQ, DQ, SQ),
    comments=(HASH_COMMENT,),
    operators=r"\*\*|//|<<|>>|[-+*/%@|&^]",
    prefixes=r"[-+~]\s*|await\s+",
    keywords=("True", "False", "None"),
    template="(?:" + _alone("[fF]") + "[rR]?|" + _alone("[rR]") + r"""[fF])(?P<q>\"{3}|'{3}|"|')""",
    escape=r"\\[^{}]|\{\{|\}\}",
    template_is_key=True,
)
_RUST_STRING = r'"(?:[^"\\]|\\[\s\S])*+"'
RUST = Language(
    names=("rust",),
    needles=(("env", "var"),),
    bracketed="(?:" + _alone("std", r"\w:.") + "~::~env|" + _alone("env", r"\w:.") + r")~::~var(?:_os)?~\(",
    keys=(_alone("[bc]") + _RUST_STRING, _RUST_STRING),
    literals=(
        "(?:" + _alone("[bc]") + "r|" + _alone("r") + r')(?P<hashes>#*)"[\s\S]*?"(?P=hashes)',
        "(?:" + _alone("b") + r")?'(?:[^'\\\n]|\\[^ux\n]|\\u\{[0-9a-fA-F]++\}|\\x[0-9a-fA-F]{2})'",
    ),
    comments=(LINE_COMMENT, BLOCK_COMMENT),
    nested=(r"/\*", r"\*/"),
    operators=r"\|\||&&|==|!=|<<|>>|<=|>=|[-+*/%|&^<>]",
    prefixes=r"[-!*]\s*|&\s*(?:mut\s+)?",
    keywords=("true", "false", "self", "super", "crate", "Self"),
    operand=rf"{WORD}(?:!{WORD})?+\??",
)
JAVA = Language(
    names=("java",),
    needles=(("getenv",),),
    bracketed=_free("System") + r"~\.~getenv~\(",
    chained=r"~\.~get~\(",
    keys=(TRIPLE_DQ, DQ),
    literals=(SQ,),
    comments=(LINE_COMMENT, BLOCK_COMMENT),
    operators=r">>>|\|\||&&|==|!=|<<|>>|<=|>=|[-+*/%|&^<>]",
    prefixes=r"[-+!~]\s*|new\s+|0\s+(?=[\p{L}\p{N}_$])",  # 0 x: a cast
    keywords=("true", "false", "null", "this", "super"),
)

LANGUAGES = (JAVASCRIPT, GO, PYTHON, RUST, JAVA)
