"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: a list of trigram sets of which one must be
present whole. The index holds the postings of the trigrams that any query names; intersecting them gives the candidates
of each rule, and only those texts run its expression. Rules without mandatory trigrams (``hex``) scan every text.

The index is over ``lower(text)``; that can only add candidates. Postings are keyed by (doc_id, hash of the text), so
documents that share a doc_id are kept apart.

Defined cases: a null text is empty and has no spans; equal rows get equal results; an empty table gives an empty table;
further columns are not read. Texts have no length limit; expressions use no repeated groups, whose matching would recurse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import spans, tables

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """Matches whose ``group`` has ``least`` characters or more are secrets; others are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 12, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, base=True),
    # runs of 16 or more only: shorter ones would be dropped, and no match starts inside a run
    Rule("hex", r"[0-9a-f]{16,}", 16, base=True),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 16, 1),
)
MOST_ALTERNATIVES = 64


def _strings(tree) -> tuple[list[set[str]], bool]:
    """For a parsed expression: the runs of finite string sets that every match contains in turn, and whether the
    single run returned is all of the match."""
    runs: list[set[str]] = [{""}]
    whole = True

    def cross(piece: set[str]) -> None:
        if len(runs[-1]) * len(piece) > MOST_ALTERNATIVES:
            cut()
        if len(piece) <= MOST_ALTERNATIVES:
            runs[-1] = {a + b for a in runs[-1] for b in piece}
        else:
            cut()

    def cut() -> None:
        nonlocal whole
        whole = False
        runs.append({""})

    for op, value in tree:
        if op is sre.LITERAL:
            cross({chr(value).lower()})
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, v in value:
                if kind is sre.LITERAL:
                    chars.add(chr(v).lower())
                elif kind is sre.RANGE:
                    chars |= {chr(c).lower() for c in range(v[0], min(v[1], v[0] + 256) + 1)}
                    chars = None if v[1] - v[0] > 256 else chars
                else:
                    chars = None
                if chars is None:
                    break
            cross(chars) if chars and len(chars) <= 8 else cut()
        elif op is sre.SUBPATTERN:
            inner, all_ = _strings(value[3])
            if all_:
                cross(inner[0])
            else:
                runs.extend(inner)
                cut()
        elif op is sre.BRANCH:
            branches = [_strings(b) for b in value[1]]
            if all(w for _, w in branches):
                cross(set().union(*(r[0] for r, _ in branches)))
            else:
                cut()
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = value
            inner, all_ = _strings(body)
            if all_ and int(most) <= 1:
                cross(inner[0] | {""} if least == 0 else inner[0])
            elif least >= 1:
                if all_:
                    cross(inner[0])
                else:
                    runs.extend(inner)
                cut()
            else:
                cut()
        elif op is sre.AT:
            pass
        else:
            cut()
    return runs, whole


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Trigram sets of which one is wholly in any matching text, lower-cased. No set: nothing is mandatory."""
    runs, _ = _strings(sre_parser.parse(pattern))
    options: list[frozenset[str]] = [frozenset()]
    for run in runs:
        if min(len(s) for s in run) < 3:
            continue
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if len(options) * len(sets) <= MOST_ALTERNATIVES:
            options = [a | b for a in options for b in sets]
    kept = {a for a in options if not any(b < a for b in options)}
    return [] if frozenset() in kept else sorted(kept, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, key): the inverted index, for the given trigrams."""
    text = F.coalesce(F.col("text"), F.lit(""))
    present = spans.let(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    return docs.select(F.explode(present).alias("trigram"), "doc_id", F.xxhash64(text).alias("key"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, key, kinds): texts in which a rule's trigram query holds, by intersecting postings."""
    spark = docs.sparkSession
    asked = [
        (r.kind, k, (1 << min(len(t), 63)) - 1, 1 << i, x)
        for r in rules
        for k, t in enumerate(trigram_query(r.pattern))
        for i, x in enumerate(sorted(t)[:63])
    ]
    terms = spark.createDataFrame(asked, "kind string, option int, need long, bit long, trigram string")
    # one bit a trigram: repeated rows set it twice and count once
    met = postings(docs, sorted({x for *_, x in asked})).join(terms, "trigram").groupBy("doc_id", "key", "kind", "option", "need")
    full = met.agg(F.bit_or("bit").alias("bits")).where("bits = need")
    return full.groupBy("doc_id", "key").agg(F.collect_set("kind").alias("kinds"))


def _found(text: Column, rule: Rule, order: int) -> Column:
    found = spans.matches(text, rule.pattern)
    if rule.group:
        kept = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, rule.group)) >= rule.least)
    elif rule.least:
        kept = F.filter(found, lambda s: s["end"] - s["start"] >= rule.least)
    else:
        kept = found
    return spans.tagged(kept, rule.kind, order)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans``, (start, ord, kind, end, value) in order of place, then of the rules; a row for each input row."""
    docs = docs.select("doc_id", "text")
    text = F.coalesce(F.col("t.text"), F.lit(""))
    free = [r.kind for r in rules if not trigram_query(r.pattern)]
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(text) == F.col("c.key"))
    rows = docs.alias("t").join(candidates(docs, rules).alias("c"), same, "left")
    parts = [
        _found(text, r, k) if r.kind in free else F.when(F.array_contains("kinds", r.kind), _found(text, r, k)).otherwise(
            spans.empty("struct<start:int,ord:int,kind:string,end:int,value:string>"))
        for k, r in enumerate(rules)
    ]
    return rows.select("t.doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(tables.table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *(spans.count(F.col("spans"), k).alias(f"n_{k}") for k in base),
        spans.sha256(spans.joined(kept)).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"),
    )
