"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans are the base matches of each kind and looser ones. Regex, gazetteer and context labelers vote on each
(yes, no, abstain). Expectation-maximisation over the counted vote patterns of all documents estimates how reliable each
labeler is for each kind, which gives every pattern a probability. A logistic span classifier is then trained on those
probabilities with votes and the span's shape as inputs; it decides on the looser candidates. Base spans stay.

Only counts of patterns reach the driver: kinds x 3^labelers x shapes of a few values each, whatever the corpus.

Defined cases: a null text is empty and has no spans; equal rows get equal results and each counts in the statistics; an
empty table gives an empty table and trains nothing; further columns are not read. Texts have no length limit: expressions
start at the beginning of a run of their characters, so they don't rescan it, and groups are repeated possessively or a
few times, which Java does without recursion.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import spans, tables


@dataclass(frozen=True)
class Kind:
    name: str
    base: str | None
    loose: tuple[str, ...]
    context: str


LOCAL = r"[A-Za-z0-9._%+-]"
#: A match can start where its class begins, or right behind the match before.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
KINDS = (
    Kind("email", "email", (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{2,64}(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z]{2,12}",), "mail|contact|kontakt|correo|courriel|write"),
    Kind("ip", "ip", (), "\\bip\\b|address|adresse|host|server|from|login"),
    Kind("card", "card", (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",), "card|visa|karte|tarjeta|carte|credit|pay"),
    Kind("phone", "phone", (r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",), "phone|tel|call|mobile|fax|anruf|llam"),
    Kind("national_id", None, (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",), "ssn|social|security|insurance"),
    Kind("iban", None, (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",), "iban|account|konto|cuenta|compte|bank"),
)
#: The base expressions. ``card``: runs of 16 to 19 digits only, as others would be dropped and no match starts in a run.
BASE = {
    "email": EMAIL,
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Gazetteers. Frequent top-level domains, telephone country codes, card issuers' first digits.
DOMAINS = "com org net edu gov info io co uk de fr es it eu ch at nl us ca au".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 81 82 86 90 91".split()
ISSUERS = "3 4 5 6".split()
COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
AROUND = 32
LABELERS = ("shape", "gazetteer", "context", "edges", "checksum")
FOUND = "struct<start:int,ord:int,kind:string,end:int,base:boolean,votes:array<int>,digits:int>"
ROUNDS = 50


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def _parts_fit(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(F.lpad(F.substring(part(p), 1, 3), 3, "0"), F.lit("999")), F.lit(999)) <= 255))


def _valid(kind: str, value: Column) -> Column:
    """The base contract's condition on a match."""
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": _parts_fit(value),
        "card": (n >= 16) & (n <= 19) & luhn(_digits(value)),
        "phone": (n >= 8) & (n <= 15),
    }[kind]


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, F.lit(1))
    return v.otherwise(F.lit(-1)) if no is None else v.when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: Kind, text: Column, s: Column, base: bool) -> Column:
    value, digits = s["value"], _digits(s["value"])
    before = F.lower(F.substring(text, F.greatest(s["start"] - AROUND + 1, F.lit(1)), F.least(s["start"], F.lit(AROUND))))
    prior = F.when(s["start"] == 0, F.lit("")).otherwise(F.substring(text, s["start"], 1))
    after = F.substring(text, s["end"] + 1, 1)
    known = {
        "email": F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(DOMAINS),
        "ip": ~F.split(value, r"\.")[0].isin("0", "127", "255"),
        "card": F.substring(digits, 1, 1).isin(ISSUERS),
        "phone": F.substring(digits, 1, 1).isin(CALLING) | F.substring(digits, 1, 2).isin(CALLING),
        "national_id": ~F.substring(digits, 1, 3).isin("000", "666"),
        "iban": F.substring(value, 1, 2).isin(COUNTRIES),
    }[kind.name]
    shape = F.lit(1) if base else F.lit(0)
    check = _vote(luhn(digits)) if kind.name == "card" else F.lit(0)
    return F.array(
        shape, _vote(known), _vote(F.regexp_like(before, F.lit(kind.context)), F.regexp_like(before, F.lit(r"version|isbn|order|serial|\bid\b"))),
        _vote((F.length(prior) == 0) | F.regexp_like(prior, F.lit(r"[^A-Za-z0-9_]")), F.regexp_like(after, F.lit(r"[A-Za-z0-9_]"))), check,
    )


def _kind_spans(text: Column, kind: Kind, order: int) -> Column:
    def rows(found: Column, base: bool) -> Column:
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), s["end"].alias("end"),
            F.lit(base).alias("base"), _votes(kind, text, s, base).alias("votes"),
            F.least(F.length(_digits(s["value"])), F.lit(20)).alias("digits"))).cast(f"array<{FOUND}>")

    parts = []
    if kind.base:
        parts.append(rows(F.filter(spans.matches(text, BASE[kind.base]), lambda s: _valid(kind.base, s["value"])), True))
    parts += [rows(spans.matches(text, p), False) for p in kind.loose]
    if len(parts) == 1:
        return parts[0]
    # a looser span that meets a base span of its kind adds nothing
    apart = lambda base, x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return spans.let(parts[0], lambda base: F.concat(base, F.filter(F.concat(*parts[1:]), lambda x: apart(base, x))))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: every candidate with its votes; a row for each input row, in one projection."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*(_kind_spans(F.col("text"), k, i) for i, k in enumerate(KINDS)))
    return docs.select("doc_id", text.alias("text")).select("doc_id", every.alias("found"))


def patterns(found: DataFrame) -> list[tuple[str, bool, tuple[int, ...], int, int]]:
    """(kind, base, votes, digits, count) over all documents."""
    each = found.select(F.inline("found")).groupBy("kind", "base", "votes", "digits").count()
    return [(r["kind"], r["base"], tuple(r["votes"]), r["digits"], r["count"]) for r in each.collect()]


def reliabilities(counted) -> dict[tuple[str, tuple[int, ...]], float]:
    """The probability that a span is personal data, by kind and votes: two-class expectation-maximisation over labelers
    that are independent given the class, each kind on its own, smoothed by one vote that agrees with the labeler."""
    by_kind: dict[str, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for kind, _, votes, _, n in counted:
        by_kind[kind][votes] += n
    out = {}
    for kind, votes in by_kind.items():
        sure = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in votes}
        for _ in range(ROUNDS):
            total = sum(votes.values())
            prior = (sum(n * sure[v] for v, n in votes.items()) + 1) / (total + 2)
            table = []
            for k in range(len(LABELERS)):
                rows = {}
                for c in (0, 1):
                    weight = {x: 1.0 + 2.0 * (x == (1 if c else -1)) for x in (-1, 0, 1)}
                    for v, n in votes.items():
                        weight[v[k]] += n * (sure[v] if c else 1 - sure[v])
                    whole = sum(weight.values())
                    rows[c] = {x: w / whole for x, w in weight.items()}
                table.append(rows)
            for v in votes:
                odds = math.log(prior / (1 - prior)) + sum(math.log(t[1][x] / t[0][x]) for t, x in zip(table, v, strict=True))
                sure[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): p for v, p in sure.items()}
    return out


def _inputs(kind: str, votes: tuple[int, ...], digits: int) -> list[float]:
    return [1.0, *map(float, votes), *(float(kind == k.name) for k in KINDS), digits / 20]


def train(counted, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of the span classifier: logistic regression on the estimated probabilities, by gradient steps over the
    counted patterns. Nothing counted: all weights 0."""
    sure = reliabilities(counted)
    total = sum(n for *_, n in counted)
    w = [0.0] * len(_inputs("", (0,) * len(LABELERS), 0))
    for _ in range(steps if total else 0):
        grad = [decay * x for x in w]
        for kind, _, votes, digits, n in counted:
            x = _inputs(kind, votes, digits)
            miss = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - sure[kind, votes]
            for k, v in enumerate(x):
                grad[k] += miss * v * n / total
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (start, ord, kind, end, base): base spans, and those that the trained classifier accepts."""
    found = tables.stored(candidates(docs))
    w = train(patterns(found))
    n = len(LABELERS)

    def accepted(s: Column) -> Column:
        z = F.lit(w[0]) + s["digits"] / 20 * w[-1]
        for k in range(n):
            z = z + s["votes"][k] * w[1 + k]
        for k, kind in enumerate(KINDS):
            z = z + F.when(s["kind"] == kind.name, F.lit(w[1 + n + k])).otherwise(F.lit(0.0))
        return s["base"] | (z > 0)

    return found.select("doc_id", F.sort_array(F.filter("found", accepted)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(tables.table(spark, sf_dir, "documents"))
    def of(rows: Column, kind: str) -> Column:
        return F.filter(rows, lambda s: s["kind"] == kind)

    every, base = F.col("spans"), F.filter("spans", lambda s: s["base"])
    by_kind = F.flatten(F.array(*(of(base, k) for k in BASE)))
    counts = [F.size(of(base, k)).cast("long").alias(f"n_{k}") for k in BASE]
    all_kinds = F.flatten(F.array(*(of(every, k.name) for k in KINDS)))
    return found.select("doc_id", *counts, spans.sha256(spans.joined(by_kind)).alias("base_sha256"), spans.joined(all_kinds).alias("spans"))
