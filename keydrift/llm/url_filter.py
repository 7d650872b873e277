"""URL verdicts: rules by host and path first, then naive Bayes over the words that a URL's names are made of.

1. *Names.* A URL's host and path are cut at everything but letters and digits; host and path names are told apart.
2. *Words.* How often each word stands in the pages' texts, and as a separate name of the URLs, is counted. A name is cut
   into its most probable words (Viterbi over a unigram model): substrings of the distinct names meet the counts in a join,
   so neither the counts nor the names are ever in one place. Unknown words cost more with each letter.
3. *Classes.* A URL with a word of ``UNWANTED`` among its words is an example to block, any other one to allow. Rules are
   no examples: they speak of whole zones, whatever stands there.
4. *Scores.* Multinomial naive Bayes over words, smoothed by one. Each distinct name gets the sum of its words' weights, a
   URL the sum over its names and the prior; above 0 it is blocked.

All tables are long; names that stand in many URLs are cut into parts before they are joined (``spread_join``), and equal
URLs are judged once.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and has the prior's verdict;
without an example to block everything is allowed by the method; names of more than ``LONGEST`` letters are one word each;
repeated rows get equal verdicts; a null html has no words; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import tables
from keydrift.operators.skew import hot_groups, spread_join

#: Words of hosts and paths that mark what is not wanted, and the count each has in the unigram model.
UNWANTED = (
    "ad ads adserver adult banner bet bets betting casino cialis click clickbait crack dating doorway escort gambling "
    "jackpot keygen lottery payday pharmacy phishing pills poker porn replica seo sex slots spam torrent track tracker "
    "tracking viagra warez webcam xxx"
).split()
KNOWN = 1000
#: Letters of the longest word, and of the longest name that is cut (a host's label has 63 at most).
LONGEST_WORD = 24
LONGEST = 63


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and how the path has to start."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


# ---------------------------------------------------------------- urls and rules


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(action, name) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<action:string,name:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.action).alias("action"), F.lit(r.name).alias("name"))).otherwise(found)
    return found


def names(text: Column) -> Column:
    """Runs of letters and runs of digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


# ---------------------------------------------------------------- words


def word_counts(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """word, n: the words of the pages' texts (markup left out) and names that something separates from others."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style)\b.*?</\1|<[^>]*+>|&\w+;", " ")
    texts = pages.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    apart = listed.where("apart").select(F.col("name").alias("word"))
    known = pages.sparkSession.createDataFrame([(w, KNOWN) for w in UNWANTED], "word string, n long")
    counted = texts.unionByName(apart).where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(known).groupBy("word").agg(F.sum("n").alias("n"))


def segmented(name: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable words of a name; of equals the one whose last words are longer."""
    if len(name) > LONGEST:
        return [name]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(end):
            n = known.get(name[start:end])
            # an unknown word of k letters is as likely as ten words in total * 10^k
            score = log(n / total) if n else log(10 / total) - (end - start) * log(10)
            options.append((best[start][0] + score, -start))
        score, start = max(options)
        best.append((score, -start))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def name_words(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words: each distinct name (name) cut into words."""
    counts = tables.stored(counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    letters = distinct.where(F.regexp_like("name", F.lit(r"^\p{L}+$")) & (F.length("name") <= LONGEST))
    places = F.sequence(F.lit(1), F.length("name"))
    ends = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("start") + 1))
    parts = letters.select("name", F.explode(places).alias("start")).select("name", F.explode(F.transform(ends, lambda k: F.substring(F.col("name"), F.col("start"), k))).alias("word"))
    parts = tables.stored(parts.distinct())
    met = spread(parts, counts, ["word"], "inner", ["name"])
    found = met.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [segmented(name, {k["word"]: k["n"] for k in known or []}, total) for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    # names without any known part, numbers and very long names come with none
    whole = distinct.join(found.hint("merge"), "name", "left")
    return whole.mapInArrow(cut, "name string, words array<string>")


def spread(many: DataFrame, one: DataFrame, on: list[str], how: str, by: list[str]) -> DataFrame:
    """``spread_join`` that cuts whatever is larger than a quarter of an even share of a task."""
    counts = tables.stored(many.groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread_join(many, one, on, how, by, hot_groups(counts, on, hot_rows=rows // (4 * tasks) + 1))


# ---------------------------------------------------------------- classes and scores


def url_names(urls: DataFrame) -> DataFrame:
    """url, side, name, apart: each name of each URL once; ``apart`` where other names of its label or the path stand
    beside it, so that it is no concatenation."""

    def listed(text: Column, side: str, apart: Column) -> Column:
        return F.transform(names(text), lambda n: F.struct(F.lit(side).alias("side"), n.alias("name"), apart.alias("apart")))

    labels = F.split(F.col("host"), r"\.")
    of_host = F.flatten(F.transform(labels, lambda label: listed(label, "host", F.size(names(label)) > 1)))
    every = F.array_distinct(F.concat(of_host, listed(F.col("path"), "path", F.lit(True))))
    return urls.select("url", F.inline(every))


def word_weights(listed: DataFrame, words: DataFrame) -> tuple[DataFrame, float]:
    """side, word, weight: the logarithm of how much likelier a word is in URLs to block; and the prior's logarithm."""
    marked = words.withColumn("marked", F.arrays_overlap("words", F.array(*map(F.lit, UNWANTED))))
    met = tables.stored(spread(listed.select("url", "side", "name"), marked, ["name"], "inner", ["url"]))
    classes = met.groupBy("url").agg(F.max("marked").alias("block"))
    sizes = {r["block"]: r["n"] for r in classes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    # names first: few rows are left when they are cut into words
    of_class = met.select("url", "side", "name", "words").join(classes.hint("merge"), "url")
    by_name = of_class.groupBy("side", "name", "words").agg(F.count_if("block").alias("n1"), F.count_if(~F.col("block")).alias("n0"))
    counts = tables.stored(
        by_name.select("side", F.explode("words").alias("word"), "n0", "n1").groupBy("side", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    t = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("words")).first()
    if not sizes.get(True) or not sizes.get(False):
        # one class only: words tell nothing
        return counts.select("side", "word", F.lit(0.0).alias("weight")), 1.0 if sizes.get(True) else -1.0
    ratio = F.log((F.col("n1") + 1) / F.lit(t["n1"] + t["words"])) - F.log((F.col("n0") + 1) / F.lit(t["n0"] + t["words"]))
    return counts.select("side", "word", ratio.alias("weight")), log(sizes[True] / sizes[False])


def url_scores(pages: DataFrame, urls: DataFrame) -> tuple[DataFrame, float]:
    """url, score of every distinct URL with a name in it, and the score of those without."""
    listed = tables.stored(url_names(urls))
    words = tables.stored(name_words(listed.select("name").distinct(), word_counts(pages, listed)))
    weights, prior = word_weights(listed, words)
    # every distinct name with its words, each side by itself: few rows beside the URLs'
    sides = listed.select("side", "name").distinct().join(words.hint("merge"), "name")
    exploded = tables.stored(sides.select("side", "name", F.explode("words").alias("word")))
    of_names = spread(exploded, weights, ["side", "word"], "inner", ["name"]).groupBy("side", "name").agg(F.sum("weight").alias("weight"))
    met = spread(listed.select("url", "side", "name"), of_names, ["side", "name"], "inner", ["url"])
    # added in whole millionths, so that neither the order of rows nor their partitions show
    score = F.sum(F.round(F.col("weight") * 1_000_000).cast("long")) / 1_000_000 + F.lit(prior)
    return met.groupBy("url").agg(score.alias("score")), prior


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    parts = {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    pages = pages.select("page_id", "url", "html")
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().withColumns(parts)
    scores, prior = url_scores(pages, urls)
    scored = spread(pages.select("page_id", "url"), scores, ["url"], "left", ["page_id"])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = scored.withColumns(parts).withColumn("score", F.coalesce("score", F.lit(prior))).withColumn("_rule", rule)
    method = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), F.coalesce("_rule.action", method).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(tables.table(spark, sf_dir, "pages"))
