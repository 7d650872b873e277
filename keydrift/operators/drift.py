"""The drift analysis: used keys against defined keys, per repository.

Usages are reduced to one row per key before anything is compared
(``key_profile``, ``partial_groups``): the reductions combine map-side, so a key
that holds a third of all usages crosses the network as a handful of rows. The
comparisons then run between tables that are unique on ``(repo_id, key)``. Only
the final look-up of the usages to report touches usage rows again, with hot
keys split (``spread_join``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keydrift.operators.skew import hot_groups, spread_join

KEY = ["repo_id", "key"]
GROUP = ["repo_id", "group_key"]
PLACE = ["file", "line", "code_snippet"]

#: Writes a table under a name and reads it back; without one nothing is written and results stay lazy.
Stage = Callable[[DataFrame, str], DataFrame]

MISSING, IGNORED_FOLDER, IGNORED_KEY, UNUSED, FINE = "missing", "ignored_folder", "ignored_key", "unused", "fine"


def split_static_partial(usages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Static usages by key; partial usages by expression, or by key when there is none."""
    group_key = F.coalesce(F.nullif(F.col("full_expr"), F.lit("")), F.col("key"))
    static = usages.filter(~F.col("is_partial"))
    partial = usages.filter(F.col("is_partial")).withColumn("group_key", group_key)
    return static, partial


# ---------------------------------------------------------------- static keys


def key_profile(usages: DataFrame) -> DataFrame:
    """One row per statically used key: all usages, and those outside ignored paths."""
    static, _ = split_static_partial(usages)
    outside = F.count_if(~F.col("in_ignored_path"))
    return static.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_usages"), outside.alias("n_outside"))


def missing_candidates(profile: DataFrame, env: DataFrame) -> DataFrame:
    """Used keys that neither a file nor the exported environment defines."""
    return profile.join(env.select(*KEY), KEY, "left_anti")


def mark_ignored_folders(candidates: DataFrame) -> DataFrame:
    """Keys used in ignored paths only."""
    return candidates.withColumn("in_ignored_folders", F.col("n_outside") == 0)


def ignored_keys(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("kind") == "missing").select("repo_id", F.col("pattern").alias("key")).distinct()


def mark_ignored_keys(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys a rule lists, by exact match."""
    listed = ignored_keys(rules).withColumn("ignored_key", F.lit(True))
    marked = candidates.join(listed, KEY, "left")
    return marked.withColumn("ignored_key", F.coalesce("ignored_key", F.lit(False)))


def count_ignored_in_list(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """How many entries of a key list are ignored, per repository; repeated entries count."""
    counted = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    kept = counted.join(ignored_keys(rules), KEY, "left_semi")
    return kept.groupBy("repo_id").agg(F.sum("n").alias("n_ignored"))


def key_ledger(profile: DataFrame, env: DataFrame, rules: DataFrame) -> DataFrame:
    """Every key, used or defined, with one verdict.

    Used only in ignored paths is tested before the key rules, so such a key
    counts for the folders only. All inputs are unique on the key and arrive
    partitioned by it.
    """
    used = mark_ignored_keys(profile, rules)
    both = used.join(env.withColumn("defined", F.lit(True)), KEY, "full")
    defined = F.coalesce("defined", F.lit(False))
    is_used = F.col("n_usages").isNotNull()
    verdict = (
        F.when(is_used & ~defined & (F.col("n_outside") == 0), F.lit(IGNORED_FOLDER))
        .when(is_used & ~defined & F.col("ignored_key"), F.lit(IGNORED_KEY))
        .when(is_used & ~defined, F.lit(MISSING))
        .when(~is_used & F.col("from_file"), F.lit(UNUSED))
        .otherwise(F.lit(FINE))
    )
    return both.select(*KEY, "n_usages", "n_outside", "redacted_value", "source_file", verdict.alias("verdict"))


def missing(usages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Usages outside ignored paths of the missing keys: one row per usage."""
    static, _ = split_static_partial(usages)
    outside = static.filter(~F.col("in_ignored_path")).select(*KEY, *PLACE)
    keys = ledger.filter(F.col("verdict") == MISSING)
    hot = hot_groups(keys, KEY, n="n_usages")
    return spread_join(outside, keys.select(*KEY), KEY, "left_semi", ["file", "line"], hot)


def unused(ledger: DataFrame) -> DataFrame:
    """Keys a file defines and no static usage reads, their values redacted."""
    return ledger.filter(F.col("verdict") == UNUSED).select(*KEY, "redacted_value", "source_file")


# ---------------------------------------------------------------- partial keys


def partial_groups(usages: DataFrame) -> DataFrame:
    """One row per dynamic expression or referenced variable."""
    _, partial = split_static_partial(usages)
    return partial.groupBy(*GROUP).agg(F.bool_or("is_var_ref").alias("is_var_ref"), F.count(F.lit(1)).alias("n_usages"))


def partial_var_refs(groups: DataFrame) -> DataFrame:
    """Groups with a variable reference: always reported."""
    return groups.filter("is_var_ref")


GRAM_SIZES = (1, 2, 4, 8, 16, 32, 64)
# Names that one part of a look-up holds.
PART_NAMES = 50_000
_SYMBOL = r"[^A-Za-z0-9_]"


def _grams(text: Column, start: str, sizes: Column | None = None) -> Column:
    """Grams of these sizes (else of all) at each position where ``start`` matches; none for an empty list of sizes."""
    sizes = F.array(*[F.lit(s) for s in GRAM_SIZES]) if sizes is None else sizes
    windows = F.regexp_extract_all(text, F.lit(rf"(?s)(?=({start}.{{0,{GRAM_SIZES[-1] - 1}}}))"), F.lit(1))
    fitting = lambda w: F.filter(sizes, lambda s: s <= F.length(w))
    found = F.flatten(F.transform(windows, lambda w: F.transform(fitting(w), lambda s: F.left(w, s))))
    return F.when(F.size(sizes) > 0, found).otherwise(F.array().cast("array<string>"))


def _probes(text: Column, start: str) -> Column:
    """Grams of the largest size that fits behind the first place where ``start`` matches, at every such place."""
    room = F.length(F.regexp_extract(text, rf"(?s){start}.*", 0))
    out = F
    for size in reversed(GRAM_SIZES):
        found = F.regexp_extract_all(text, F.lit(rf"(?s)(?=({start}.{{{size - 1}}}))"), F.lit(1))
        out = out.when(room >= size, F.array_distinct(found))
    return out


def _as_it_is(df: DataFrame, name: str) -> DataFrame:
    return df


def contained_groups(groups: DataFrame, env: DataFrame, stage: Stage = _as_it_is) -> DataFrame:
    """Groups whose key occurs inside some variable name of the same repository.

    Containment becomes an equi-join on grams: a name that contains the group key
    contains each of the key's grams (up to 64 characters). The names that hold
    each gram are counted, and a key is looked up by the one that the fewest
    names hold; a key with a gram that no name holds is done. Dynamic expressions
    hold an operator or a quote, so their grams are those that start with a
    symbol, and a name made of word characters only yields no gram at all. Keys
    made of word characters only are matched at every position. A repository's
    names are cut into grams of the sizes that its keys are looked up by, at the
    positions that these may start at, and into no others.

    Each table that several steps read is one table for all keys, and ``stage``
    writes it: else its steps are planned and run once for each reader.
    """
    key = F.col("group_key")
    of_gram = ["repo_id", "gram"]
    symbol = key.rlike(_SYMBOL)
    probed = F.when(symbol, _probes(key, _SYMBOL)).when(key != "", _probes(key, "."))
    keys = groups.select(*GROUP, symbol.alias("symbol"), F.explode(probed).alias("gram"))
    probes = stage(keys, "probes")

    size = F.length("gram")
    needed = probes.groupBy("repo_id").agg(
        F.collect_set(F.when(F.col("symbol"), size)).alias("at_symbols"), F.collect_set(F.when(~F.col("symbol"), size)).alias("anywhere")
    )
    name = F.col("name")
    found = F.concat(_grams(name, _SYMBOL, F.col("at_symbols")), _grams(name, ".", F.col("anywhere")))
    names = env.select("repo_id", F.col("key").alias("name")).join(needed, "repo_id")
    grams = stage(names.select("repo_id", "name", F.explode(F.array_distinct(found)).alias("gram")), "grams")

    counts = grams.groupBy(*of_gram).agg(F.count(F.lit(1)).alias("n"))
    fewest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))
    chosen = probes.join(counts, of_gram, "left").groupBy(*GROUP).agg(fewest.alias("r"))
    rarest = stage(chosen.filter("r.n > 0").select(*GROUP, "r.gram", "r.n"), "rarest")
    # a gram that is common in its repository has its names spread over parts
    parts = F.ceil(F.col("n") / PART_NAMES).cast("int").alias("parts")
    looked_up = rarest.groupBy(*of_gram).agg(F.max("n").alias("n"))
    hot = hot_groups(looked_up, of_gram)
    held = spread_join(grams, looked_up.select(*of_gram, parts), of_gram, "inner", ["name"], hot)
    held = held.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    copies = rarest.select(*GROUP, "gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    hits = copies.join(held.drop("parts"), [*of_gram, "part"]).filter(name.contains(key))
    return hits.select(*GROUP).distinct()


def partial_contains(groups: DataFrame, env: DataFrame, stage: Stage = _as_it_is) -> DataFrame:
    """Groups without a variable reference whose key no variable name contains."""
    open_groups = groups.filter(~F.col("is_var_ref"))
    return open_groups.join(contained_groups(open_groups, env, stage), GROUP, "left_anti")


def reported_groups(groups: DataFrame, env: DataFrame, stage: Stage = _as_it_is) -> DataFrame:
    """Variable references, and expressions that no variable name contains."""
    contained = contained_groups(groups.filter(~F.col("is_var_ref")), env, stage)
    return groups.join(contained, GROUP, "left_anti")


def partial_matches(usages: DataFrame, reported: DataFrame) -> DataFrame:
    """Usages of the reported groups: one row per usage."""
    _, partial = split_static_partial(usages)
    rows = partial.select(*GROUP, *PLACE)
    hot = hot_groups(reported, GROUP, n="n_usages")
    joined = spread_join(rows, reported.select(*GROUP, "is_var_ref"), GROUP, "inner", ["file", "line"], hot)
    return joined.withColumnRenamed("group_key", "key")


# ---------------------------------------------------------------- summary


def summarize(
    repos: DataFrame, ledger: DataFrame, reported: DataFrame, skip_unused: bool = False, no_dynamic: bool = False
) -> DataFrame:
    """Counts and the pass/fail gate, one row per repository, clean ones included.

    One aggregation over already reduced rows; flags empty what they hide but
    leave the ignore counters alone.
    """
    events = (
        ledger.select("repo_id", F.col("verdict").alias("event"))
        .filter(F.col("event") != FINE)
        .unionByName(reported.select("repo_id", F.lit("partial").alias("event")))
        .unionByName(repos.select("repo_id", F.lit("repo").alias("event")))
    )
    n = lambda event: F.count_if(F.col("event") == event)
    zero = F.lit(0).cast("bigint")
    counts = events.groupBy("repo_id").agg(
        n(MISSING).alias("missing"),
        (zero if no_dynamic else n("partial")).alias("partial"),
        (zero if skip_unused else n(UNUSED)).alias("unused"),
        n(IGNORED_KEY).alias("ignored_missing"),
        n(IGNORED_FOLDER).alias("ignored_from_folders"),
    )
    return counts.withColumn("has_issues", F.col("missing") + F.col("partial") + F.col("unused") > 0)
