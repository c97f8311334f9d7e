"""URL filters: given host and path rules, and association rules mined from the labels that these give.

Everything is DataFrame operations; the mining is Spark's FP-growth.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_IDS

#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.02, 10, 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def first_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null, if none fits)."""
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def tokens(host: Column, path: Column) -> Column:
    """The distinct labels of the host and segments of the path (each run of digits as one #), sorted."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_sort(F.array_distinct(F.concat(labels, parts)))


def association_rules(labelled: DataFrame, total: int, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled(tokens, blocked), `total` rows -> (antecedent, key, n, confidence): token sets that imply a block.

    n of the labelled rows have the set and are blocked: min_support of all
    rows and MIN_ROWS or more, and min_confidence of the rows with the set or more. A set of
    which a smaller one already is a rule is pruned; that changes no decision.
    key is the set's rarest token, under which the index has it.
    """
    items = labelled.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(_BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    least = max(math.ceil(min_support * total), MIN_ROWS)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total), minConfidence=min_confidence).fit(items).freqItemsets
    sets = found.select(F.array_sort(F.array_except("items", F.array(F.lit(_BLOCK)))).alias("antecedent"), F.array_contains("items", _BLOCK).alias("blocked"), "freq")
    sets = sets.where(F.col("freq") >= least)
    both = sets.where(F.size("antecedent") > 0).groupBy("antecedent").agg(F.max(F.when(F.col("blocked"), F.col("freq"))).alias("n"), F.max(F.when(~F.col("blocked"), F.col("freq"))).alias("every"))
    good = both.where(f"n >= {min_confidence!r} * every").select("antecedent", "n", (F.col("n") / F.col("every")).alias("confidence"))
    single = sets.where((F.size("antecedent") == 1) & ~F.col("blocked")).select(F.col("antecedent")[0].alias("token"), F.col("freq").alias("f"))
    spread = good.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    keyed = spread.groupBy("antecedent", "n", "confidence").agg(F.min(F.struct("f", "token")).alias("m")).select("antecedent", F.col("m.token").alias("key"), "n", "confidence")
    smaller = keyed.select(F.col("antecedent").alias("part"), F.col("key").alias("token"))
    wide = keyed.select("antecedent", F.explode("antecedent").alias("token"))
    covered = wide.join(smaller, "token").where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)).select("antecedent").distinct()
    return keyed.join(covered, "antecedent", "left_anti")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pages(page_id, url) -> (page_id, host, path, rule, verdict), a row per row.

    The longest fitting rule decides. Its verdicts are the labels from which
    association rules are mined; a url without a rule is blocked if all tokens
    of some mined rule are among its own, else allowed. Token sets are judged
    once each: every token looks up the rules indexed under it. A null url, or
    one without ://, has an empty host and path, no rule and is allowed. An
    empty table gives no rows. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    seen = base.select("*", rule.alias("rule"), verdict.alias("given"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    labelled = seen.where("given is not null").select("tokens", (F.col("given") == "block").alias("blocked"))
    out = seen.withColumn("set", F.concat_ws("\u0001", "tokens"))
    if total := labelled.count():
        mined = association_rules(labelled, total, min_support, min_confidence).select("antecedent", F.col("key").alias("token"))
        # at most 1 / min_support tokens are frequent, whatever the table; still checked
        small = mined.limit(BROADCAST_IDS // 20 + 1).count() <= BROADCAST_IDS // 20
        sets = out.where("given is null").select("set", "tokens").distinct()
        met = sets.select("set", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(mined) if small else mined, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).select("set").distinct()
        met = met.withColumn("mined", F.lit("block"))
        few = met.limit(BROADCAST_IDS // 20 + 1).count() <= BROADCAST_IDS // 20
        out = out.join(F.broadcast(met) if few else met, "set", "left")
    else:
        out = out.withColumn("mined", F.lit(None).cast("string"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"))
