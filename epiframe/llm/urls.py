"""URL filtering by rules of hosts and paths, and by association rules mined from labels (operator 4).

Fixed rules come first: the longest rule whose host and path fit decides. Elsewhere association rules do: FP-growth
over the tokens of labelled URLs (host labels, path parts, query keys) finds token combinations that imply a bad
label with enough confidence, support and lift. An inverted index from each rule's rarest tokens to the rule gives a
URL's candidate rules; one whose tokens the URL all has blocks it.

Rules of any length are fitted on about ``LABELLED_ROWS`` labelled pages at most, chosen by a
hash of their id. All that pass are kept but those that hold another one's tokens; as each needs its share of the
labelled pages, their number doesn't grow with the tables. Tokens that are on the same labelled pages, as the parts of
one crawled URL are, are one item with alternatives, since FP-growth would find all their subsets. Where pages still
have more than ``LONGEST`` frequent items, all combinations of which FP-growth would find too, combinations are counted
level by level instead, leaving out those that are on the same pages as a part of them, or hold a rule; what is
found is the same. Everything runs as DataFrame functions.

A page's label is that of the document of its id. Where labels say nothing about URLs, as in the synthetic tables, no
combination passes and no rule is mined.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no fixed rule and is allowed; a URL
of any length is judged whole; an
empty table gives no rows; without labels no rule is mined; repeated rows are judged alike; extra columns stay, and columns
with the names of results are replaced.
"""

from __future__ import annotations

import itertools
import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_name

#: (verdict, host, path): fixed rules of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LABELLED_ROWS = 100_000
#: A rule needs this share of the labelled pages, and this many of them.
MIN_SUPPORT, MIN_PAGES = 0.002, 25
MIN_CONFIDENCE, MIN_LIFT = 0.8, 1.5
#: Frequent items of a page up to which FP-growth finds all combinations.
LONGEST = 12
BAD = "label:bad"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; digits are told apart only by being digits."""
    parts = lambda kind, array: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    plain = lambda c: F.regexp_replace(_lower(c), "[0-9]+", "0")
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1)
    return F.array_distinct(F.concat(parts("host:", F.split(host, r"\.")), parts("path:", F.split(plain(path), "/")), parts("query:", F.transform(query, plain))))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def minimal(rules: DataFrame) -> DataFrame:
    """Rules (sorted tokens) without those that hold another rule's tokens, which add nothing."""
    part = lambda m: F.filter("tokens", lambda x, k: F.floor(m / F.pow(F.lit(2), k)) % 2 == 1)
    longer = rules.where(F.size("tokens") > 1).withColumn("_all", F.pow(F.lit(2), F.size("tokens")).cast("int"))
    parts = longer.select("tokens", F.explode(F.transform(F.sequence(F.lit(1), F.col("_all") - 2), part)).alias("part"))
    more = parts.join(rules.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct()
    return rules.join(more, "tokens", "left_anti")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, bad, token): tokens of pages with a label, which is bad if toxic or of low quality; null for a page without tokens."""
    known = labels.select(F.col("doc_id").alias("_id"), F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).alias("bad"))
    share = min(1.0, LABELLED_ROWS / max(1, labels.count()))
    known = known.where(F.col("_id").isNotNull() & (F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url").join(known, F.col("page_id") == F.col("_id")).select("bad", tokens_of(F.col("url"), host, path).alias("tokens"))
    rows = materialize(rows.where(F.col("bad") | (F.size("tokens") > 0)), "url-tokens").withColumn("row", F.monotonically_increasing_id())
    return materialize(rows.select("row", "bad", F.explode_outer("tokens").alias("token")), "url-items")


def alike(items: DataFrame, least: float) -> DataFrame:
    """(token, item, n): frequent tokens of bad pages; those on the same pages have the first of them as their item."""
    by = items.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    found = by.where(F.col("n_bad") >= least)
    return found.join(found.groupBy("n", "x", "y").agg(F.min("token").alias("item")), ["n", "x", "y"]).select("token", "item", "n")


def grown(rows: DataFrame, n: int, bad: int, least: float) -> list[list[str]]:
    """Minimal rules by FP-growth; rows(bad, items)."""
    marked = rows.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=MIN_CONFIDENCE).fit(marked.where(F.size("items") > 0))
    # the model's own lift and support are of the rows it saw
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("confidence") * n >= F.lit(MIN_LIFT) * bad))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens")), "url-rules")
    return [list(r[0]) for r in minimal(rules).collect()]


def levelled(rows: DataFrame, n: int, bad: int, least: float) -> list[list[str]]:
    """Minimal rules level by level; rows(row, bad, items). A combination goes on if it is frequent, no rule, and on fewer
    pages than each part of it; else what holds it is neither a minimal rule nor rare enough to become one."""
    found, size, before = [], 1, None
    on = rows.select("row", "bad", F.explode("items").alias("_item")).select("row", "bad", F.array("_item").alias("items"))
    while True:
        counts = on.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).where(F.col("n_bad") >= least)
        if before is None:
            counts = counts.where(F.col("n") < n)
        else:
            parts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("items", lambda _, j: j != k))
            parts = counts.select("items", "n", "n_bad", F.explode(parts).alias("part")).join(before.select(F.col("items").alias("part"), F.col("n").alias("_n")), "part")
            counts = parts.groupBy("items", "n", "n_bad").agg(F.count("*").alias("_parts"), F.min("_n").alias("_least")).where((F.col("_parts") == size) & (F.col("n") < F.col("_least")))
        passes = (F.col("n_bad") >= F.lit(MIN_CONFIDENCE) * F.col("n")) & (F.col("n_bad") * F.lit(float(n)) >= F.lit(MIN_LIFT) * bad * F.col("n"))
        counts = materialize(counts.select("items", "n", passes.alias("passes")), "url-level")
        found += [list(r[0]) for r in counts.where("passes").select("items").collect()]
        before = counts.where("NOT passes")
        if before.isEmpty():
            return found
        on = materialize(on.join(before.select("items"), "items", "left_semi"), "url-on")
        prefix, last = F.slice("items", 1, size - 1), F.element_at("items", -1)
        a, b = on.select("row", "bad", "items", prefix.alias("prefix"), last.alias("a")), on.select("row", prefix.alias("prefix"), last.alias("b"))
        on = a.join(b, ["row", "prefix"]).where("a < b").select("row", "bad", F.concat("items", F.array("b")).alias("items"))
        size += 1


#: A rule: for each of its items the tokens that may stand for it.
Rule = list[list[str]]


def mine(pages: DataFrame, labels: DataFrame) -> list[Rule]:
    """Token combinations that imply a bad page, the item on the fewest labelled pages first."""
    items = labelled(pages, labels)
    n, bad = items.select("row", "bad").distinct().agg(F.count("*"), F.count_if("bad")).first()
    least = max(MIN_SUPPORT * n, MIN_PAGES)
    if bad < least:
        return []
    classes = materialize(alike(items, least), "url-classes")
    rows = items.join(classes.select("token", "item"), "token", "left").groupBy("row", "bad").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = materialize(rows, "url-rows")
    longest = rows.agg(F.max(F.size("items"))).first()[0]
    found = (grown if longest <= LONGEST else levelled)(rows, n, bad, least)
    wanted = sorted({x for r in found for x in r})
    tokens: dict[str, list[str]] = {}
    freq: dict[str, int] = {}
    for token, item, count in classes.where(F.col("item").isin(wanted)).collect() if wanted else ():  # tokens of rules alone
        tokens.setdefault(item, []).append(token)
        freq[item] = count
    return [[sorted(tokens[x]) for x in sorted(r, key=lambda x: (freq[x], x))] for r in sorted(found)]


def mine_rules(pages: DataFrame, labels: DataFrame) -> list[list[str]]:
    """The same with each token instead of its alternatives: all minimal combinations."""
    return [list(x) for r in mine(pages, labels) for x in itertools.product(*r)]


def mined_match(tokens: Column, rules: list[Rule]) -> Column:
    """Whether the URL has a token of each item of some rule: the index lists rules by their rarest item's tokens."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[Rule]] = {}
    for r in rules:
        for token in r[0]:
            index.setdefault(token, []).append(r)
    lists = F.from_json(F.lit(json.dumps(index)), "map<string,array<array<array<string>>>>")
    candidates = F.flatten(F.transform(F.filter(tokens, lambda t: F.map_contains_key(lists, t)), lambda t: F.element_at(lists, t)))
    return F.exists(candidates, lambda r: F.forall(r, lambda x: F.arrays_overlap(tokens, x)))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule (null where no fixed rule fits) and verdict (allow or block)."""
    mined = mine(pages, labels)
    df = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    fixed = own_name(df.columns, "fixed")
    df = df.withColumn(fixed, fixed_rule(F.col("host"), F.col("path"), rules))
    blocked = mined_match(tokens_of(F.col("url"), F.col("host"), F.col("path")), mined)
    verdict = F.coalesce(F.col(fixed)["verdict"], F.when(blocked, "block").otherwise("allow"))
    return df.withColumns({"rule": F.col(fixed)["rule"], "verdict": verdict}).drop(fixed)
