"""Operator 4: verdicts on page URLs from fixed rules and from mined associations.

Fixed rules (host, path) come first: a rule fits its host and all subdomains if the path
starts with the rule's path, and the longest rule wins. Other pages are judged by
association rules: URL tokens of labelled pages are the baskets of Spark's FP-growth, and
a rule `tokens -> blocked` is kept if its support and confidence reach the bounds, its
lift is above one and no part of its tokens is as sure. Rules are found through an
inverted index: each rule stands under its rarest tokens, and only pages with one of them
test the rest. A page is blocked if a rule fits, else allowed.

All of it runs as DataFrame operations. Tokens of a URL: its host, the host's labels, every
path part (digits masked), the file ending and the query's keys. Tokens that the same labelled
pages hold, such as the labels of one host, are mined as one: k of them would make 2**k
itemsets that say the same. In a rule they stand for each other: it asks for one of them.

Defined results: a null URL or one without `://` has an empty host and path, no rule and
the verdict allow; repeated rows give repeated results; without labels or pages no rule is
mined; a page is bad if any of its labels says toxic or low quality; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.llm.common import staged

# (verdict, host, path); these are fixed.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
SUPPORT = 0.005
CONFIDENCE = 0.6
BLOCKED = "label=blocked"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fixed_rule(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest fixed rule that fits `host` and `path`; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith(f".{rule_host}")) & F.col("path").startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of the URL, from the columns host and path."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    masked = F.transform(parts, lambda p: F.concat(F.lit("path="), F.regexp_replace(p, r"\d+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#?]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.concat(F.lit("key="), F.split(p, "=")[0]))
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    labels = F.transform(F.split("host", r"\."), lambda p: F.concat(F.lit("name="), p))
    every = F.concat(
        F.array(F.concat(F.lit("host="), F.col("host"))), labels, masked, keys, F.array(F.concat(F.lit("ending="), ending))
    )
    return F.array_distinct(F.filter(every, lambda t: ~t.endswith("=")))


def described(pages: DataFrame) -> DataFrame:
    """page_id, host, path and tokens."""
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "url"
    )
    return named.withColumn("tokens", tokens(F.col("url"))).drop("url")


def _merged(baskets: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """Baskets (row, bad, items) of token classes, and (head, members) of every class.

    Tokens are one class if their rows are the same, told by count and two xors of row hashes.
    Tokens of fewer than `least` rows are left out: no rule can hold them.
    """
    single = baskets.select("row", F.explode("tokens").alias("token"))
    xors = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    held = single.groupBy("token").agg(F.count("*").alias("n"), *xors).filter(F.col("n") >= least)
    classes = staged(
        held.groupBy("n", "x1", "x2").agg(F.min("token").alias("head"), F.array_sort(F.collect_list("token")).alias("members")),
        "token-classes",
    )
    heads = classes.select("head", F.explode("members").alias("token"))
    named = single.join(heads, "token").groupBy("row").agg(F.collect_set("head").alias("items"))
    blocked = F.when(F.col("bad"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))
    items = F.concat(F.coalesce("items", F.array().cast("array<string>")), blocked)
    return baskets.join(named, "row", "left").select(items.alias("items")), classes.select("head", "members")


def associations(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """classes, rarest, confidence and support of the rules for blocking.

    A rule fits a page that has a token of each class; `rarest` is the class of fewest pages.
    """
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad")
    )
    known = described(pages).join(bad, "page_id").filter(F.size("tokens") > 0)
    baskets = staged(known.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "baskets")
    items, classes = _merged(baskets, F.lit(support * baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(staged(items, "class-baskets"))
    found = (
        model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED) & (F.col("lift") > 1))
        .select(F.array_sort("antecedent").alias("heads"), "confidence", "support")
    )
    found = staged(found, "associations")
    # A rule goes if leaving out one of its classes leaves a rule that is as sure.
    parts = found.withColumn("left_out", F.explode("heads")).select(
        "heads", "confidence", F.array_sort(F.array_remove("heads", F.col("left_out"))).alias("part")
    )
    shorter = found.select(F.col("heads").alias("part"), F.col("confidence").alias("part_confidence"))
    covered = parts.join(shorter, "part").filter("part_confidence >= confidence").select("heads").distinct()
    rules = found.join(covered, "heads", "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("head"), "freq")
    full = rules.withColumn("head", F.explode("heads")).join(single, "head").join(classes, "head")
    gathered = full.groupBy("heads").agg(
        F.collect_list("members").alias("classes"), F.min(F.struct("freq", "head", "members")).alias("least")
    )
    return staged(
        rules.join(gathered, "heads").select("classes", F.col("least.members").alias("rarest"), "confidence", "support"), "url-rules"
    )


def mined(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens, confidence and support of the rules for blocking, one row for each choice of tokens."""
    none = F.array(F.array().cast("array<string>"))

    def longer(begun: Column, members: Column) -> Column:
        return F.flatten(F.transform(begun, lambda b: F.transform(members, lambda m: F.concat(b, F.array(m)))))

    choices = F.aggregate("classes", none, longer)
    return associations(pages, labels, support, confidence).select(
        F.explode(F.transform(choices, lambda c: F.array_sort(c))).alias("tokens"), "confidence", "support"
    )


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and the confidence of the mined rule, if one spoke."""
    found = associations(pages, labels, support, confidence)
    name, verdict = fixed_rule(rules)
    rows = described(pages).select("page_id", "host", "path", "tokens", name.alias("rule"), verdict.alias("fixed"))
    index = found.select(F.explode("rarest").alias("token"), F.col("classes").alias("wanted"), F.col("confidence").alias("sure"))
    keys = ["row", "page_id", "host", "path", "rule", "fixed"]
    asked = rows.withColumn("row", F.monotonically_increasing_id()).select(
        *keys, "tokens", F.explode_outer("tokens").alias("token")
    )
    hit = F.when(F.forall("wanted", lambda c: F.arrays_overlap(c, F.col("tokens"))), F.col("sure"))
    met = asked.join(index, "token", "left").groupBy(*keys).agg(F.max(hit).alias("confidence"))
    spoken = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return met.select(
        "page_id", "host", "path", "rule",
        F.coalesce("fixed", spoken).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"),
    )
