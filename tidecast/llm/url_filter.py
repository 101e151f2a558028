"""URL filters by mined association rules.

Every URL becomes a set of tokens (scheme, every host label, path segment and query parameter name with digits folded, file
ending, first digit, fragment).  Tokens without enough support are dropped and
tokens that stand in the same labelled URLs are one item, named by the smallest
of them.  FP-growth over labelled URLs, each with its label
as one more item, finds the frequent combinations; those whose consequent is a
label, with enough support and confidence and no simpler rule that is as good,
are the filter.  Matching goes through an inverted index: a rule is filed under
its rarest token, a URL looks up its own tokens and checks the rest of each
rule that it finds there.  Of the matching rules the most confident decides.

Fixed host and path rules come first; where one fits, it decides.  In the
registered query these rules' verdicts are also the labels that are mined (no
table labels URLs), so the mined rules carry what the fixed ones say about
paths and hosts over to the URLs that they leave open.

Defined results: null URLs and URLs without ``://`` have an empty host and
path, no rule and the default verdict; rows that repeat an id or a URL are each
judged; URLs that no mined rule matches get the default verdict, as do all if
there are no labelled URLs; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_table

# Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
MIN_SUPPORT = 0.004     # of the labelled URLs
MIN_CONFIDENCE = 0.7


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fixed rule that fits, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later and longer ones go on top
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The URL's distinct tokens: one for each host label, path segment and query parameter
    name (digits folded in the last two), wherever it stands, and one of each other kind."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)

    def token(kind: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(kind + ":"), value))

    def each(kind: str, values: Column) -> Column:
        return F.transform(values, lambda s: token(kind, s))

    def folded(values: Column) -> Column:
        return F.transform(values, lambda s: F.regexp_replace(s, "[0-9]+", "0"))

    digit = F.regexp_extract(path, r"\A[^0-9]*([0-9])", 1)
    names = F.transform(F.split(query, "&"), lambda s: F.substring_index(s, "=", 1))
    return F.array_compact(F.array_distinct(F.concat(
        F.array(token("scheme", ascii_lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1))),
                token("digit", digit),
                token("ending", ascii_lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})\z", 1))),
                token("fragment", F.when(F.contains(url, F.lit("#")), F.lit("yes")))),
        each("label", F.split(host, r"\.")), each("segment", folded(F.split(path, "/"))), each("name", folded(names)))))


def kinds_of(labelled: DataFrame, min_support: float) -> DataFrame:
    """token, kind: the tokens with enough support among the labelled rows (url), each under
    the smallest token of those that stand in the same URLs.  Such tokens are one item to
    mine: rules with one or the other have the same support and confidence, and all their
    combinations would be exponentially many."""
    least = F.lit(min_support * labelled.count())
    each = labelled.groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumn("token", F.explode(tokens(F.col("url"))))
    seen = each.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("url")).alias("one"),
                                     F.bit_xor(F.xxhash64(F.lit(1), "url")).alias("two"))
    often = shared_table(seen.where(F.col("n") >= F.ceil(least)), "url-tokens")
    alike = often.groupBy("n", "one", "two").agg(F.min("token").alias("kind"))
    return shared_table(often.join(alike, ["n", "one", "two"]).select("token", "kind"), "url-kinds")


def with_kinds(urls: DataFrame, kinds: DataFrame) -> DataFrame:
    """Distinct urls (url) -> url, tokens: the kinds of each URL's tokens, without infrequent ones."""
    each = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    return each.join(kinds, "token").groupBy("url").agg(F.sort_array(F.collect_set("kind")).alias("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(url, label) -> rule_id, antecedent, label, confidence, support, of rules that no
    simpler rule for the same label equals in confidence; and the ``kinds_of`` the tokens."""
    spark = labelled.sparkSession
    labelled = labelled.where("label is not null")
    kinds = kinds_of(labelled, min_support)
    known = with_kinds(labelled.select("url").distinct(), kinds).withColumnRenamed("url", "of")
    items = labelled.join(known, F.col("url") == F.col("of"), "left").select(F.array_append(
        F.coalesce("tokens", F.expr("cast(array() as array<string>)")), F.concat(F.lit("="), F.col("label"))).alias("items"))
    schema = "antecedent array<string>, label string, confidence double, support double"
    if items.isEmpty():
        return spark.createDataFrame([], "rule_id string, " + schema), kinds
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where("consequent[0] like '=%'").where(
        ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
    rules = shared_table(rules.select(
        F.array_join(F.array_sort("antecedent"), " ").alias("rule_id"), "antecedent",
        F.substring(F.col("consequent")[0], 2, 1 << 20).alias("label"), "confidence", "support"), "url-rules")
    simpler = index(rules).select("token", F.col("antecedent").alias("less"), F.col("label").alias("of"),
                                  F.col("confidence").alias("as_sure"))
    beaten = (rules.withColumn("token", F.explode("antecedent")).join(simpler, "token")
              .where("label = of and as_sure >= confidence and size(less) < size(antecedent)")
              .where(F.size(F.array_except("less", "antecedent")) == 0).select("rule_id", "label").distinct())
    return shared_table(rules.join(beaten, ["rule_id", "label"], "left_anti"), "url-rules"), kinds


def index(rules: DataFrame) -> DataFrame:
    """The rules with the token that they are filed under: the one that fewest rules hold."""
    each = rules.withColumn("token", F.explode("antecedent"))
    use = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).withColumnRenamed("token", "t")
    filed = each.join(use, F.col("token") == F.col("t")).groupBy("rule_id", "label").agg(
        F.min(F.struct("uses", "token")).alias("best"))
    return rules.join(filed, ["rule_id", "label"]).withColumn("token", F.col("best.token")).drop("best")


def match(urls: DataFrame, rules: DataFrame, kinds: DataFrame) -> DataFrame:
    """Distinct (url) -> url, label, confidence, rule_id of the most confident matching rule
    (then the one with more tokens, more support, the smaller text)."""
    found = (with_kinds(urls, kinds).withColumn("token", F.explode("tokens"))
             .join(index(rules), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0))
    best = F.max_by(F.struct("label", "confidence", "rule_id"),
                    F.struct("confidence", F.size("antecedent"), "support", F.hash("rule_id"), "rule_id", "label"))
    return found.groupBy("url").agg(best.alias("best")).select("url", "best.*")


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, and what decided where no fixed rule did:
    mined (the rule's tokens) and confidence."""
    url = F.col("url")
    rows = pages.select(F.col("page_id").alias("page_id"), "url").select(
        "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    labelled = rows.where("fixed is not null").select("url", F.col("fixed.verdict").alias("label"))
    mined, kinds = mine(labelled)
    best = match(rows.where("fixed is null and url is not null").select("url").distinct(), mined, kinds).select(
        F.col("url").alias("of"), F.col("label"), "confidence", F.col("rule_id").alias("mined"))
    # rows that a fixed rule decides, or without a url, go round the join: they would share one null key
    waiting = F.col("fixed").isNull() & F.col("url").isNotNull()
    nothing = [F.lit(None).cast(best.schema[c].dataType).alias(c) for c in best.columns]
    met = rows.where(waiting).join(best, F.col("url") == F.col("of"), "left").unionByName(
        rows.where(~waiting).select("*", *nothing))
    return met.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "label", F.lit(default)).alias("verdict"), "mined", "confidence")
