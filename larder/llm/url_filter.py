"""URL filters: rules first, then gradient-boosted trees on lexical features of the URL.

1. Host and path are cut from the URL; a rule fits its host and all subdomains if the path starts with the rule's path.
   The longest fitting rule decides (equal lengths: the longer host, then block). Rules are a parameter, held as one
   literal of the plan; the URL's own columns are compared with it, so no join and no shuffle is needed.
2. Labelled URLs train Spark's GBTClassifier. Features are lengths (of URL, host, path, longest host label), depth,
   host labels, shares of digits and of marks, entropy of the characters of the host, parameter counts, hyphens, and
   statistics of the host's suffixes (the last label and the last two): how many of all URLs end in it, and which share
   of the labelled ones is blocked, drawn towards the share of all labelled URLs by `prior` of them.
3. Every URL that no rule fits gets the trees' verdict.

The trees are fitted on a sample of about `sample` labelled URLs (all, if there are fewer), drawn by a hash of the URL;
suffix statistics cover all URLs. Suffixes are counted with map-side aggregates; their table is broadcast while it has
`hot_suffixes` rows at most, else it is a sort-merge join whose hot keys adaptive execution splits.

Null URLs or those without `://` have an empty host and path, fit no rule and are judged by the trees like others.
Without two kinds of labels the one kind there is decides, and without any the verdict is allow. Every row has its own
verdict, repeated ones too; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
# fixed values: words of host names that blocklists of adverts, gambling, adult pages, drugs and spam share
SEED_WORDS = ("ads", "adult", "bet", "bets", "casino", "escort", "loan", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "xxx")
FEATURES = (
    "length", "host_length", "path_length", "longest_label", "labels", "depth", "digits", "marks", "host_digits", "hyphens", "entropy", "parameters", "query_length",
    "suffix1_count", "suffix1_blocked", "suffix2_count", "suffix2_blocked",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ?, # or the end, in lower case (A-Z); then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The struct (size, host_size, verdict, rule) of the longest rule that fits, or null."""
    known = []
    for verdict, rule in rules:
        own, slash, rest = rule.partition("/")
        if verdict not in (BLOCK, ALLOW) or not own:
            raise ValueError(f"not a rule: {verdict} {rule}")
        fields = {"size": len(rule), "host_size": len(own), "verdict": verdict, "rule": rule, "host": own.translate(str.maketrans(UPPER, LOWER)), "path": slash + rest}
        known.append(F.struct(*(F.lit(v).alias(k) for k, v in fields.items())))
    if not known:
        return F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>")
    fits = F.filter(F.array(*known), lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))


def judged_by_rules(pages: DataFrame, rules: Iterable[tuple[str, str]], *also: str) -> DataFrame:
    """pages -> the columns of `also`, url, host, path, rule, ruled (its verdict); the last two are null where no rule fits."""
    url = F.col("url").cast("string")
    host, path = host_and_path(F.coalesce(url, F.lit("")))
    out = pages.select(*also, url.alias("url"), host.alias("host"), path.alias("path"))
    out = out.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return out.select(*also, "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path, ..) with the features of the URL alone and its suffixes suffix1 and suffix2."""
    text, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    letters = F.filter(F.split(host, ""), lambda x: x != "")
    share = lambda pattern, s: F.coalesce(F.regexp_count(s, F.lit(pattern)) / F.nullif(F.length(s), F.lit(0)), F.lit(0.0))
    uses = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    found = {
        "length": F.length(text), "host_length": F.length(host), "path_length": F.length(path),
        "longest_label": F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), F.lit(0)), "labels": F.size(labels),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "digits": share("[0-9]", text), "marks": share("[^0-9A-Za-z]", text), "host_digits": share("[0-9]", host),
        "hyphens": F.regexp_count(host, F.lit("-")), "entropy": F.aggregate(uses, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "query_length": F.length(query),
    }
    suffixes = {f"suffix{k}": F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".") for k in (1, 2)}
    return df.withColumns({k: v.cast("double") for k, v in found.items()} | suffixes)


def with_suffix_statistics(df: DataFrame, all_urls: DataFrame, labelled: DataFrame, prior: float, hot_suffixes: int) -> DataFrame:
    """df (suffix1, suffix2) with counts of all URLs and shares of blocked labelled ones for both suffixes."""
    share = labelled.agg(F.avg("label")).first()[0] or 0.0
    for k in ("suffix1", "suffix2"):
        counts = all_urls.select(k).groupBy(k).agg(F.count("*").alias("n"))
        blocked = labelled.select(k, "label").groupBy(k).agg(F.sum("label").alias("blocked"), F.count("*").alias("of"))
        of = F.coalesce("of", F.lit(0))
        table = counts.join(blocked, k, "left").select(k, F.log1p("n").alias(f"{k}_count"), ((F.coalesce("blocked", F.lit(0.0)) + prior * share) / (of + prior)).alias(f"{k}_blocked"))
        table = cut(table)
        df = df.join(F.broadcast(table) if table.count() <= hot_suffixes else table, k, "left")
    return df.fillna({f"{k}_count": 0.0 for k in ("suffix1", "suffix2")} | {f"{k}_blocked": share for k in ("suffix1", "suffix2")})


def seed_labels(pages: DataFrame, words: Iterable[str] = SEED_WORDS) -> DataFrame:
    """pages (url) -> url, label: 1 where a part of the host name (between dots and hyphens) is one of the words, else 0;
    only URLs that have a host."""
    host, _ = host_and_path(F.coalesce(F.col("url").cast("string"), F.lit("")))
    hit = F.arrays_overlap(F.split(host, "[.-]"), F.array(*(F.lit(w) for w in words)))
    return pages.where(host != "").select(F.col("url").cast("string").alias("url"), hit.cast("double").alias("label"))


def filter_urls(pages: DataFrame, labelled: DataFrame, *, rules: Iterable[tuple[str, str]] = RULES, sample: int = 20_000, prior: float = 20.0, trees: int = 20, depth: int = 4, threshold: float = 0.5, hot_suffixes: int = 100_000) -> DataFrame:
    """pages (page_id, url), labelled (url, label 0 or 1) -> page_id, host, path, rule, verdict, score (the trees'
    probability of block; null where a rule decides or the labels are of one kind)."""
    judged = judged_by_rules(pages, rules, F.col("page_id").cast("long").alias("page_id"))
    all_urls = lexical(judged)
    known = lexical(judged_by_rules(labelled.where("label is not null"), (), F.col("label").cast("double").alias("label")))
    n, kinds = known.agg(F.count("*"), F.collect_set("label")).first()
    if len(kinds) < 2:
        verdict = F.coalesce("ruled", F.lit(BLOCK if kinds == [1.0] else ALLOW))
        return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # blocked URLs may be few, so each kind of label is drawn at a rate of its own and weighs what it stands for
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = {k: min(1.0, sample / 2 / v) for k, v in sizes.items()}
    drawn = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1_000_003)) < F.when(F.col("label") == 1, rate[1.0]).otherwise(rate[0.0]) * 1_000_003
    weight = F.when(F.col("label") == 1, n / 2 / sizes[1.0] / rate[1.0]).otherwise(n / 2 / sizes[0.0] / rate[0.0])
    chosen = cut(known.where(drawn).withColumn("weight", weight).drop("rule", "ruled"))
    chosen = cut(assemble.transform(with_suffix_statistics(chosen, all_urls, known, prior, hot_suffixes)).select("features", "label", "weight").coalesce(4))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, weightCol="weight").fit(chosen)
    scored = model.transform(assemble.transform(with_suffix_statistics(all_urls, all_urls, known, prior, hot_suffixes)))
    score = F.when(F.col("ruled").isNull(), vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule", "ruled", score.alias("score")).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
