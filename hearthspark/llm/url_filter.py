"""URL filters: host and path rules, and a template tree that judges the urls no rule reaches.

Paths become templates: digits, hexadecimal strings and long segments are typed, and all urls are summed up by host and
typed path with the counts of rule labels, so everything after works on templates. Level by level, a segment that holds
too small a share of a node with too many branches becomes a wildcard. Sibling branches are merged if the templates
below them are distributed alike and their labels agree; a branch without labels agrees with any, and goes to one that
has labels if it can. So a template's labelled urls speak for its unlabelled ones too. A template's share of blocked labels is smoothed towards its
branch's share, and that towards the share of all labels; a template is rejected if the smoothed share is high.

Only DataFrame expressions run on the executors. Hot hosts are summed in each partition before any shuffle; urls meet
rejected templates alone, in a join on host and typed path whose large partitions Spark splits.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; a branch without labels, merged ones included, rejects nothing; repeated rows each count; empty tables give no rows; other columns
are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and what paths begin with."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules (fixed values).
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = (F.when if out is None else out.when)(fits, F.lit(getattr(r, what)))
    return out if out is not None else F.lit(None).cast("string")


def typed_path(path: Column) -> Column:
    """A path whose variable parts are typed: <hex>, <n> and <long>."""
    segments = F.split(F.lower(path), "/", -1)

    def one(s: Column) -> Column:
        numbers = F.regexp_replace(s, "[0-9]+", "<n>")
        return F.when(s.rlike("^(?=.*[0-9])[0-9a-f]{8,}$") & ~s.rlike("^[0-9]+$"), F.lit("<hex>")).when(F.length(s) > 40, F.lit("<long>")).otherwise(numbers)

    return F.array_join(F.transform(segments, one), "/")


def templates(labelled: DataFrame, *, depth: int = 4, max_branches: int = 30, min_share: float = 0.01, overlap: float = 0.8, max_gap: float = 0.2) -> DataFrame:
    """host, typed, template, branch and the counts n, labels, blocked of each typed path of a host.

    ``labelled``: host, typed, label (allow, block or null). Segments below ``depth`` stay typed but aren't wildcarded.
    """
    sums = labelled.groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("label").alias("labels"), F.count_if(F.col("label") == "block").alias("blocked"))
    tree = stage(sums.withColumn("parts", F.split("typed", "/", -1)), "templates").withColumn("prefix", F.lit(""))
    for level in range(1, depth + 1):
        tree = tree.withColumn("segment", F.get("parts", F.lit(level)))
        nodes = tree.filter(F.col("segment").isNotNull()).groupBy("host", "prefix", "segment").agg(F.sum("n").alias("m"))
        wide = nodes.groupBy("host", "prefix").agg(F.count("*").alias("branches"), F.sum("m").alias("all")).filter(F.col("branches") > max_branches)
        rare = nodes.join(wide, ["host", "prefix"]).filter(F.col("m") < min_share * F.col("all")).select("host", "prefix", "segment", F.lit(True).alias("rare"))
        tree = tree.join(rare, ["host", "prefix", "segment"], "left")
        token = F.when(F.col("rare"), F.lit("*")).otherwise(F.col("segment"))
        tree = tree.withColumn("prefix", F.when(F.col("segment").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), token))).drop("segment", "rare")
        tree = stage(tree, "level")  # each level reads the one before twice, so an unstaged plan would grow as a power of the depth
    rest = F.array_join(F.slice("parts", F.lit(depth + 2), F.greatest(F.size("parts"), F.lit(1))), "/")
    tree = tree.withColumn("template", F.when(F.size("parts") > depth + 1, F.concat("prefix", F.lit("/"), rest)).otherwise(F.col("prefix")))
    tree = tree.withColumn("branch", F.coalesce(F.get(F.split("template", "/", -1), F.lit(1)), F.lit("")))
    tree = stage(tree.withColumn("below", F.array_join(F.slice(F.split("template", "/", -1), F.lit(3), F.size(F.split("template", "/", -1))), "/")).select("host", "typed", "template", "branch", "below", "n", "labels", "blocked"), "templates")
    branches = tree.groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked"))
    shares = tree.groupBy("host", "branch", "below").agg(F.sum("n").alias("k")).join(branches, ["host", "branch"]).select("host", "branch", "below", (F.col("k") / F.col("n")).alias("share"))
    # branches of one host are few: at most max_branches and those of a large enough share, by the wildcards above
    pairs = shares.join(shares.select("host", "below", F.col("branch").alias("other"), F.col("share").alias("other_share")), ["host", "below"]).filter("branch <> other")
    alike = pairs.groupBy("host", "branch", "other").agg(F.sum(F.least("share", "other_share")).alias("common")).filter(F.col("common") >= overlap)
    rates = branches.select("host", "branch", F.when(F.col("labels") > 0, F.col("blocked") / F.col("labels")).alias("rate"))
    alike = alike.join(rates, ["host", "branch"]).join(rates.select("host", F.col("branch").alias("other"), F.col("rate").alias("other_rate")), ["host", "other"])
    agree = F.when(F.col("rate").isNull(), F.col("other_rate").isNotNull() | (F.col("other") < F.col("branch"))).otherwise((F.col("other") < F.col("branch")) & (F.abs(F.col("rate") - F.col("other_rate")) <= max_gap))
    into = F.coalesce(F.min(F.when(F.col("other_rate").isNotNull(), F.col("other"))), F.min("other"))
    merged = alike.filter(F.coalesce(agree, F.lit(False))).groupBy("host", "branch").agg(into.alias("into"))
    # labelled branches first, then by name, so that what a branch is merged into has its root before it
    each = F.array_sort(F.collect_list(F.struct(F.col("rate").isNull().alias("bare"), "branch", "into")))
    known = F.aggregate(each, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(m, F.create_map(x.getField("branch"), F.coalesce(F.try_element_at(m, x.getField("into")), x.getField("branch")))))
    roots = rates.join(merged, ["host", "branch"], "left").groupBy("host").agg(known.alias("known")).select("host", F.explode("known").alias("branch", "into")).filter("branch <> into")
    tree = tree.join(roots, ["host", "branch"], "left").withColumn("branch", F.coalesce("into", "branch"))
    template = F.when(F.col("into").isNull(), F.col("template")).otherwise(F.concat_ws("/", F.lit(""), "into", F.when(F.length("below") > 0, F.col("below"))))
    return tree.select("host", "typed", template.alias("template"), "branch", "n", "labels", "blocked")


def rejected_templates(tree: DataFrame, *, weight: float = 5.0, purity: float = 0.9) -> DataFrame:
    """host, typed, template and share of the typed paths whose template's smoothed share of blocked labels reaches ``purity``."""
    tree = stage(tree, "tree")
    total = tree.agg(F.coalesce(F.sum("labels"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    base = (total[1] + 0.5) / (total[0] + 1.0) if total[0] else 0.0
    branch = tree.groupBy("host", "branch").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b")).select("host", "branch", F.col("l").alias("n_labels"), ((F.col("b") + weight * base) / (F.col("l") + weight)).alias("branch_share"))
    leaf = tree.groupBy("host", "branch", "template").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b"))
    # a branch without any label says nothing about its templates
    leaf = leaf.join(branch.filter("n_labels > 0"), ["host", "branch"]).withColumn("share", (F.col("b") + weight * F.col("branch_share")) / (F.col("l") + weight)).filter(F.col("share") >= purity)
    return tree.join(leaf.select("host", "branch", "template", "share"), ["host", "branch", "template"]).select("host", "typed", "template", "share")


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", purity: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict, template and share (of the template that rejects it, else null)."""
    own_host, own_path = host(F.col(url_col)), path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), own_host.alias("host"), own_path.alias("path"))
    urls = urls.withColumn("typed", typed_path(F.col("path"))).withColumn("rule", matched(F.col("host"), F.col("path"), rules, "name")).withColumn("label", matched(F.col("host"), F.col("path"), rules, "verdict"))
    bad = stage(rejected_templates(templates(urls.select("host", "typed", "label")), purity=purity).dropDuplicates(["host", "typed"]), "rejected")
    out = urls.join(bad, ["host", "typed"], "left")
    verdict = F.coalesce("label", F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "share")
