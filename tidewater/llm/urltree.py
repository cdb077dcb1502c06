"""URL filters by a tree of path templates per host.

Segments that vary become wildcards, level by level from the root; branches whose
labels do not tell them apart are merged from the leaves up; a template is judged by
the share of bad labels on it, smoothed towards its host and all hosts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: shapes of segments that identify one page, and their wildcards
SHAPES = (
    (r"^[0-9]+$", "<num>"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "<date>"),
    (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "<uuid>"),
    (r"^(?=[^0-9]*[0-9])[0-9a-fA-F]{12,}$", "<hex>"),
)
ANY, MERGED, REST = "*", "~", "**"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    """Limits of the tree.

    Levels below ``depth`` are one segment. Of more than ``fanout`` children of a branch,
    those with fewer than ``support`` urls and fewer than ``min_labels`` labels are one
    wildcard, whatever their share of the branch; the others are left to the merge. Branches merge while their bad rates differ by less than ``z`` standard
    errors. Rates are smoothed by ``prior`` labels of the level above; from ``max_bad`` on,
    and with ``min_labels`` labels at least, a template is blocked.
    """

    depth: int = 6
    fanout: int = 20
    support: int = 20
    z: float = 1.96
    prior: float = 10.0
    max_bad: float = 0.3
    min_labels: int = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule (``text``, ``verdict``), null if none; equal length: block first."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<text:string,verdict:string>") if out is None else out


def _shaped(segment: Column) -> Column:
    stem, tail = F.regexp_extract(segment, r"^(.*?)((?:\.[A-Za-z][A-Za-z0-9]{0,5})?)$", 1), F.regexp_extract(
        segment, r"^(.*?)((?:\.[A-Za-z][A-Za-z0-9]{0,5})?)$", 2
    )
    out = None
    for pattern, mark in SHAPES:
        fits, value = stem.rlike(pattern), F.concat(F.lit(mark), tail)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(segment)


def shaped_path(path: Column, depth: int) -> Column:
    """The segments of a path, those of a known shape as wildcards, from ``depth`` on as one."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(parts)
    cut = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit(REST)))).otherwise(parts)
    return F.transform(cut, _shaped)


def _generalised(paths: DataFrame, rule: Tree) -> DataFrame:
    """``paths`` (``host``, ``shaped``, ``n``, ``labels``, ``bad``) with ``template``, level by level."""
    rows = paths.withColumn("template", F.array().cast("array<string>"))
    for level in range(1, rule.depth + 1):
        rows = rows.withColumn("child", F.try_element_at("shaped", F.lit(level)))
        kids = rows.where("child IS NOT NULL").groupBy("host", "template", "child").agg(
            F.sum("n").alias("rows"), F.sum("labels").alias("known")
        )
        parents = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"))
        kept = (
            kids.join(parents, ["host", "template"])
            .where(
                (F.col("children") <= rule.fanout)
                | (F.col("rows") >= rule.support)
                | (F.col("known") >= rule.min_labels)
                | F.col("child").startswith("<")
                | (F.col("child") == REST)
            )
            .select("host", "template", "child", F.lit(True).alias("literal"))
        )
        rows = rows.join(kept, ["host", "template", "child"], "left").withColumn(
            "template",
            F.when(F.col("child").isNull(), F.col("template")).otherwise(
                F.concat("template", F.array(F.when(F.col("literal"), F.col("child")).otherwise(F.lit(ANY))))
            ),
        )
        rows = rows.drop("child", "literal")
        if level % 2 == 0:
            rows = stored(rows, "url-levels")
    return rows.withColumn(
        "template", F.when(F.size("shaped") > rule.depth, F.concat("template", F.array(F.lit(REST)))).otherwise(F.col("template"))
    )


def _merged(templates: DataFrame, rule: Tree) -> DataFrame:
    """``templates`` (``host``, ``template``, ``labels``, ``bad``) with ``merged``, leaves first.

    At each position, a branch joins its siblings (equal elsewhere) if its bad rate does not
    differ from that of all siblings together.
    """
    rows = templates.withColumn("merged", F.col("template"))
    for at in range(rule.depth, 0, -1):
        masked = F.when(
            F.size("merged") >= at,
            F.concat(F.slice("merged", 1, at - 1), F.array(F.lit(MERGED)), F.slice("merged", at + 1, rule.depth + 1)),
        )
        rows = rows.withColumn("masked", masked)
        branches = rows.where("masked IS NOT NULL").groupBy("host", "masked", "merged").agg(
            F.sum("labels").alias("l"), F.sum("bad").alias("b")
        )
        pools = branches.groupBy("host", "masked").agg(
            F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count(F.lit(1)).alias("branches")
        )
        rate, pooled = F.try_divide("b", "l"), F.try_divide("pb", "pl")
        gap = F.pow(rate - pooled, 2) - rule.z**2 * pooled * (1 - pooled) / F.col("l")
        alike = (F.col("branches") > 1) & F.coalesce(gap <= 0, F.lit(True))
        joined = (
            branches.join(pools, ["host", "masked"])
            .where(alike)
            .select("host", "merged", F.col("masked").alias("into"))
        )
        rows = rows.join(joined, ["host", "merged"], "left").withColumn("merged", F.coalesce("into", "merged"))
        rows = rows.drop("masked", "into")
        if at % 2 == 1:
            rows = stored(rows, "url-branches")
    return rows


def judged_urls(urls: DataFrame, rules: Sequence[Rule] = (), tree: Tree = Tree()) -> DataFrame:
    """``urls`` (``id``, ``url``, ``bad`` 0, 1 or null) with host, path, rule, verdict and template.

    Adds ``host``, ``path``, ``rule``, ``verdict`` (``allow`` or ``block``), ``template``,
    ``n_labels`` and ``bad_rate`` (smoothed) of the merged template. Templates are formed
    from different shaped paths, so a host with most rows is small there. A null url has
    an empty host and path, its own template. Without any label nothing is blocked.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = urls.select("id", host.alias("host"), path.alias("path"), F.col("bad").cast("long").alias("bad"))
    rows = rows.withColumn("shaped", shaped_path(F.col("path"), tree.depth))
    paths = rows.groupBy("host", "shaped").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    formed = stored(_generalised(stored(paths, "url-paths"), tree), "url-templates")
    unmerged = formed.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    merged = stored(_merged(unmerged, tree), "url-merged")
    all_ = merged.agg(F.sum("labels"), F.sum("bad")).first()
    base = (all_[1] or 0) / all_[0] if all_[0] else 0.0
    hosts = merged.groupBy("host").agg(
        ((F.sum("bad") + tree.prior * base) / (F.sum("labels") + tree.prior)).alias("host_rate")
    )
    purity = (
        merged.groupBy("host", "merged")
        .agg(F.sum("labels").alias("n_labels"), F.sum("bad").alias("n_bad"))
        .join(hosts, "host")
        .withColumn("bad_rate", (F.col("n_bad") + tree.prior * F.col("host_rate")) / (F.col("n_labels") + tree.prior))
    )
    verdicts = stored(
        formed.select("host", "shaped", "template")
        .join(merged.select("host", "template", "merged"), ["host", "template"])
        .join(purity, ["host", "merged"])
        .select("host", "shaped", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "n_labels", "bad_rate"),
        "url-verdicts",
    )
    blocked = (F.col("bad_rate") >= tree.max_bad) & (F.col("n_labels") >= tree.min_labels)
    found = matched_rule(F.col("host"), F.col("path"), rules)
    return (
        rows.join(verdicts, ["host", "shaped"])
        .withColumn("_rule", found)
        .select(
            "id",
            "host",
            "path",
            F.col("_rule.text").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "template",
            "n_labels",
            F.round("bad_rate", 9).alias("bad_rate"),
        )
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``id``, ``url``, ``bad`` of pages: 1 if the document a page shows is labelled bad or toxic.

    The number that ends a page's path is the id of its document. Several labels of one
    document count as bad if one of them does.
    """
    _, path = host_and_path(F.col("url").cast("string"))
    number = F.regexp_extract(path, r"([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    bad = F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    known = labels.groupBy(F.col("doc_id").alias("_doc")).agg(bad.alias("bad"))
    numbered = pages.select(F.col("page_id").alias("id"), "url", number.alias("_x"))
    numbered = numbered.withColumn("_n", F.expr("try_cast(_x AS BIGINT)"))
    return numbered.join(known, F.col("_n") == F.col("_doc"), "left").select("id", "url", "bad")
