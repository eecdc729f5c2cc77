"""URL filters: explicit rules, then a path-template tree of each host.

Paths become templates segment by segment, as deep as labels go: digits turn into
``#``, and a segment that few of its siblings' pages have becomes the wildcard ``*``,
unless it has labels enough to be tested. A branch with too few labels to split
is a leaf. Then, from the root down, branches of one parent merge (``~``) if their rates
of bad labels differ significantly from their siblings' at the same places below them, leaf
or deeper, and there in the same direction; who differs from those of its own direction
again stays apart. A template is rejected if its share of bad
labels, smoothed towards its host's and that towards the overall share, reaches a
threshold. Everything is grouped aggregation on (host, path); no host
is ever gathered in one task.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class TreeParams:
    #: A segment stays itself with so many pages and so many percent of its parent's,
    #: or, whatever its share, with so many labels (then they outweigh the prior's).
    #: A branch with fewer labels has no branches of its own.
    least_pages: int = 2
    least_percent: int = 5
    least_labels: int = 5
    #: Standard errors by which a branch must differ from its siblings, somewhere, to stay apart.
    apart: float = 1.96
    #: Labels that a prior counts for, and the share of bad labels that rejects.
    weight: float = 5.0
    reject: float = 0.5


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path columns; both empty for null or where ``://`` is missing."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits columns host and path (else null)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def path_shape() -> Column:
    """The segments, with digits as ``#``."""
    return F.filter(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), lambda s: s != "")


def grown(shapes: DataFrame, p: TreeParams) -> tuple[DataFrame, int]:
    """The template tree: (host, shape, labels, bad, leaf) from (host, shape, n, labels, bad), and its depth.

    Each round takes the open branches one segment deeper; there are as many as
    ``least_labels`` labels share segments, and what is closed takes no part in them.
    """
    done, depth = [], 0
    tree = cut(shapes.withColumn("leaf", F.array().cast("array<string>")), "level-0")
    while True:
        tree = tree.withColumn("segment", F.coalesce(F.get("shape", F.lit(depth)), F.lit("")))
        child = tree.groupBy("host", "leaf", "segment").agg(F.sum("n").alias("pages"), F.sum("labels").alias("marked"))
        parent = child.groupBy("host", "leaf").agg(F.sum("pages").alias("all"), F.sum("marked").alias("all_marked"))
        common = (100 * F.col("pages") >= p.least_percent * F.col("all")) | (F.col("marked") >= p.least_labels)
        closed = (F.col("segment") == "") | (F.col("all_marked") < p.least_labels)
        step = F.when(~closed, F.when((F.col("pages") >= p.least_pages) & common, F.col("segment")).otherwise("*"))
        steps = child.join(parent, ["host", "leaf"]).select("host", "leaf", "segment", step.alias("step"))
        moved = cut(tree.join(steps, ["host", "leaf", "segment"]).drop("segment"), f"level-{depth + 1}")
        done.append(moved.where("step is null").select("host", "shape", "labels", "bad", "leaf"))
        tree = moved.where("step is not null").withColumn("leaf", F.concat("leaf", F.array("step"))).drop("step")
        if not tree.limit(1).count():
            return functools.reduce(DataFrame.union, done), depth
        depth += 1


def _differs(p: TreeParams) -> Column:
    """1 or -1 if the rate of bad labels is significantly above or below that of all others, else 0."""
    some = lambda x: F.nullif(x.cast("double"), F.lit(0.0))  # noqa: E731  no labels, no rate
    n, b = some(F.col("labels")), F.col("bad").cast("double")
    m, c = some(F.col("all_labels") - F.col("labels")), (F.col("all_bad") - F.col("bad")).cast("double")
    share = (b + c) / (n + m)
    error = p.apart * p.apart * share * (1 - share) * (1 / n + 1 / m)
    far = (b / n - c / m) * (b / n - c / m) > error
    return F.when(far, F.when(b / n > c / m, 1).otherwise(-1)).otherwise(0)


def merged(leaves: DataFrame, depth: int, p: TreeParams) -> DataFrame:
    """``leaves`` (host, leaf, labels, bad) with ``template``: similar branches are ``~``, level by level from the root."""
    rows = leaves.withColumn("template", F.col("leaf"))
    for d in range(depth):
        part = {"above": F.slice("template", 1, F.lit(d)), "branch": F.get("template", F.lit(d)), "below": F.slice("template", d + 2, F.greatest(F.size("template") - d - 1, F.lit(0)))}
        rows = rows.withColumns(part)
        cells = rows.where("branch is not null").groupBy("host", "above", "branch", "below").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
        pooled = cells.groupBy("host", "above", "below").agg(F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad"))
        cells = cut(cells.join(pooled, ["host", "above", "below"]).withColumn("differs", _differs(p)).drop("all_labels", "all_bad"), f"cells-{d}")
        # a name of where and how a branch differs: 0 is nowhere
        kind = F.coalesce(F.bit_xor(F.when(F.col("differs") != 0, F.xxhash64("below", "differs"))), F.lit(0).cast("long"))
        kinds = cells.groupBy("host", "above", "branch").agg(kind.alias("kind"))
        again = cells.drop("differs").join(kinds, ["host", "above", "branch"])
        pooled = again.groupBy("host", "above", "kind", "below").agg(F.sum("labels").alias("all_labels"), F.sum("bad").alias("all_bad"))
        again = again.join(pooled, ["host", "above", "kind", "below"]).groupBy("host", "above", "branch", "kind").agg(F.max((F.col("kind") != 0) & (_differs(p) != 0)).alias("apart"))
        rows = rows.join(again, ["host", "above", "branch"], "left")
        shared = F.concat(F.lit("~"), F.when(F.col("kind") != 0, F.lower(F.hex("kind"))).otherwise(""))
        new = F.when(F.col("apart"), F.col("template")).otherwise(F.concat("above", F.array(shared), "below"))
        rows = cut(rows.withColumn("template", F.when(F.col("branch").isNull(), F.col("template")).otherwise(new)).select("host", "leaf", "labels", "bad", "template"), f"merged-{d}")
    return rows


def template_verdicts(shapes: DataFrame, p: TreeParams) -> DataFrame:
    """(host, shape, template, bad_share) from (host, shape, n, labels, bad)."""
    tree, depth = grown(shapes, p)
    sums = (F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    leaves = merged(cut(tree.groupBy("host", "leaf").agg(*sums), "leaves"), depth, p)

    overall = leaves.agg(*sums).select((F.coalesce("bad", F.lit(0)) / F.greatest(F.coalesce("labels", F.lit(0)), F.lit(1))).alias("overall"))
    hosts = leaves.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("bad").alias("host_bad"))
    hosts = hosts.crossJoin(F.broadcast(overall))  # a single row
    hosts = hosts.select("host", ((F.col("host_bad") + p.weight * F.col("overall")) / (F.col("host_labels") + p.weight)).alias("host_share"))
    purity = leaves.groupBy("host", "template").agg(*sums).join(hosts, "host")
    purity = purity.select("host", "template", ((F.col("bad") + p.weight * F.col("host_share")) / (F.col("labels") + p.weight)).alias("bad_share"))
    named = tree.select("host", "shape", "leaf").join(leaves.select("host", "leaf", "template"), ["host", "leaf"])
    shown = F.concat(F.lit("/"), F.array_join("template", "/"))
    return named.join(purity, ["host", "template"]).select("host", "shape", shown.alias("template"), "bad_share")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[UrlRule, ...] = RULES, p: TreeParams = TreeParams()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) for each row of ``pages``.

    pages has ``page_id`` and ``url``; labelled has ``page_id`` and ``bad``
    (boolean). Other columns are ignored. A null url, or one without ``://``,
    has an empty host and path, which are a host and a path like others; pages
    without labels, and empty labels, leave the priors alone (allow). Null or
    repeated page ids each get a row; labels of one page_id are merged (bad if
    any is), labels that are null are none.
    """
    host, path = split_url()
    rule, ruled = longest_rule(rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", path_shape())
    marks = labelled.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = rows.join(marks, "page_id", "left")
    shapes = known.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0).cast("long")).alias("bad"))
    judged = cut(template_verdicts(cut(shapes, "shapes"), p), "verdicts")
    method = F.when(F.col("bad_share") >= p.reject, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"), "template", "bad_share")
