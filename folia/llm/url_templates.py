"""URL filters by a path-template tree, in DataFrame operations only.

Per host, paths form a tree of segments. Segments that are plainly identifiers turn
into typed wildcards at once, which folds the urls into few (host, path) rows.
Then, level by level: children whose labelled purity doesn't differ significantly
from their siblings' merge into ``*``; of a node with many children also those with
too few labels to tell. A template is rejected when its smoothed share of bad labels, with
its host and the whole table as priors, exceeds a threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A node with more children than this has a variable segment there.
MANY_CHILDREN = 16
#: Labelled urls from which a child of such a node is tested, not merged at once.
LEAST_LABELLED = 5
#: Weight of the prior, in labelled urls, and the bad share above which a template is rejected.
PRIOR, REJECT = 10.0, 0.5
#: Standard errors by which a branch's bad share differs significantly from its siblings'.
DIFFERENT = 2.0

#: Rows of a tree that is broadcast.
MOST_BROADCAST = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (host/path) whose host is the url's or a parent domain and whose path begins the url's; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the last one wraps the others, so the longest is tried first
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def typed_segment(segment: Column) -> Column:
    """Identifiers as typed wildcards, with a file suffix kept; other segments as they are."""
    stem, suffix = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,5})?$", 2)
    return (
        F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("<n>"), suffix))
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), F.concat(F.lit("<date>"), suffix))
        .when(stem.rlike(r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$") | stem.rlike(r"(?i)^(?=.*[0-9])[0-9a-f]{12,}$"), F.concat(F.lit("<hex>"), suffix))
        .when(stem.rlike(r"[0-9]{3,}"), F.concat(F.regexp_replace(stem, "[0-9]+", "<n>"), suffix))
        .otherwise(segment)
    )


def folded(urls: DataFrame) -> DataFrame:
    """``host, shape, n, labelled, bad``: urls (host, path, bad or null) counted by host and typed path."""
    shape = shape_of(F.col("path"))
    return urls.groupBy("host", shape.alias("shape")).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad"))


def shape_of(path: Column) -> Column:
    """A path with its identifiers typed."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), typed_segment), "/")


def generalised(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``template``: level by level, variable and statistically similar branches become ``*``."""
    now, done, level, parts = shapes.withColumn("template", F.lit("")), [], 0, F.split("shape", "/")
    while not now.isEmpty():
        here = now.withColumn("segment", F.get(parts, F.lit(level)))
        children = here.groupBy("host", "template", "segment").agg(F.sum("labelled").alias("c_labelled"), F.sum("bad").alias("c_bad"), F.count("*").alias("c_shapes"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("c"), F.sum("c_labelled").alias("t_labelled"), F.sum("c_bad").alias("t_bad"))
        share = (F.col("t_bad") + 1) / (F.col("t_labelled") + 2)
        error = F.sqrt(share * (1 - share) / F.greatest("c_labelled", F.lit(1)))
        alike = (F.col("c_labelled") == 0) | (F.abs(F.col("c_bad") / F.greatest("c_labelled", F.lit(1)) - share) <= DIFFERENT * error)
        few = (F.col("c") > MANY_CHILDREN) & (F.col("c_labelled") < LEAST_LABELLED)
        merged = (F.col("c") > 1) & (alike | few) & (F.col("segment") != "")
        kept = F.when(merged, F.lit("*")).otherwise(F.col("segment"))
        # a branch of one shape has nothing left to merge and ends here, so only shared branches cost further levels
        alone = (F.col("c_shapes") == 1) & (kept != "*")
        chosen = children.join(nodes, ["host", "template"]).select("host", "template", "segment", kept.alias("kept"), alone.alias("alone"))
        rest = F.array_join(F.slice(parts, level + 1, F.size(parts)), "/")
        step = common.looked_up(here, chosen, ["host", "template", "segment"], "inner", MOST_BROADCAST).withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("kept"))))
        level += 1
        made = common.stored(step.select(*shapes.columns, "template", (F.col("alone") | (F.size(parts) <= level)).alias("ended")), "templates")
        done.append(made.filter("ended").drop("ended"))
        now = made.filter("not ended").drop("ended")
    return reduce(DataFrame.unionByName, done) if done else now


def judged_templates(shapes: DataFrame) -> DataFrame:
    """``host, shape, template, bad_share, rejected`` from ``generalised`` rows."""
    whole = shapes.agg(((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("p")).first()[0]
    overall = 0.5 if whole is None else float(whole)
    hosts = shapes.groupBy("host").agg(((F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)).alias("host_share"))
    trees = shapes.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).join(hosts, "host")
    judged = trees.select("host", "template", ((F.col("b") + PRIOR * F.col("host_share")) / (F.col("l") + PRIOR)).alias("bad_share"))
    return shapes.select("host", "shape", "template").join(judged, ["host", "template"]).withColumn("rejected", F.col("bad_share") > REJECT)


def verdicts(pages: DataFrame, rules: dict[str, str], labels: DataFrame | None, key: Column | None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, template, bad_share`` of each row of ``pages``.

    ``rules``: host/path to allow or block. ``labels`` (label_key, bad 0 or 1) teach the
    tree, met by ``key``, an expression over ``pages``; a key's labels are averaged
    to the worse. A null url, or one without ``://``, has an empty host and path and
    is judged like any other; urls of any length count whole. Of rules of one length
    the later in alphabetical order wins. Repeated rows are judged alike, null ids like
    others; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    source = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(source).alias("host"), path_of(source).alias("path"), (key if key is not None else F.lit(None)).alias("__key"))
    if labels is None or key is None:
        marked = rows.withColumn("bad", F.lit(None).cast("bigint"))
    else:
        known = labels.filter("label_key is not null and bad in (0, 1)").groupBy("label_key").agg(F.max("bad").cast("bigint").alias("bad"))
        small = common.small_enough(known)
        marked = rows.join(F.broadcast(known) if small else known, F.col("__key") == F.col("label_key"), "left")
    tree = judged_templates(generalised(common.stored(folded(marked.select("host", "path", "bad")), "shapes")))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for name, verdict in rules.items():
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    out = common.looked_up(rows.withColumn("shape", shape_of(F.col("path"))), tree, ["host", "shape"], rows=MOST_BROADCAST).withColumn("rule", rule)
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"), "template", "bad_share")
