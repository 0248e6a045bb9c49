"""URL filters: fixed host-and-path rules, then a path-template tree judged by labelled purity.

Built from DataFrame operations alone. Per host, a path's segments are generalised in two steps: runs of digits
become ``*``; then, node by node from the root, a segment that is rare among its siblings and has too
few labels to be judged on its own (variable, such as a slug) becomes ``*`` as well. What all paths of a node have
in common is walked in one step, so the tree reaches the deepest segment in as many levels as paths branch.

Sibling branches whose rates of bad labels don't differ significantly from the siblings' pooled rate are
merged. A template (or merged group) is rejected by its labelled purity, 1 less the bad rate: the rate is
smoothed toward its parent's, the parent's toward the global rate, and it must lie ``LIFT`` of the way from
the global rate to 1.

Everything after the first aggregation works on (host, shape) counts, not on pages; the pages meet the rejected
shapes in one equi-join. Rows of a node, template or shape that holds many of them aren't shuffled by it.

Defined cases: null url or one without ``://``: host and path empty, no rule, no template, allow.
Repeated page ids are judged each; a null page id is judged and bears no label. Several labels of one page: bad if
any is. Pages without label count in the tree and not in the purity. No labels: every template is allowed.
A template whose smoothed rate equals the threshold is rejected. Paths of any length are walked to their end.
An empty table gives an empty result. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, skew_join

# The rules of the registered query, (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A segment is kept if its pages are at least SUPPORT, and either 1 in SHARE of its parent's or enough labelled
#: ones (SMOOTHING) to be judged without its siblings.
SHARE, SUPPORT = 50, 3
#: Branches within so many standard errors of the siblings' pooled bad rate are merged.
SIGMAS = 1.96
#: Labels that the smoothing counts at the parent's rate; how far from the global bad rate to 1 rejection begins.
SMOOTHING, LIFT = 10.0, 1 / 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. Rules are a parameter, at most a few hundred."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, name).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """The path's segments with digit runs as ``*``."""
    general = F.regexp_replace(path, "[0-9]+", "*")
    return F.array_join(F.filter(F.split(general, "/"), lambda s: s != ""), "/")


def _joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), "")


def _tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, labelled, bad) -> (host, shape, template, parent, labelled, bad), down to the deepest segment."""
    rest = F.filter(F.split("shape", "/"), lambda s: s != "")
    rows = cut(shapes.select("*", rest.alias("rest"), F.lit("").alias("prefix"), F.lit("").alias("above"), F.col("host").alias("node")), "nodes")
    ended = []
    while True:
        # how many segments all paths of a node have in common: those of the first and the last in order
        same = F.zip_with(F.min("rest"), F.max("rest"), lambda a, b: a.eqNullSafe(b))
        first = F.array_position(same, False)
        common = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
        nodes = rows.groupBy("node").agg(common.alias("common"), F.sum("n").alias("n_all"))
        rows = skew_join(rows, nodes, "node")
        run = F.slice("rest", F.lit(1), F.col("common"))
        run = F.when(F.col("n_all") >= SUPPORT, run).otherwise(F.transform(run, lambda _: F.lit("*")))
        but_last = F.slice(run, F.lit(1), F.greatest(F.col("common") - 1, F.lit(0)))
        rows = rows.withColumns(
            {
                "above": F.when(F.col("common") > 0, F.concat("prefix", _joined(but_last))).otherwise(F.col("above")),
                "prefix": F.concat("prefix", _joined(run)),
                "rest": F.slice("rest", F.col("common") + 1, F.size("rest")),
            }
        )
        segment = F.get("rest", F.lit(0))
        rows = cut(rows.withColumn("child", F.concat("host", "prefix", F.lit("/"), segment)), "level")
        ended.append(rows.where("child is null"))
        rows = rows.where("child is not null")
        children = rows.groupBy("child").agg(F.sum("n").alias("n_here"), F.sum("labelled").alias("marked"))
        rows = skew_join(rows, children, "child")
        told = (F.col("n_here") * SHARE >= F.col("n_all")) | (F.col("marked") >= SMOOTHING)
        name = F.when((F.col("n_here") >= SUPPORT) & told, segment).otherwise(F.lit("*"))
        rows = rows.withColumn("name", name).withColumn("above", F.col("prefix"))
        rows = rows.withColumns({"prefix": F.concat("prefix", F.lit("/"), "name"), "rest": F.slice("rest", F.lit(2), F.size("rest"))})
        rows = cut(rows.withColumn("node", F.concat("host", "prefix")).drop("child", "common", "n_all", "n_here", "marked", "name"), "nodes")
        if rows.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, ended)
    return rows.select("host", "shape", F.col("prefix").alias("template"), F.col("above").alias("parent"), "labelled", "bad")


def rejected_shapes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(address, template) of the shapes whose template, after merging, is rejected; the address is host and shape.

    pages: (page_id, host, shape); labels: (page_id, bad 0/1), one row a page.
    """
    seen = pages.select("host", "shape", F.lit(1).alias("n"), F.lit(0).alias("labelled"), F.lit(0).alias("bad"))
    # labels are as many as their table's; a merge at every size, so that neither side is sent to all
    marked = pages.join(labels.hint("merge"), "page_id").select("host", "shape", F.lit(0).alias("n"), F.lit(1).alias("labelled"), "bad")
    counted = seen.unionByName(marked).groupBy("host", "shape").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    tree = cut(_tree(counted).withColumn("place", F.concat("host", "template")), "tree")
    base = labels.agg(F.avg(F.col("bad").cast("double"))).first()[0] or 0.0  # one number
    branches = tree.groupBy("host", "parent", "template", "place").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    pooled = branches.groupBy("host", "parent").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    branches = branches.join(pooled, ["host", "parent"])
    rate = F.try_divide(F.col("all_bad").cast("double"), F.col("all_labelled"))
    own = F.try_divide(F.col("bad").cast("double"), F.col("labelled"))
    error = F.sqrt(rate * (1 - rate) / F.col("labelled"))
    apart = F.coalesce(F.abs(own - rate) > SIGMAS * error, F.lit(False))
    branches = cut(branches.withColumn("group", F.when(apart, F.col("template")).otherwise(F.lit(""))), "branches")
    groups = branches.groupBy("host", "parent", "group").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.first("all_labelled").alias("all_labelled"), F.first("all_bad").alias("all_bad")
    )
    parents = (F.col("all_bad") + SMOOTHING * F.lit(base)) / (F.col("all_labelled") + SMOOTHING)
    smoothed = (F.col("bad") + SMOOTHING * parents) / (F.col("labelled") + SMOOTHING)
    judged = groups.where((smoothed >= base + (1 - base) * LIFT) & (F.col("labelled") > 0)).select("host", "parent", "group")
    bad = cut(branches.join(judged, ["host", "parent", "group"]).select("place", F.lit(True).alias("rejected")), "rejected")
    found = skew_join(tree.select("host", "shape", "template", "place"), bad, "place")
    return cut(found.select(F.concat_ws("/", "host", "shape").alias("address"), "template"), "rejected")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    labels: (page_id, bad); rows with null in either are ignored.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("shape", shape_of(F.col("path"))).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    rows = cut(rows.withColumn("address", F.when(F.col("host") != "", F.concat_ws("/", "host", "shape"))), "pages")
    marks = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rejected = rejected_shapes(rows.where("host <> ''").select("page_id", "host", "shape"), marks)
    judged = skew_join(rows.drop("shape"), rejected, "address", "left")
    method = F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"))
