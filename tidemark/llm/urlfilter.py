"""URL filters: explicit rules, then a tree of path templates with labelled purity.

A template is a host's path with variable segments as wildcards. A segment that is a number, long
hexadecimal or a date is a wildcard by form. The tree of each host is then grown level by level from the root, with
aggregations: a node is variable if its children, without the most frequent one, are as diverse as ``MANY`` equally frequent ones
(by their entropy, which doesn't depend on the number of rows); its children become one ``*``.

From the deepest level up, similar branches are merged. Children of a node with ``MIN_LABELS`` labels or more are put in order of
their smoothed purity, (good + PRIOR * share) / (labelled + PRIOR), those that agree to 1 / ``GRID`` together. Then the two neighbours that differ least
are pooled, again and again, for as long as two pooled groups differ by at most ``WIDTH`` standard errors of their difference: what is tested is
always the whole of both groups, so that small steps don't add up to a chain. Groups are called ``+1``, ``+2`` ... from the least pure on. Children with fewer labels share a ``+``. A child alone keeps its
name. A template is rejected when its smoothed purity falls under ``MIN_PURITY`` times the share, which is that of all labelled rows.

Only counts by template move between tasks: rows are summed before each
shuffle, so a host with a third of all pages costs what its templates cost. A node's groups are found in one array of at most ``GRID`` + 1 counts.

Defined results: a null url or one without ``://`` has an empty host and path and
the verdict of the empty template. Paths are whole, however deep; each level at which some host has two segments or more costs a few small jobs. Labels of no page, null labels and repeated labels (their mean counts) do no harm. An empty table gives an empty one.
Columns of the pages that have the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: A node with so many equally frequent children, or as diverse ones, is variable.
MANY = 20.0
MIN_LABELS, WIDTH, GRID, PRIOR, MIN_PURITY = 5, 1.0, 200, 6.0, 0.7

#: Verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: list = RULES) -> Column:
    """A struct of rule and verdict of the longest rule that fits, else null."""
    out = None
    for verdict, where, prefix in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1:])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(prefix)
        value = F.struct(F.lit(where + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _formed(segment: Column) -> Column:
    """A segment, or its wildcard when its form shows that it varies."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{2,5}$", "")
    return (
        F.when(stem.rlike(r"^\d+$"), "{n}")
        .when(stem.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), "{date}")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "{hex}")
        .otherwise(segment)
    )


def signature(path: Column) -> Column:
    """The segments of a path, variable forms replaced."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _formed)


def _replaced(sig: Column, level: int, value: Column) -> Column:
    return F.transform(sig, lambda s, i: F.when(i == level - 1, value).otherwise(s))


def _at(tree: DataFrame, level: int) -> DataFrame:
    """``tree`` with the node above a level (``up``) and the child there; null where a template ends before it."""
    deep = F.size("template") >= level
    return tree.withColumn("up", F.when(deep, F.slice("template", 1, level - 1))).withColumn("child", F.when(deep, F.element_at("template", level)))


def branching(counted: DataFrame, least: int) -> list[int]:
    """The levels at which some host has ``least`` segments or more; no other level can have a node with as many children."""
    each = counted.select("host", F.posexplode("sig").alias("level", "child")).distinct()
    wide = each.groupBy("host", "level").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sorted(r[0] + 1 for r in wide.select("level").distinct().collect())


def generalise(counted: DataFrame) -> DataFrame:
    """Templates for (host, sig, n, labelled, good): adds ``template``, wildcards found level by level from the root."""
    tree = stored(counted.withColumn("template", F.col("sig")), "url-tree")
    for level in branching(counted, int(MANY)):
        own = _at(tree, level)
        child = own.where("child is not null").groupBy("host", "up", "child").agg(F.sum("n").cast("double").alias("n"))
        node = child.groupBy("host", "up").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.sum(F.col("n") * F.log("n")).alias("bits"))
        rest = F.col("all") - F.col("top")
        diversity = F.when(rest > 0, F.log(rest) - (F.col("bits") - F.col("top") * F.log("top")) / rest)
        wide = node.where(diversity >= F.log(F.lit(MANY)) - 1e-9).select("host", "up", F.lit("*").alias("wild"))
        made = F.when(F.col("wild").isNotNull(), _replaced(F.col("template"), level, F.lit("*"))).otherwise(F.col("template"))
        # each level is read twice by the next one
        new = stored(own.join(wide, ["host", "up"], "left").withColumn("template", made).select(*tree.columns), "url-tree")
        discard(tree)
        tree = new
    return tree


def pooled(groups: Column, share: float) -> Column:
    """Groups (cells, labelled, good) in order of purity, with the closest neighbours pooled until the closest differ by more than ``WIDTH`` standard errors."""
    purity = lambda g: (g["good"] + PRIOR * share) / (g["labelled"] + PRIOR)
    error = lambda g: purity(g) * (1 - purity(g)) / (g["labelled"] + PRIOR)
    union = lambda u, v: F.struct(F.concat(u["cells"], v["cells"]).alias("cells"), (u["labelled"] + v["labelled"]).alias("labelled"), (u["good"] + v["good"]).alias("good"))

    def gap(u: Column, v: Column) -> Column:
        apart = F.abs(purity(u) - purity(v))
        return F.when(apart == 0, 0.0).otherwise(apart / F.sqrt(error(u) + error(v)))

    def step(done: Column, _: Column) -> Column:
        n = F.size(done)
        gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.when(i < n, gap(F.get(done, i - 1), F.get(done, i))))
        at = F.array_position(gaps, F.array_min(gaps)).cast("int")
        joined = F.concat(F.slice(done, 1, at - 1), F.array(union(F.get(done, at - 1), F.get(done, at))), F.slice(done, at + 2, n))
        return F.when((n > 1) & (F.array_min(gaps) <= WIDTH), joined).otherwise(done)

    return F.aggregate(F.sequence(F.lit(1), F.size(groups)), groups, step)


def merge_branches(tree: DataFrame, share: float, levels: list[int]) -> DataFrame:
    """``tree`` with similar children of a node merged, level by level from the deepest one."""
    for level in reversed(levels):
        own = _at(tree, level)
        child = own.where("child is not null").groupBy("host", "up", "child").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        p = (F.col("good") + PRIOR * share) / (F.col("labelled") + PRIOR)
        child = stored(child.withColumn("cell", F.when(F.col("labelled") >= MIN_LABELS, F.floor(p * GRID).cast("int")).otherwise(-1)), "url-children")
        cells = child.where("cell >= 0").groupBy("host", "up", "cell").agg(F.sum("labelled").cast("double").alias("labelled"), F.sum("good").cast("double").alias("good"))
        row = F.struct("cell", F.array("cell").alias("cells"), "labelled", "good")
        found = cells.groupBy("host", "up").agg(F.array_sort(F.collect_list(row)).alias("g"))
        found = found.select("host", "up", pooled(F.transform("g", lambda x: F.struct(x["cells"].alias("cells"), x["labelled"].alias("labelled"), x["good"].alias("good"))), share).alias("g"))
        of = found.select("host", "up", F.posexplode("g").alias("k", "x")).select("host", "up", (F.col("k") + 1).alias("k"), F.explode("x.cells").alias("cell"))
        group = child.join(of, ["host", "up", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
        # a name is for two children or more
        several = group.groupBy("host", "up", "k").agg(F.count("*").alias("n")).where("n > 1").select("host", "up", "k", F.concat(F.lit("+"), F.when(F.col("k") > 0, F.col("k").cast("string")).otherwise("")).alias("name"))
        names = stored(group.join(several, ["host", "up", "k"]).select("host", "up", "child", "name"), "url-names")
        made = F.when(F.col("name").isNotNull(), _replaced(F.col("template"), level, F.col("name"))).otherwise(F.col("template"))
        new = stored(own.join(names, ["host", "up", "child"], "left").withColumn("template", made).select(*tree.columns), "url-tree")
        discard(tree, child, names)
        tree = new
    return tree


def templates(pages: DataFrame) -> DataFrame:
    """(host, sig, template, purity, verdict) for (host, sig, label), label 1 good, 0 bad or null. Stored."""
    known = F.col("label").isNotNull()
    counted = pages.groupBy("host", "sig").agg(F.count("*").alias("n"), F.count_if(known).alias("labelled"), F.sum(F.coalesce("label", F.lit(0.0))).alias("good"))
    counted = stored(counted, "url-counts")
    labelled, good = counted.agg(F.sum("labelled"), F.sum("good")).first()
    share = float(good) / labelled if labelled else 1.0
    tree = merge_branches(generalise(counted), share, branching(counted, 2))
    # stored, so that the joins have shuffles of their own, which Spark splits where one key has many rows
    leaf = stored(tree.groupBy("host", "template").agg(((F.sum("good") + PRIOR * share) / (F.sum("labelled") + PRIOR)).alias("purity")), "url-leaves")
    verdict = F.when(F.col("purity") < MIN_PURITY * share, "block").otherwise("allow")
    out = stored(tree.join(leaf, ["host", "template"]).select("host", "sig", "template", "purity", verdict.alias("verdict")), "url-templates")
    discard(counted, tree, leaf)
    return out


def judge(pages: DataFrame, labels: DataFrame | None = None, url_col: str = "url", rules: list = RULES, key: Column | None = None, label_key: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``pages`` with host, path, template, purity, rule and verdict, in place of columns of these names.

    ``labels`` is joined by ``key`` (an expression over the pages) = ``label_key``; repeated keys count with their mean.
    """
    path = path_of(F.col(url_col))
    made = ("host", "path", "template", "purity", "rule", "verdict")
    row = pages.select(F.struct(*(F.col(c) for c in pages.columns if c not in made)).alias("page"), host_of(F.col(url_col)).alias("host"), path.alias("path"), signature(path).alias("sig"), (F.lit(None).cast("long") if key is None else key.cast("long")).alias("key"))
    if labels is None:
        marked = row.select("host", "sig", F.lit(None).cast("double").alias("label"))
    else:
        by = labels.groupBy(F.col(label_key).cast("long").alias("key")).agg(F.avg(label_col).alias("label"))
        marked = row.select("host", "sig", "key").join(by, "key", "left").select("host", "sig", "label")
    found = templates(marked).select("host", "sig", F.array_join("template", "/").alias("template"), "purity", F.col("verdict").alias("method"))
    exact = explicit(F.col("host"), F.col("path"), rules)
    return row.join(found, ["host", "sig"]).select("page.*", "host", "path", "template", "purity", exact["rule"].alias("rule"), F.coalesce(exact["verdict"], F.col("method")).alias("verdict"))
