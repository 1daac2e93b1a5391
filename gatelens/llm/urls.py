"""URL filter by a tree of path templates, in built-in functions only.

Rules decide first. For the other urls, paths are reduced to templates: runs of
digits are wildcards at once; then, level by level below each host, segments
with little support become a wildcard, and sibling branches whose labelled
shares don't differ significantly are merged. Both go by counts and labels of
the branches alone, however large their host is. A template is rejected by its
share of bad labels, smoothed by the share of the same template over all hosts,
which in turn is smoothed by the share overall. Labels are what the rules
decided, or any column of 1 (bad), 0 (good) and null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); a rule's name is host and path together.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The segments that the SQL knows; the operator goes on to the last one.
DEPTH = 3
SUPPORT = 2
Z2 = 4
PRIOR = 4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the columns host and path; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """All segments, digit runs as wildcards."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "*"), "/"), lambda x: x != "")


def _differ(b1: Column, n1: Column, b2: Column, n2: Column) -> Column:
    """Whether two shares of bad labels differ by more than two standard errors; false without labels on a side."""
    p, d = (b1 + b2) / F.nullif(n1 + n2, F.lit(0)), b1 / F.nullif(n1, F.lit(0)) - b2 / F.nullif(n2, F.lit(0))
    return F.coalesce(d * d > Z2 * p * (1 - p) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))), F.lit(False))


def _branches(some: DataFrame) -> DataFrame:
    """(host, template, share, segs, name) of siblings with labels.

    Siblings of equal shares are one group at once, so that a window holds a
    parent's different shares, not its segments. In the order of shares, a group
    that doesn't differ from the one before goes to its branch. A branch of
    several segments is named by the first, the last and their number.
    """
    parent = ["host", "template"]
    groups = some.groupBy(*parent, "share").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("segs"), F.min("seg").alias("first"), F.max("seg").alias("last")
    )
    order = Window.partitionBy(*parent).orderBy("share")
    lag = lambda c: F.lag(c).over(order)
    apart = lag("labelled").isNull() | _differ(F.col("bad"), F.col("labelled"), lag("bad"), lag("labelled"))
    groups = groups.withColumn("branch", F.sum(apart.cast("int")).over(order))
    whole = Window.partitionBy(*parent, "branch")
    first, last, n = F.min("first").over(whole), F.max("last").over(whole), F.sum("segs").over(whole)
    return groups.select(*parent, "share", "segs", F.when(n == 1, first).otherwise(F.concat(first, F.lit(".."), last, F.lit("|"), n.cast("string"))).alias("name"))


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, labelled, bad) -> the same with the shape's template; a level more for as long as any shape has one."""
    df = materialize(shapes.withColumn("template", F.lit("")), "templates")
    done, d = [], 0
    while True:
        done.append(df.where(F.size("shape") <= d))
        df = df.where(F.size("shape") > d)
        if df.isEmpty():
            return reduce(DataFrame.unionByName, done)
        df = df.withColumn("seg", F.get("shape", F.lit(d)))
        child = df.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.count("*").alias("shapes"))
        child = materialize(child.withColumn("share", F.when(F.col("n") >= SUPPORT, F.col("bad") / F.nullif("labelled", F.lit(0)))), "children")
        # without labels there is nothing to compare: such a segment is a branch of its own
        alone = child.where("share is null").withColumn("name", F.when(F.col("n") >= SUPPORT, F.col("seg")).otherwise("*"))
        some = child.where("share is not null")
        branches = materialize(_branches(some), "branches")
        some = join_hot(some, branches, ["host", "template", "share"], "segs", some.count())
        known = materialize(alone.unionByName(some).select("host", "template", "seg", "name", "shapes"), "known")
        nodes = known.groupBy("host", "template", "name").agg(F.sum("shapes").alias("left"), F.count("*").alias("segs"))
        known = join_hot(known, nodes, ["host", "template", "name"], "segs", known.count())
        df = join_hot(df, materialize(known, "known"), ["host", "template", "seg"], "shapes", df.count())
        df = df.withColumn("template", F.concat("template", F.lit("/"), "name"))
        # a node of one shape has one branch a level to the end, so long paths that nothing shares end here
        rest = F.slice("shape", d + 2, F.greatest(F.size("shape") - (d + 1), F.lit(0)))
        to_end = F.array_join(F.transform(rest, lambda x: F.concat(F.lit("/"), F.when(F.col("n") >= SUPPORT, x).otherwise("*"))), "")
        df = materialize(df.withColumn("template", F.when(F.col("left") == 1, F.concat("template", to_end)).otherwise(F.col("template"))).drop("seg", "name"), "templates")
        done.append(df.where("left = 1").drop("left"))
        df = df.where("left > 1").drop("left")
        d += 1


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, bad: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row.

    A null url, or one without ``://``, has an empty host and path; such rows
    share one template. The verdict is the longest fitting rule's; else that of
    the url's template, ``block`` if its smoothed share of bad labels is over a
    half. bad may name labels of its own; by default the rules' verdicts are the
    labels. Without any label the overall share is a half, which lets pass.
    template is null where a rule decides. Ids may be null or repeat; equal urls
    get equal verdicts; other columns play no part. No rows in, no rows out.
    """
    url = F.col(url_col)
    own = F.lit(None).cast("int") if bad is None else bad.cast("int")
    df = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), own.alias("given"))
    name, verdict = by_rules(rules)
    df = df.withColumns({"rule": name, "verdict": verdict})
    if bad is None:
        df = df.withColumn("given", F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0))
    df = df.withColumn("shape", shape_of(F.col("path")))
    counts = df.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("given").alias("labelled"), F.coalesce(F.sum("given"), F.lit(0)).cast("long").alias("bad"))
    tree = materialize(templates(counts), "tree")
    leaf = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    alike = leaf.groupBy("template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    overall = leaf.agg(F.sum("labelled").alias("sum_labelled"), F.sum("bad").alias("sum_bad"))
    share = (F.col("sum_bad") + 1) / (F.col("sum_labelled") + 2)
    alike = alike.crossJoin(F.broadcast(overall)).withColumn("like", (F.col("all_bad") + PRIOR * share) / (F.col("all_labelled") + PRIOR))  # overall: one row
    impure = (F.col("bad") + PRIOR * F.col("like")) / (F.col("labelled") + PRIOR)
    judged = leaf.join(alike, "template").withColumn("said", F.when(impure > 0.5, "block").otherwise("allow")).select("host", "template", "said")
    leaves = tree.groupBy("host", "template").agg(F.count("*").alias("shapes"))
    judged = judged.join(leaves, ["host", "template"])
    judged = join_hot(tree.select("host", "shape", "template", "n"), materialize(judged, "judged"), ["host", "template"], "shapes", tree.count())
    decided = df.where("verdict is not null").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"))
    rest = df.where("verdict is null").select("page_id", "host", "path", "rule", "shape")
    rest = join_hot(rest, materialize(judged, "judged"), ["host", "shape"], "n", pages.count())
    rest = rest.select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), "template")
    return decided.unionByName(rest)


def sql(rules: tuple[tuple[str, str, str], ...] = RULES, depth: int = DEPTH) -> str:
    """The same in DuckDB's SQL, for paths of up to depth segments."""
    when = lambda i: " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(v, h + p)[i]}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    out = [
        "u as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), "
        f"'{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages)",
        f"v as (select *, case {when(1)} end as rule, case {when(0)} end as verdict, list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x <> '') as parts from u)",
        f"s as (select page_id, host, path, rule, verdict, case when len(parts) > {depth} then list_append(list_slice(parts, 1, {depth}), '**') else parts end as shape from v)",
        "t0 as (select host, shape, count(*) as n, count(verdict) as labelled, sum((coalesce(verdict, '') = 'block')::int) as bad, '' as template from s group by host, shape)",
    ]
    for d in range(depth + 1):
        a = f"t{d}"
        out += [
            f"c{d} as (select host, template, shape[{d + 1}] as seg, sum(n) as n, sum(labelled) as labelled, sum(bad) as bad from {a} where len(shape) > {d} group by all)",
            f"k{d} as (select *, case when n >= {SUPPORT} then bad / nullif(labelled, 0) end as p from c{d})",
            f"q{d} as (select host, template, p, sum(labelled) as labelled, sum(bad) as bad, count(*) as segs, min(seg) as a, max(seg) as z from k{d} where p is not null group by host, template, p)",
            f"l{d} as (select *, lag(bad) over w as b2, lag(labelled) over w as n2 from q{d} window w as (partition by host, template order by p))",
            f"m{d} as (select *, (bad + b2) / nullif(labelled + n2, 0) as q, bad / nullif(labelled, 0) - b2 / nullif(n2, 0) as x from l{d})",
            f"b{d} as (select *, sum((n2 is null or coalesce(x * x > {Z2} * q * (1 - q) * (1 / nullif(labelled, 0) + 1 / nullif(n2, 0)), false))::int) over (partition by host, template order by p) as branch from m{d})",
            f"g{d} as (select host, template, p, min(a) over v as a, max(z) over v as z, sum(segs) over v as segs from b{d} window v as (partition by host, template, branch))",
            f"s{d} as (select k.host, k.template, k.seg, case when n < {SUPPORT} then '*' when k.p is null or segs = 1 then seg else a || '..' || z || '|' || segs end as name from k{d} k left join g{d} g on k.host = g.host and k.template = g.template and k.p = g.p)",
            f"t{d + 1} as (select a.host, a.shape, a.n, a.labelled, a.bad, case when len(a.shape) > {d} then a.template || '/' || g.name else a.template end as template from {a} a left join s{d} g on g.host = a.host and g.template = a.template and g.seg = a.shape[{d + 1}])",
        ]
    out += [
        f"leaf as (select host, template, sum(labelled) as labelled, sum(bad) as bad from t{depth + 1} group by all)",
        f"alike as (select template, (sum(bad) + {PRIOR} * (select (sum(bad) + 1) / (sum(labelled) + 2) from leaf)) / (sum(labelled) + {PRIOR}) as alike from leaf group by template)",
        f"judged as (select t.host, t.shape, t.template, case when (l.bad + {PRIOR} * alike.alike) / (l.labelled + {PRIOR}) > 0.5 then 'block' else 'allow' end as said from t{depth + 1} t join leaf l using (host, template) join alike using (template))",
    ]
    return f"with {', '.join(out)} select page_id, s.host, path, rule, coalesce(verdict, said) as verdict, case when verdict is null then template end as template from s join judged using (host, shape)"
