"""URL filters: host and path rules, and a path-template tree for the URLs that no rule fits.

Rules name a host (with all its subdomains) and the start of a path; the longest that fits decides. Where none does,
the tree decides. A host is a root, and its paths grow it, segment by segment, to the end of the longest one:

* Runs of digits are wildcards from the start. A node with many children of little support each gets one wildcard
  child instead.
* Children that are statistically alike merge in one branch. Their segments below must be distributed as those of the
  node as a whole are (a total variation distance of at most 1 / 4, or 1 / 2 where so few URLs could differ by chance),
  and their labels, if they have any, must be blocked as often (within two standard errors).
* A template's purity is the blocked share of its labels, smoothed towards its parent's by SMOOTHING labels; a host's
  own is smoothed towards one half. So a template without labels has the purity of what it is merged with, or else of
  the node above it, and one of a host without labels is allowed. A template is rejected when its purity is at least
  PURITY / 10. A child with all URLs of its node has its node's purity.

Labels are the rules' own verdicts unless a label column is given. All statistics are aggregates of the distinct path
shapes, pre-aggregated, and joins part the keys that many shapes or URLs share, so a host with a third of all URLs is
no group of its own anywhere. A round settles one branching level of
all hosts; what a node's paths have in common is passed over at once.

Edge cases: a null URL, or one without `://`, has the empty host and path, fits no rule and shares the template of
other such rows; ties between rules of equal length go to the first by text; repeated rows count each; an empty table
gives an empty one; long paths are read whole; columns named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import col, without
from rowloom.llm._skew import parted_join
from rowloom.session import cut_lineage, discard

#: verdict, host, start of path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MOST_RULES = 1000

#: A node gets a wildcard child when it has more children than this, with fewer URLs to each than SUPPORT.
CHILDREN, SUPPORT = 16, 4
#: Labels' worth of the purity above; the purity, in tenths, from which a template is rejected.
SMOOTHING, PURITY = 2, 8
#: Stands for the end of a path, and for the branch of merged children.
END, MERGED = "$", "~"

RESULT = ("host", "path", "rule", "verdict")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    place = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(place > 0, F.substr(url, place + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _ordered(rules) -> list[tuple[str, str, str]]:
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: they are compiled into one expression")
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def rule_index(host: Column, path: Column, rules) -> Column:
    """The place of the fitting rule in the order of precedence, or null."""
    out = F.lit(None).cast("int")
    for i, (_, h, p) in reversed(list(enumerate(_ordered(rules)))):
        out = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), i).otherwise(out)
    return out


def _pick(index: Column, values: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for i, value in enumerate(values):
        out = F.when(index == i, value).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """The path with its runs of digits as wildcards."""
    return F.regexp_replace(path, "[0-9]+", "*")


def purity(labelled: Column, blocked: Column, above: Column) -> Column:
    return (blocked + SMOOTHING * above) / (labelled + SMOOTHING)


def _branches(level: DataFrame) -> DataFrame:
    """From (host, node, purity, first, second, n, labelled, blocked), the next two segments of all shapes that are not
    settled: the step (segment, wildcard or merged branch) for each first, and the purity below it."""
    node, child = ["host", "node"], ["host", "node", "first"]
    counts = (F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    children = level.groupBy(*child).agg(*counts, F.first("purity").alias("purity"))
    nodes = children.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    below = level.groupBy(*child, "second").agg(F.sum("n").alias("n_here"))
    pooled = below.groupBy(*node, "second").agg(F.sum("n_here").alias("n_pooled"))
    shares = below.join(pooled, [*node, "second"]).join(children.select(*child, "n"), child).join(nodes.select(*node, "all"), node)
    whole = lambda c: F.col(c).cast("double")
    common = shares.groupBy(*child).agg(F.sum(F.least(whole("n_here") * whole("all"), whole("n_pooled") * whole("n"))).alias("common"))
    judged = children.join(nodes, node).join(common, child)
    n, every, lab, blk, all_lab, all_blk = map(whole, ("n", "all", "labelled", "blocked", "all_labelled", "all_blocked"))
    apart = every * n - F.col("common")  # the total variation distance, times all URLs of the node and of the child
    near = (4 * apart <= every * n) | ((2 * apart <= every * n) & (apart * apart <= every * every * n))
    rates = blk * all_lab - all_blk * lab
    alike = near & ((lab == 0) | (rates * rates <= 4 * lab * all_blk * (all_lab - all_blk)))
    wild = (F.col("children") > CHILDREN) & (F.col("children") * SUPPORT > F.col("all"))
    judged = judged.withColumn("step", F.when(wild, "*").when(alike, MERGED).otherwise(F.concat(F.lit("/"), "first")))
    steps = judged.groupBy(*node, "step").agg(*counts, F.first("purity").alias("above"), F.first("all").alias("all"))
    passed = F.when(F.col("n") == F.col("all"), F.col("above")).otherwise(purity(F.col("labelled"), F.col("blocked"), F.col("above")))
    return judged.select(*child, "step").join(steps.select(*node, "step", passed.alias("purity")), [*node, "step"])


def template_purity(urls: DataFrame) -> DataFrame:
    """From host, shape and blocks (true, false or null for no label): (host, shape, purity of its template), a row for each host and shape."""
    shapes = urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("blocks").alias("labelled"), F.count_if("blocks").alias("blocked"))
    shapes = cut_lineage(shapes, "url-shapes")
    hosts = shapes.groupBy("host").agg(purity(F.sum("labelled"), F.sum("blocked"), F.lit(0.5)).alias("purity"))
    parts = F.split("shape", "/")
    growing = shapes.join(hosts, "host").withColumns({"node": F.lit(""), "left": F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))})
    done: list[DataFrame] = []
    while True:
        ends = growing.groupBy("host", "node").agg(F.min("left").alias("low"), F.max("left").alias("high"))
        same = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1
        ends = ends.select("host", "node", (F.col("low") == F.col("high")).alias("settled"), F.when(same < 0, F.least(F.size("low"), F.size("high"))).otherwise(same).cast("int").alias("skip"))
        growing = cut_lineage(parted_join(growing, ends, ["host", "node"]).withColumn("left", F.slice("left", F.col("skip") + 1, F.size("left"))).drop("skip"), "url-levels")
        done.append(growing.where("settled").select("host", "shape", "purity"))
        growing = growing.where("NOT settled").drop("settled")
        if growing.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at = lambda k: F.coalesce(F.try_element_at("left", F.lit(k)), F.lit(END))
        growing = growing.withColumns({"first": at(1), "second": at(2)})
        steps = cut_lineage(_branches(growing), "url-branches")
        growing = parted_join(growing.drop("purity"), steps, ["host", "node", "first"])
        growing = growing.withColumns({"node": F.sha2(F.concat_ws(" ", "node", F.col("step")), 256), "left": F.slice("left", 2, F.size("left"))}).drop("first", "second", "step")


def filter_urls(df: DataFrame, url_col: str = "url", rules=RULES, label_col: str | None = None) -> DataFrame:
    """All columns of df (those named like a result, in any letter case, are replaced), then host, path, rule (its text, or
    null) and verdict (allow or block).

    label_col: a boolean column, true where the URL is known to be bad; without one, the rules' verdicts are the labels.
    """
    kept = without(df.columns, RESULT)
    own = [f"k{i}" for i in range(len(kept))]
    ordered = _ordered(rules)
    host, path = host_and_path(col(url_col))
    label = col(label_col) if label_col else F.lit(None).cast("boolean")
    urls = df.select(*(col(c).alias(k) for c, k in zip(kept, own, strict=True)), host.alias("host"), path.alias("path"), label.alias("__label"))
    urls = urls.withColumn("__rule", rule_index(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    by_rule = _pick(F.col("__rule"), [v for v, _, _ in ordered])
    labels = F.col("__label") if label_col else (by_rule == "block")
    judged = template_purity(urls.select("host", "shape", labels.alias("blocks")))
    rejected = cut_lineage(judged.where(10 * F.col("purity") >= PURITY).select("host", "shape", F.lit(True).alias("__rejected")), "url-rejected")
    joined = _with_rejected(urls, rejected)
    verdict = F.coalesce(by_rule, F.when(F.col("__rejected"), "block").otherwise("allow"))
    return joined.select(*own, "host", "path", _pick(F.col("__rule"), [h + p for _, h, p in ordered]).alias("rule"), verdict.alias("verdict")).toDF(*kept, *RESULT)


#: Rejected templates' shapes that are sent to every executor at most (a few hundred bytes each).
SENT = 200_000


def _with_rejected(urls: DataFrame, rejected: DataFrame) -> DataFrame:
    """urls with __rejected, true for those of a rejected shape: by a broadcast where such shapes are few; otherwise by a
    join in which a shape that many URLs have is parted."""
    on = ["host", "shape"]
    if rejected.limit(SENT + 1).count() <= SENT:
        return urls.join(F.broadcast(rejected), on, "left")
    return parted_join(urls, rejected, on, "left")


#: Segments of the paths in the driver's pages, which the registered SQL reaches; longer paths are tested by brute force.
ORACLE_LEVELS = 4


def _oracle() -> str:
    ordered = _ordered(RULES)
    case = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {i}" for i, (_, h, p) in enumerate(ordered)) + " END"
    pick = lambda values: "CASE r " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    steps = ["h0 AS (SELECT host, (sum(b) + 2 * 0.5::DOUBLE) / (sum(l) + 2) AS purity FROM q GROUP BY host)", "g0 AS (SELECT host, shape, '' AS node, string_split(shape, '/')[2:] AS s, n, l, b, purity FROM q JOIN h0 USING (host))"]
    for k in range(ORACLE_LEVELS):
        steps.append(f"""
f{k} AS (SELECT *, coalesce(s[{k + 1}], '{END}') AS f, coalesce(s[{k + 2}], '{END}') AS g FROM g{k}),
c{k} AS (SELECT host, node, f, sum(n)::DOUBLE AS cn, sum(l)::DOUBLE AS cl, sum(b)::DOUBLE AS cb, any_value(purity) AS above FROM f{k} GROUP BY ALL),
d{k} AS (SELECT host, node, count(*) AS kids, sum(cn) AS an, sum(cl) AS al, sum(cb) AS ab FROM c{k} GROUP BY ALL),
e{k} AS (SELECT host, node, f, g, sum(n)::DOUBLE AS here FROM f{k} GROUP BY ALL),
p{k} AS (SELECT host, node, g, sum(here) AS pooled FROM e{k} GROUP BY ALL),
o{k} AS (SELECT host, node, f, sum(least(here * an, pooled * cn)) AS common FROM e{k} JOIN p{k} USING (host, node, g) JOIN c{k} USING (host, node, f) JOIN d{k} USING (host, node) GROUP BY ALL),
j{k} AS (SELECT *, an * cn - common AS apart, cb * al - ab * cl AS rates FROM c{k} JOIN d{k} USING (host, node) JOIN o{k} USING (host, node, f)),
t{k} AS (SELECT host, node, f, cn, cl, cb, an, above, CASE WHEN kids > {CHILDREN} AND kids * {SUPPORT} > an THEN '*'
  WHEN (4 * apart <= an * cn OR (2 * apart <= an * cn AND apart * apart <= an * an * cn)) AND (cl = 0 OR rates * rates <= 4 * cl * ab * (al - ab)) THEN '{MERGED}' ELSE '/' || f END AS step FROM j{k}),
u{k} AS (SELECT host, node, step, CASE WHEN sum(cn) = any_value(an) THEN any_value(above) ELSE (sum(cb) + {SMOOTHING} * any_value(above)) / (sum(cl) + {SMOOTHING}) END AS purity FROM t{k} GROUP BY ALL),
g{k + 1} AS (SELECT host, shape, f{k}.node || ' ' || step AS node, s, n, l, b, u{k}.purity FROM f{k} JOIN t{k} USING (host, node, f) JOIN u{k} USING (host, node, step))""")
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
h AS (SELECT page_id, translate(regexp_extract(x, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
u AS (SELECT *, {case} AS r, regexp_replace(path, '[0-9]+', '*', 'g') AS shape FROM h),
q AS (SELECT host, shape, count(*) AS n, count(r) AS l, count_if(r IS NOT NULL AND {pick([v for v, _, _ in ordered])} = 'block') AS b FROM u GROUP BY ALL),
{", ".join(steps)}
SELECT page_id, u.host, path, {pick([h + p for _, h, p in ordered])} AS rule,
  coalesce({pick([v for v, _, _ in ordered])}, CASE WHEN 10 * purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN g{ORACLE_LEVELS} z USING (host, shape)
"""


ORACLE = _oracle()
