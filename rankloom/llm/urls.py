"""URL filters: written rules first, then a path-template tree for each host.

Paths become templates: digits, long hexadecimal strings and dates are generalised by their shape, and the
segments that vary below a node become a wildcard. Which do is told by the node's own distribution: the
children with at most t pages each are variable if they are more than OPEN times the square root of their
pages, for then they grow with the pages (names, slugs), where the sections of a site stay as they are. The
largest such t is taken, so frequent sections stand apart beside a tail of names. The tree is walked from fork
to fork: what all paths of a node share is passed at once, so a path of any depth costs no round of its own,
and rounds are as many as forks stand below one another.

Templates of a host that differ in the segment of one fork only are similar branches if both hold labelled
pages, lie on the same side (mostly blocked or not), and the share of blocked ones does not differ
significantly from that of the others of that side; they are merged at the fork that pools most labels.

Labels are the written rules' own verdicts. From the host down, a node's purity is its share of blocked pages, in
which its unlabelled pages and SMOOTHING more count with the purity of the node above (those of a host as not
blocked), so branches without labels back off to their parent and few labels among many pages weigh little. A
template is rejected if its purity is high enough and its host has LEAST_LABELLED labelled pages.

Only counts by (host, template) are joined, never the pages of a host with one another, so a host may hold
any share of the rows. Defined cases: a null url, or one without "://", has an empty host and path, fits no
rule and is allowed; a null page_id stays null; an empty table gives no rows; repeated rows each get their
verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The rules of the query: (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Distinct children over the square root of their pages, above which they are variable.
OPEN = 2.0
LEAST_LABELLED, SMOOTHING, LIMIT, SIGNIFICANT = 5, 4.0, 0.8, 1.96
COUNTS = ("n", "labelled", "blocked")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the table of verdicts up to which it is broadcast (about 100 bytes a row).
BROADCAST_ROWS = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), CAPITALS, SMALL), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]], pick) -> Column:
    """What `pick` gives of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, pick(verdict, rule)).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A segment with dates, long hexadecimal strings and runs of digits generalised."""
    s = F.regexp_replace(segment, r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "<d>")
    s = F.regexp_replace(s, r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]{4,}){0,4}(?![0-9a-z])", "<x>")
    return F.regexp_replace(s, r"[0-9]+", "<n>")


def _share(labelled: Column, blocked: Column, n: Column, parent: Column) -> Column:
    """Share of blocked pages, in which unlabelled ones and SMOOTHING more count with the parent's share."""
    return (blocked + (SMOOTHING + n - labelled) * parent) / (n + SMOOTHING)


def _sums(prefix: str = "") -> list[Column]:
    return [F.sum(c).alias(prefix + c) for c in COUNTS]


def _variable(rows: DataFrame) -> DataFrame:
    """(host, template, part): the variable children of the nodes of rows (host, template, part, n)."""
    children = rows.groupBy("host", "template", "part").agg(F.sum("n").alias("k"))
    # A node has at most about sqrt(2 * pages) distinct counts, so its window is short.
    upto = Window.partitionBy("host", "template").orderBy("k")
    tail = children.groupBy("host", "template", "k").agg(F.count(F.lit(1)).alias("m"))
    tail = tail.withColumns({"distinct": F.sum("m").over(upto), "pages": F.sum(F.col("k") * F.col("m")).over(upto)})
    most = tail.where(F.col("distinct") > OPEN * F.sqrt("pages")).groupBy("host", "template").agg(F.max("k").alias("most"))
    return children.join(common.small_enough(most), ["host", "template"]).where(F.col("k") <= F.col("most")).select("host", "template", "part")


def templates(pages: DataFrame) -> DataFrame:
    """(host, raw, n, labelled, blocked, template, forks, p, known): the distinct shaped paths of each host with their templates.

    forks are the numbers of the template's segments at which nodes fork, p is the purity of its last node.
    """
    counted = pages.groupBy("host", "raw").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    base = pages.agg(F.sum("label") / F.greatest(F.count("label"), F.lit(1))).first()[0] or 0.0
    # A raw path is empty or starts with a slash, so its first part is always empty.
    rest = F.slice(F.split("raw", "/"), F.lit(2), F.size(F.split("raw", "/")))
    fresh = {"rest": rest, "template": F.lit(""), "place": F.lit(0), "forks": F.array().cast("array<int>"), "p": F.lit(None).cast("double"), "known": F.lit(None).cast("boolean")}
    open_rows, settled = common.written(counted.withColumns(fresh), "tree"), []
    while True:
        nodes = open_rows.groupBy("host", "template").agg(*_sums("node_"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        # What the first and the last path of a node share, all of them share.
        unlike = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        nodes = nodes.withColumn("shared", F.when(unlike > 0, unlike - 1).otherwise(F.size("low")).cast("int")).drop("low", "high")
        rows = open_rows.join(common.small_enough(nodes), ["host", "template"])
        p = F.when(F.col("p").isNull(), (F.col("node_blocked") + SMOOTHING * F.lit(float(base))) / (F.col("node_n") + SMOOTHING))
        p = p.otherwise(_share(F.col("node_labelled"), F.col("node_blocked"), F.col("node_n"), F.col("p")))
        passed = F.slice("rest", F.lit(1), F.col("shared"))
        rows = rows.withColumns({
            "p": p, "known": F.coalesce("known", F.col("node_labelled") >= LEAST_LABELLED), "part": F.get("rest", F.col("shared")), "place": F.col("place") + F.col("shared"),
            "template": F.concat("template", F.array_join(F.transform(passed, lambda x: F.concat(F.lit("/"), x)), "")),
            "rest": F.slice("rest", F.col("shared") + 2, F.size("rest")),
        }).drop("shared", *[f"node_{c}" for c in COUNTS])
        rows = common.written(rows, "nodes")
        settled.append(rows.where("part is null"))
        on = rows.where("part is not null")
        if on.isEmpty():
            break
        variable = _variable(on).select(*[F.col(c).alias(f"_{c}") for c in ("host", "template", "part")])
        on = on.join(common.small_enough(variable), [F.col(c) == F.col(f"_{c}") for c in ("host", "template", "part")], "left")
        own = F.when(F.col("_part").isNotNull(), "*").otherwise(F.col("part"))
        on = on.withColumns({"template": F.concat("template", F.lit("/"), own), "forks": F.concat("forks", F.array("place")), "place": F.col("place") + 1})
        open_rows = common.written(on.select(open_rows.columns), "tree")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.drop("rest", "part", "place")


def verdicts(tree: DataFrame) -> DataFrame:
    """(host, template, branch, labelled, blocked, purity, rejected): the templates after merging similar branches."""
    # Paths of one template have passed the same nodes.
    rows = tree.groupBy("host", "template").agg(*_sums(), F.first("forks").alias("forks"), F.first("p").alias("p"), F.first("known").alias("known"))
    rows = common.written(rows, "templates")
    parts = F.split("template", "/")
    form = [
        F.array_join(F.slice(parts, F.lit(1), F.col("fork") + 1), "/").alias("above"),
        F.array_join(F.slice(parts, F.col("fork") + 3, F.size(parts)), "/").alias("below"),
        (F.size(parts) - 2 - F.col("fork")).alias("depth"),
        (2 * F.col("blocked") >= F.col("labelled")).alias("side"),
    ]
    alike = ["host", "above", "below", "depth", "side"]
    tried = rows.where(F.col("labelled") >= LEAST_LABELLED).withColumn("fork", F.explode("forks")).select("host", "template", "fork", "labelled", "blocked", *form)
    pooled = tried.groupBy(*alike).agg(F.sum("labelled").alias("all"), F.sum("blocked").alias("all_blocked"), F.count(F.lit(1)).alias("members")).where("members > 1")
    tried = tried.join(common.small_enough(pooled), alike).withColumns({"others": F.col("all") - F.col("labelled"), "others_blocked": F.col("all_blocked") - F.col("blocked")})
    share = F.col("all_blocked") / F.col("all")
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / F.col("labelled") + 1 / F.col("others")))
    distance = F.abs(F.col("blocked") / F.col("labelled") - F.col("others_blocked") / F.col("others")) / spread
    branch = F.concat("above", F.when(F.col("side"), "/<blocked>").otherwise("/<allowed>"), F.when(F.col("depth") > 0, F.concat(F.lit("/"), F.col("below"))).otherwise(""))
    chosen = tried.where(distance < SIGNIFICANT).groupBy("host", "template").agg(F.max_by(branch, F.struct("all", -F.col("fork"))).alias("merged"))
    chosen = chosen.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "merged")
    cut = rows.join(common.small_enough(chosen), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    cut = cut.withColumn("branch", F.coalesce("merged", "template")).drop("_h", "_t", "merged", "forks")
    whole = cut.groupBy("host", "branch").agg(*_sums())
    cut = cut.drop(*COUNTS).join(common.small_enough(whole), ["host", "branch"])
    purity = _share(F.col("labelled"), F.col("blocked"), F.col("n"), F.col("p"))
    return cut.select("host", "template", "branch", "labelled", "blocked", purity.alias("purity"), (F.col("known") & (purity >= LIMIT)).alias("rejected"))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = rule_of(F.col("host"), F.col("path"), rules, lambda _, r: F.lit(r))
    said = rule_of(F.col("host"), F.col("path"), rules, lambda v, _: F.lit(v))
    rows = rows.withColumns({"rule": rule, "said": said}).withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    rows = rows.withColumn("raw", F.array_join(F.transform(F.split("path", "/"), shape), "/"))
    rows = common.written(rows, "urls")
    tree = templates(rows)
    found = common.written(tree.select("host", "raw", "template").join(verdicts(tree), ["host", "template"]), "verdicts")
    found = found.select(F.col("host").alias("_h"), F.col("raw").alias("_r"), "template", "purity", "rejected")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    out = rows.join(found, (F.col("host") == F.col("_h")) & (F.col("raw") == F.col("_r")), "left")
    verdict = F.coalesce("said", F.when(F.col("rejected") & (F.col("host") != ""), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' urls judged."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
