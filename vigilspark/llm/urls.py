"""URL filters: a path-template tree per host, in DataFrame functions only.

Segments that look variable (numbers, hex, dates, long mixed tokens) become wildcards,
as does every segment of a node whose children are mostly distinct. Sibling branches
whose labelled share agrees with their parent's (two-proportion test) are merged. A
node's purity is its labelled share smoothed towards its parent's, so branches without
labels inherit it; the root of a host is smoothed towards PRIOR. A template of too low purity is rejected. Rules (host and path prefix; the
longest that fits wins) label urls and overrule templates; a column of better labels can
be given.

The tree grows level by level, each a written table; a branch that holds one shape only
is final and leaves the loop, so its rounds are the depth at which shapes still differ.

Defined results: a null url or one without :// has empty host and path and fits no rule;
it falls under the template of the empty host. Null page_ids and repeated rows are judged
each; other columns are ignored; an empty table gives no rows. Templates of equal purity
have equal verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, table, written

#: (rule, verdict); a rule is host and path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A node whose children number at least CHILDREN and more than DISTINCT of its urls is variable.
CHILDREN, DISTINCT = 16, 0.5
#: Standard errors within which a branch counts as similar to its parent.
SIMILAR = 1.96
#: Smoothing: PRIOR is the purity of a host without labels, STRENGTH the weight of the purity above in labels.
PRIOR, STRENGTH, PURITY = 0.7, 4.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # a longer one is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape_of(segment: Column) -> Column:
    """A segment with its variable part as a wildcard; the extension stays."""
    parts = r"(?s)\A(.*?)(\.[A-Za-z]{1,5})?\z"
    stem, ext = F.regexp_extract(segment, parts, 1), F.regexp_extract(segment, parts, 2)
    kind = (
        F.when(stem.rlike(r"\A[0-9]+\z"), "{n}")
        .when(stem.rlike(r"\A[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z"), "{date}")
        .when(stem.rlike(r"\A[0-9A-Fa-f-]{8,}\z") & stem.rlike("[0-9]"), "{hex}")
        .when((F.length(stem) >= 16) & stem.rlike("[0-9]"), "{id}")
        .otherwise(stem)
    )
    return F.concat(kind, ext)


def filter_urls(pages: DataFrame, rules=RULES, labels: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, n_labelled, by_template (no rule judged it) of every row of pages (page_id, url).

    labels: boolean over the columns host, path, rule_verdict (good, bad or null); the rules' verdicts by default.
    """
    host, path = F.col("host"), F.col("path")
    rule, verdict = rule_of(host, path, rules)
    base = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumns({"rule": rule, "rule_verdict": verdict})
    base = base.withColumn("shapes", F.transform(F.split(F.regexp_replace(path, r"\A/", ""), "/"), shape_of))
    good = labels if labels is not None else F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict") == "allow")
    # a row per shape, not per url
    shapes = base.groupBy("host", "shapes").agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("good"), F.count(F.when(~good, 1)).alias("bad"))
    roots = shapes.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select("host", smoothed("g", "b", F.lit(PRIOR)).alias("above"))
    open_ = written(shapes.join(roots, "host").select("*", F.lit("").alias("prefix")), "templates")
    final, level = [], 0
    while True:
        node = ["host", "prefix"]
        s, last = F.get("shapes", F.lit(level)), F.size("shapes") == level + 1
        at = open_.withColumn("s", F.coalesce(s, F.lit("")))
        child = at.groupBy(*node, "s").agg(F.sum("n").alias("cn"), F.sum("good").alias("cg"), F.sum("bad").alias("cb"))
        sums = child.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("cn").alias("pn"), F.sum("cg").alias("pg"), F.sum("cb").alias("pb"))
        all_, labelled = F.col("pg") + F.col("pb"), F.col("cg") + F.col("cb")
        share = F.col("pg") / all_
        spread = SIMILAR * F.sqrt(share * (1 - share) / labelled + 1 / all_ / 4)
        alike = (F.col("kids") > 1) & (labelled > 0) & (F.abs(F.col("cg") / labelled - share) <= spread)
        variable = (F.col("kids") >= CHILDREN) & (F.col("kids") > DISTINCT * F.col("pn"))
        name = F.when(F.col("s") == "", "").when(variable, "{*}").when(alike, "{~}").otherwise(F.col("s"))
        named = child.join(sums, node).select(*node, "s", F.concat("prefix", F.lit("/"), name).alias("deeper"))
        moved = at.join(named, [*node, "s"]).withColumn("prefix", F.col("deeper")).drop("deeper", "s")
        # shapes that ended here have a node of their own, apart from those that go on
        merged = moved.groupBy(*node, last.alias("last")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count("*").alias("held"))
        moved = moved.withColumn("last", last).join(merged, [*node, "last"])
        moved = written(moved.withColumn("above", smoothed("g", "b", F.col("above"))), "templates")
        drop_written(open_)
        rest = F.array_join(F.slice("shapes", level + 2, F.greatest(F.size("shapes") - level - 1, F.lit(0))), "/")
        template = F.concat("host", "prefix", F.when(F.col("last"), "").otherwise(F.concat(F.lit("/"), rest)))
        done = moved.where("last or held = 1")
        final.append(done.select("host", "shapes", F.regexp_replace(template, r"/+\z", "/").alias("template"), F.col("above").alias("purity"), (F.col("g") + F.col("b")).alias("n_labelled")))
        open_ = moved.where("not last and held > 1").select("host", "shapes", "n", "good", "bad", "above", "prefix")
        if open_.isEmpty():
            break
        open_, level = written(open_, "templates"), level + 1
    judged = reduce(DataFrame.unionByName, final)
    return base.join(judged, ["host", "shapes"]).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("purity") < PURITY, "block").otherwise("allow")).alias("verdict"), "template", "purity", "n_labelled", F.col("rule_verdict").isNull().alias("by_template")
    )


def smoothed(good: str, bad: str, towards: Column) -> Column:
    """Labelled share of good, with STRENGTH labels of the share `towards` added."""
    return (F.col(good) + STRENGTH * towards) / (F.col(good) + F.col(bad) + STRENGTH)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
