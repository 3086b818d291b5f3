"""URL filters: a path-template tree for each host, in DataFrame operations only.

1. Rules. A rule `host/path` fits its host and all subdomains, if the path of the url starts with its own; of the
   rules that fit, the longest decides (of equally long ones, the first in string order). A page with a rule is
   a labelled page.
2. Templates. In each segment of a path a run of digits becomes {n}, and a hexadecimal word of eight letters or
   more, with a digit, becomes {x}. Then each host's tree is merged from the top down. In a node, a level with more than
   `max_children` different children of under `min_support` pages each on average is variable: its rare children
   become `*`. Labelled siblings whose shares of blocked pages do not differ from the node's by more than `z` standard
   errors become `*`, too. What becomes `*` is one branch from there on, so that the next level is counted over all
   of it: a variable segment below a variable one is found. This goes on until no node has two different branches below it;
   levels on which none has are passed over at once.
3. Purity. A template is rejected when (blocked + strength * prior) / (labelled + strength) reaches `reject`.
   A template without labelled pages keeps the prior and is allowed.

A host's different shapes are counted before anything is shuffled by node, and a node's totals are summed from partial
sums, so a host of any number of pages or branches is no single task's.

A null url, or one without ://, has an empty host and an empty path. Repeated page_ids are judged row by row; an
empty table gives no rows. Columns other than page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, only_columns, written


def url_parts(c):
    """(host, path) of a url column."""
    host = F.coalesce(ascii_lower(F.regexp_extract(c, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(c, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules: dict[str, str]):
    """The rule that decides, or null. rules: host/path -> allow or block; a short list, one comparison each."""
    out = F.lit(None).cast("string")
    for rule in sorted(sorted(rules, reverse=True), key=len):  # the longest is asked first, so it comes last here
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _merged(shapes: DataFrame, max_children: int, min_support: float, z: float) -> DataFrame:
    """host, shape, n, labelled, blocked, template: the tree merged level by level. A node is known by a digest of the merged names down to it."""
    names = F.array().cast("array<string>")
    state = shapes.withColumns({"segments": F.split("shape", "/"), "node": F.xxhash64("host"), "names": names})
    before, k = None, 0
    while (skip := _shared_levels(state, k)) is not None:
        if skip:  # all have one name down there
            names = F.slice("segments", F.lit(k + 1), F.lit(skip))
            state = state.withColumns({"node": F.when(F.size("segments") > k, F.xxhash64("node", F.array_join(names, "/"))).otherwise(F.col("node")), "names": F.concat("names", names)})
            k += skip
        child = F.get("segments", F.lit(k))
        children = state.filter(child.isNotNull()).groupBy("node", child.alias("child")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        children = written(children, "url-children")
        all_ = children.groupBy("node").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")]).filter("kinds > 1")
        share = F.when(F.col("all_labelled") > 0, F.col("all_blocked") / F.col("all_labelled"))
        own = F.when(F.col("labelled") > 0, F.col("labelled"))
        similar = F.abs(F.col("blocked") / own - share) <= z * F.sqrt(share * (1 - share) / own)
        variable = (F.col("kinds") > max_children) & (F.col("all_n") < min_support * F.col("kinds")) & (F.col("n") < min_support)
        wild = children.filter("child <> ''").join(all_, "node").filter(variable | F.coalesce(similar, F.lit(False))).select("node", "child", F.lit("*").alias("merged"))
        met = state.withColumn("child", child).join(wild, ["node", "child"], "left")
        name = F.coalesce("merged", "child")
        there = F.col("child").isNotNull()
        state = written(
            met.select(
                "host", "shape", "n", "labelled", "blocked", "segments",
                F.when(there, F.xxhash64("node", name)).otherwise(F.col("node")).alias("node"),
                F.when(there, F.concat("names", F.array(name))).otherwise(F.col("names")).alias("names"),
            ),
            "url-tree",
        )
        discard(children, *[before] * (before is not None))
        before, k = state, k + 1
    rest = F.slice("segments", F.lit(k + 1), F.greatest(F.size("segments") - k, F.lit(0)))
    return state.select("host", "shape", "n", "labelled", "blocked", F.array_join(F.concat("names", rest), "/").alias("template"))


def _shared_levels(state: DataFrame, k: int) -> int | None:
    """How many levels from k on no node has two children on; None if no node has two different branches below."""
    rest = F.slice("segments", F.lit(k + 1), F.size("segments") - k)
    ends = state.filter(F.size("segments") > k).groupBy("node").agg(F.min(rest).alias("low"), F.max(rest).alias("high")).filter(F.col("low") != F.col("high"))
    # what the least and the greatest branch share, all share
    shared = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False)) - 1
    return ends.agg(F.min(shared)).first()[0]


def judge(pages: DataFrame, rules: dict[str, str], *, max_children: int = 20, min_support: float = 5.0, z: float = 2.0, prior: float = 0.25, strength: float = 4.0, reject: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page."""
    rows = only_columns(pages, "page_id", "url")
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    generalised = F.transform(
        F.split(F.col("path"), "/"),
        lambda s: F.when(s.rlike("^(?=[0-9a-f]*[0-9])[0-9a-f]{8,}$") & ~s.rlike("^[0-9]+$"), "{x}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}")),
    )
    rows = rows.withColumn("shape", F.array_join(generalised, "/"))

    # every host's different shapes, with their pages; counted before the shuffle, so a hot host is a few rows
    shapes = written(
        rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("rule").alias("labelled"), F.count_if(blocked).alias("blocked")),
        "url-shapes",
    )
    templates = _merged(shapes, max_children, min_support, z)
    purity = templates.groupBy("host", "template").agg(((F.sum("blocked") + strength * prior) / (F.sum("labelled") + strength)).alias("purity"))
    judged = written(templates.select("host", "shape", "template").join(purity, ["host", "template"]), "url-templates")
    discard(shapes)

    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
