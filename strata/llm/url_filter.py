"""URL filtering by host rules, then by a path-template tree with smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.staging import Stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to '?', '#' or the end; '' without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path prefix) that fits, as text and as its verdict; else null.

    A rule fits its host and all subdomains where the path starts with the
    rule's. Of equally long ones the one with the longer host wins, then block.
    The list becomes one CASE expression.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1], r[2]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def segments_of(path: Column) -> Column:
    """The path's segments; empty ones are left out."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def generalise(stage: Stage, paths: DataFrame, many: int, each: int, wide: int) -> DataFrame:
    """paths (host, segments, counts) with ``labels``: its nodes in the tree, an end ('') last.

    The tree grows level by level for all hosts at once. A child is rare if it has
    under ``each`` pages, or under a ``wide``-th of its parent's. Where a parent has ``many`` rare children or more
    their segment is variable: they become one child '*'. So no parent has more than ``wide + many`` children. A path that shares its node with no
    other ends there, and what is left of it is one label. Segments that all paths of a child have in common are passed in its round, so
    rounds go on while paths part, however long they are.
    """
    active, done, level = paths.withColumn("labels", F.array().cast("array<string>")).withColumn("at", F.lit(0)), [], 0
    end = F.array(F.lit(""))
    while True:
        over = F.size("segments") <= F.col("at")
        done.append(active.where(over).drop("at").withColumn("labels", F.concat("labels", end)))
        active = active.where(~over)
        if active.isEmpty():
            break
        segment = F.get("segments", F.col("at"))
        counts = [F.sum("n").alias("pages"), F.count(F.lit(1)).alias("paths"), F.min("left").alias("low"), F.max("left").alias("high")]
        left = active.withColumn("left", F.slice("segments", F.col("at") + 1, F.size("segments")))
        children = stage.put(left.groupBy("host", "labels", segment.alias("segment")).agg(*counts), f"children{level}")
        parents = children.groupBy("host", "labels").agg(F.greatest(F.lit(each), F.sum("pages") / wide).alias("bar"))
        rare = children.join(parents, ["host", "labels"]).groupBy("host", "labels", "bar").agg(F.count(F.when(F.col("pages") < F.col("bar"), 1)).alias("rare"))
        bars = rare.where(F.col("rare") >= many).select("host", "labels", "bar")
        # What the least and the greatest of the rests have in common all of them have.
        parting = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
        shared = F.when(parting > 0, parting - 1).otherwise(F.size("low"))
        named = children.join(bars, ["host", "labels"], "left").select("host", "labels", "segment", F.coalesce(F.col("pages") < F.col("bar"), F.lit(False)).alias("variable"), "paths", shared.alias("shared"))
        grown = active.withColumn("segment", segment).join(named, ["host", "labels", "segment"])
        alone = ~F.col("variable") & (F.col("paths") == 1)
        step = F.when(F.col("variable"), F.lit(1)).otherwise(F.col("shared"))
        rest = F.array_join(F.slice("segments", F.col("at") + 1, F.size("segments")), "/")
        label = F.when(F.col("variable"), F.array(F.lit("*"))).when(alone, F.array(rest)).otherwise(F.slice("segments", F.col("at") + 1, step))
        columns = [c for c in active.columns if c not in ("labels", "at")]
        grown = stage.put(grown.select(*columns, F.concat("labels", label).alias("labels"), (F.col("at") + step).alias("at"), alone.alias("alone")), f"grown{level}")
        done.append(grown.where("alone").select(*columns, F.concat("labels", end).alias("labels")))
        active, level = grown.where("not alone").drop("alone"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def merge_similar(stage: Stage, tree: DataFrame, z: float, main: float = 0.05) -> DataFrame:
    """tree (host, labels, n, blocked, allowed) with ``merged``: labels, in which similar branches have one name.

    From the deepest level up, levels without siblings left out. Sibling branches have the same form if their main
    children (``main`` of a branch's pages or more) have the same names. Each is held
    against all siblings of its form together: chi-square of its pages by child within ``z`` standard deviations of what chance
    gives, and its labelled block rate within ``z`` standard errors of theirs (a branch without labels has no rate that could differ). Those
    alike, if two or more, are merged, children of one name with them; the others stay. A merged leaf is '*', any other '*' and a digest of its form.
    """
    # Levels at which some branch has a sibling, the last one aside: one number each.
    steps = tree.select("host", F.posexplode("labels").alias("k", "label"), "labels").select("host", F.col("k").alias("at"), F.xxhash64(F.slice("labels", F.lit(1), F.col("k"))).alias("above"), "label")
    parted = steps.groupBy("host", "at", "above").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    levels = sorted((r.at + 1 for r in parted.select("at").distinct().collect()), reverse=True)
    depth = tree.agg(F.max(F.size("labels"))).first()[0] or 0
    tree = tree.withColumn("merged", F.col("labels"))
    for at in [k for k in levels if k < depth]:
        parent, label, child = F.slice("merged", 1, at - 1).alias("parent"), F.get("merged", F.lit(at - 1)).alias("label"), F.get("merged", F.lit(at)).alias("child")
        counted = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
        kids = tree.where(F.size("merged") > at).groupBy("host", parent, label, child).agg(*counted)
        # A parent has a bounded number of children, so this list is one too.
        nodes = kids.groupBy("host", "parent", "label").agg(*counted, F.collect_list(F.struct("child", F.col("n").alias("own"))).alias("kids"))
        chief = F.array_sort(F.transform(F.filter("kids", lambda k: k["own"] >= main * F.col("n")), lambda k: k["child"]))
        depth_of_label = F.length("label") - F.length(F.replace(F.col("label"), F.lit("/"), F.lit("")))
        nodes = stage.put(nodes.withColumn("form", F.to_json(F.struct(chief.alias("c"), depth_of_label.alias("d")))), f"nodes{at}")
        key = ["host", "parent", "form"]
        pools = nodes.groupBy(*key).agg(F.sum("n").alias("pn"), F.sum("blocked").alias("pb"), F.sum("allowed").alias("pa"), F.count(F.lit(1)).alias("members")).where("members > 1")
        spread = nodes.select(*key, "label", "n", F.explode("kids").alias("k")).select(*key, "label", "n", "k.child", "k.own")
        shares = spread.groupBy(*key, "child").agg(F.sum("own").alias("pc"))
        kinds = shares.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("free"))
        chance = spread.join(shares, [*key, "child"]).join(pools.select(*key, "pn"), key)
        chance = chance.groupBy(*key, "label").agg((F.sum(F.col("own") * F.col("own") * F.col("pn") / (F.col("n") * F.col("pc"))) - F.max("n")).alias("x2"))
        held = nodes.join(pools, key).join(chance, [*key, "label"]).join(kinds, key)
        labelled = F.col("blocked") + F.col("allowed")
        rate = (F.col("pb") + 1) / (F.col("pb") + F.col("pa") + 2)
        near = (labelled == 0) | (F.abs(F.col("blocked") / F.greatest(labelled, F.lit(1)) - rate) <= z * F.sqrt(rate * (1 - rate) / F.greatest(labelled, F.lit(1))))
        alike = held.where(near & (F.col("x2") <= F.col("free") + z * F.sqrt(2 * F.col("free")) + 1e-9)).select(*key, "label", F.size("kids").alias("width"), F.col("kids")[0]["child"].alias("only"))
        # Siblings are bounded in number, so a window over them is too.
        several = alike.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("alike > 1")
        leaf = (F.col("width") == 1) & (F.col("only") == "")
        names = several.select("host", "parent", "label", F.when(leaf, "*").otherwise(F.concat(F.lit("*"), F.substring(F.sha2("form", 256), 1, 8))).alias("name"))
        renamed = tree.withColumn("parent", parent).withColumn("label", label).join(names, ["host", "parent", "label"], "left")
        new = F.when(F.col("name").isNull(), F.col("merged")).otherwise(F.transform("merged", lambda x, i: F.when(i == at - 1, F.col("name")).otherwise(x)))
        tree = stage.put(renamed.withColumn("merged", new).drop("parent", "label", "name"), f"merged{at}")
    return tree


def judge_templates(tree: DataFrame, weight: float, reject: float) -> DataFrame:
    """(host, labels, template, purity, found) of merged branches.

    The purity of a node is (blocked + weight * q) / (blocked + allowed + weight), q being
    its parent's and, above a host, the share of blocked among all labelled pages: a node without labelled pages has its
    nearest labelled ancestor's. A template is rejected if its purity is at least ``reject``.
    """
    base = tree.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum(F.col("blocked") + F.col("allowed")), F.lit(0)) + 2))).first()[0]
    merged = tree.groupBy("host", "merged").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    steps = merged.select("host", "merged", "blocked", "allowed", F.explode(F.sequence(F.lit(0), F.size("merged"))).alias("at")).withColumn("node", F.slice("merged", F.lit(1), F.col("at")))
    nodes = steps.groupBy("host", "node").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    way = steps.select("host", "merged", "at", "node").join(nodes, ["host", "node"]).groupBy("host", "merged").agg(F.array_sort(F.collect_list(F.struct("at", "b", "a"))).alias("way"))
    purity = F.aggregate("way", F.lit(float(base)), lambda q, x: (x["b"] + weight * q) / (x["b"] + x["a"] + weight))
    template = F.concat(F.lit("/"), F.array_join(F.slice("merged", F.lit(1), F.size("merged") - 1), "/"))
    judged = way.select("host", "merged", template.alias("template"), purity.alias("purity"))
    return tree.select("host", "labels", "merged").join(judged, ["host", "merged"]).select("host", "labels", "template", "purity", F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("found"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    many: int = 8,
    each: int = 3,
    wide: int = 1000,
    weight: float = 4.0,
    reject: float = 0.9,
    z: float = 2.0,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity.

    A page that a rule fits has the rule's verdict and is a labelled example; any
    other has its template's. Templates come from a tree of each host's paths: variable segments become wildcards
    (``generalise``), similar branches are merged (``merge_similar``) and each is judged by its labelled pages, smoothed by its
    parent's (``judge_templates``). Pages are counted by host and
    path before any tree is grown; paths of any depth are taken whole.

    A null url, or one without '://', has an empty host and path; such pages share one
    template. Empty tables give no rows; repeated ids are judged row by row; other columns are ignored.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), segments_of(F.col("path")).alias("segments"))
    blocked, allowed = (F.count(F.when(F.col("said") == v, 1)) for v in ("block", "allow"))
    stage = Stage(pages.sparkSession, "url_filter")
    paths = stage.put(rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), blocked.alias("blocked"), allowed.alias("allowed")), "paths")
    grown = generalise(stage, paths, many, each, wide)
    tree = stage.put(grown.groupBy("host", "labels").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed"))), "tree")
    found = stage.put(judge_templates(merge_similar(stage, tree, z), weight, reject), "judged")
    found = grown.select("host", "segments", "labels").join(found, ["host", "labels"]).drop("labels")
    out = rows.join(found, ["host", "segments"])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", "found").alias("verdict"), "template", "purity")
