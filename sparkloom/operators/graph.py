"""Graph operators over (repo, src, dst) edges and (repo, file) nodes, one graph for each repository.

"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

MANY_IN, MANY_OUT, MANY, WIDE = 5, 8, 10, 10
#: Distinct edges of a repository that one task walks; cells of the table of what a block of sources has seen.
STEPS, SEEN = 1_000_000, 8_000_000


def edge_type(kind: Column) -> Column:
    """87: the edge type of a dependency kind; unknown kinds are references."""
    return F.when(kind.isin("import", "export", "call"), kind).when(kind == "inheritance", "extends").otherwise("reference")


def build_graph(edges: DataFrame) -> DataFrame:
    """84: one edge for each (src, dst, kind, line, evidence), the first by confidence; 0.6 and weight 1 by default."""
    first = edges.groupBy("repo", "src", "dst", "kind", "line", "evidence").agg(F.max("confidence").alias("confidence"))
    return first.withColumns({"confidence": F.coalesce("confidence", F.lit(0.6)), "weight": F.lit(1)})


def code_property_graph(edges: DataFrame) -> DataFrame:
    """86: count and least line of each (src, dst, kind)."""
    return edges.groupBy("repo", "src", "dst", "kind").agg(F.count("*").alias("count"), F.min("line").alias("line"))


def unified_graph(edges: DataFrame) -> DataFrame:
    """85: imports once for each pair, with weight 1, beside other kinds with their counts as weights."""
    cpg = code_property_graph(edges)
    imports = cpg.filter("kind = 'import'").select("repo", "src", "dst", F.lit("import").alias("type"), F.lit(1).cast("long").alias("weight"))
    return imports.unionByName(cpg.filter("kind <> 'import'").select("repo", "src", "dst", edge_type(F.col("kind")).alias("type"), F.col("count").alias("weight")))


def allowed(edges: DataFrame, min_confidence: float | None = None, kinds: list[str] | None = None) -> DataFrame:
    """62: edges of at least that confidence and of the kinds given; an empty list allows all."""
    out = edges if min_confidence is None else edges.filter(F.col("confidence") >= min_confidence)
    return out.filter(F.col("kind").isin(kinds)) if kinds else out


def direct(edges: DataFrame) -> DataFrame:
    """88: for each file its direct dependencies and dependents; parallel edges count."""
    out = edges.groupBy("repo", F.col("src").alias("file")).agg(F.count("*").alias("dependencies"))
    into = edges.groupBy("repo", F.col("dst").alias("file")).agg(F.count("*").alias("dependents"))
    return out.join(into, ["repo", "file"], "full").fillna(0, ["dependencies", "dependents"])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """90: in, out and total degree of every node."""
    ends = edges.select("repo", F.col("src").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("repo", "dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("repo", "file").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.join(sums, ["repo", "file"], "left").fillna(0, ["fan_in", "fan_out"]).withColumn("degree", F.col("fan_in") + F.col("fan_out"))


def centrality(degree: DataFrame, counts: DataFrame) -> DataFrame:
    """90: degrees with how many files depend on each file, and on how many it depends, directly or not (reach.reach_counts)."""
    return degree.join(counts.select("repo", "file", "dependents", "dependencies"), ["repo", "file"], "left").fillna(0, ["dependents", "dependencies"])


def closure(edges: DataFrame, max_depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """89: (repo, src, dst, depth), each dst reached from src and the least number of steps; src itself is left out.

    Breadth first from all files, or from starts (repo, src). A repository of at most STEPS distinct edges, which is any
    that passes its file guard, is walked in one task, with many others at once and one shuffle for all of them; larger ones go in rounds of joins
    over the whole cluster. The result is a table, as it is read more than once."""
    steps = cut(edges.filter("src <> dst").select("repo", "src", "dst").distinct())
    sizes = steps.groupBy("repo").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > STEPS).select("repo")
    if large.isEmpty():
        return _walked(steps, max_depth, starts)
    large = cut(large)
    of = lambda how: (steps.join(large, "repo", how), None if starts is None else starts.join(large, "repo", how))
    (many, from_many), (few, from_few) = of("left_semi"), of("left_anti")
    return _walked(few, max_depth, from_few).union(_in_rounds(cut(many), max_depth, from_many))


def _walked(steps: DataFrame, max_depth: int | None, starts: DataFrame | None) -> DataFrame:
    rows = steps.withColumn("start", F.lit(starts is None))
    if starts is not None:
        marks = starts.select("repo", "src").distinct().withColumn("start", F.lit(True))
        rows = steps.join(marks, ["repo", "src"], "left").withColumn("start", F.coalesce("start", F.lit(False)))
    from . import reach as H  # which looks at this module's bounds

    kinds = dict(steps.dtypes)
    walk = functools.partial(_levels, most=max_depth)
    return cut(H.in_tasks(rows, F.lit(1), walk, f"repo {kinds['repo']}, src {kinds['src']}, dst {kinds['src']}, depth int"))


def _levels(g, t: pa.Table, most: int | None) -> Iterator[pa.RecordBatch]:
    """Level by level from blocks of sources, of all the repositories of g (reach.Graph) at once; what goes out at once is one level of a block.

    What a source has seen is a stretch of a table, as long as its repository has files."""
    order = np.argsort(g.src, kind="stable")
    dst = g.dst[order]
    first = np.searchsorted(g.src[order], np.arange(g.n + 1))
    size, local = np.diff(g.start), g.local()
    sources = np.unique(g.src[t.column("start").to_numpy()])
    room = np.cumsum(size[g.group[sources]])
    done = 0
    while done < len(sources):
        to = max(done + 1, int(np.searchsorted(room, (room[done - 1] if done else 0) + SEEN, side="right")))
        own = sources[done:to]
        width = size[g.group[own]]
        begin = np.cumsum(width) - width
        base = begin - g.start[g.group[own]]  # a node's cell is its number further on
        seen = np.zeros(int(width.sum()), bool)
        seen[begin + local[own]] = True
        row, at, depth = np.arange(len(own)), own, 0
        while len(row) and depth != most:
            depth += 1
            degree = first[at + 1] - first[at]
            rows = np.repeat(row, degree)
            cell = base[rows] + dst[np.repeat(first[at] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())]
            cell = np.unique(cell[~seen[cell]])
            seen[cell] = True
            row = np.searchsorted(begin, cell, side="right") - 1
            at = cell - base[row]
            if len(row):
                yield pa.record_batch({"repo": g.repos.take(pa.array(g.group[at])), "src": g.files.take(pa.array(own[row])), "dst": g.files.take(pa.array(at)), "depth": pa.array(np.full(len(row), depth, np.int32))})
        done = to


def _in_rounds(steps: DataFrame, max_depth: int | None, starts: DataFrame | None) -> DataFrame:
    """A round joins the last round's pairs with the edges and drops pairs already known, so each pair is extended
    once. Rounds are tables, which cuts the lineage."""
    front = steps if starts is None else steps.join(starts.select("repo", "src").distinct(), ["repo", "src"], "left_semi")
    rounds = [cut(front.withColumn("depth", F.lit(1)))]
    step = steps.select("repo", F.col("src").alias("dst"), F.col("dst").alias("next"))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        known = reduce(DataFrame.union, rounds)
        new = rounds[-1].join(step, ["repo", "dst"]).select("repo", "src", F.col("next").alias("dst")).filter("src <> dst").distinct()
        new = cut(new.join(known, ["repo", "src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        rounds.append(new)
    return reduce(DataFrame.union, rounds)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """93: files without any edge."""
    return nodes.join(edges.select("repo", F.col("src").alias("file")), ["repo", "file"], "left_anti").join(edges.select("repo", F.col("dst").alias("file")), ["repo", "file"], "left_anti")


def blast_radius(nodes: DataFrame, edges: DataFrame, spread: DataFrame, cyclic: DataFrame) -> DataFrame:
    """91: dependents of each file, directly (edges) and in all, the greatest depth, and reasons for risk.

    spread is reach.dependents_by_edge; confidence is the mean over the edges by which dependents are first reached and
    the incoming edges, 1 without any."""
    into = edges.groupBy("repo", F.col("dst").alias("file")).agg(F.count("*").alias("direct"), F.sum("confidence").alias("own"))
    out = nodes.select("repo", "file").join(into, ["repo", "file"], "left").join(spread, ["repo", "file"], "left").fillna(0, ["direct", "affected", "max_depth", "own", "via"])
    n = F.col("affected") + F.col("direct")
    out = out.withColumn("confidence", F.round(F.when(n == 0, 1.0).otherwise((F.col("via") + F.col("own")) / F.when(n > 0, n)), 6)).drop("via", "own")
    out = out.join(cyclic.select("repo", "file", F.lit(True).alias("cyclic")), ["repo", "file"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("affected") > WIDE, "wide"), F.when(F.col("direct") > MANY_IN, "many-incoming"),
        F.when(F.col("confidence") < 0.7, "low-confidence"), F.when(F.col("cyclic"), "cycle"),
    ))
    return out.withColumn("reasons", F.concat_ws(",", reasons)).drop("cyclic")


def high_coupling(degree: DataFrame, counts: DataFrame) -> DataFrame:
    """94: files over any of the limits, with the reasons."""
    out = degree.join(counts.select("repo", "file", F.col("dependents").alias("affected")), ["repo", "file"], "left").fillna(0, ["affected"])
    reasons = F.array_compact(F.array(
        F.when(F.col("fan_in") >= MANY_IN, "fan-in"), F.when(F.col("fan_out") >= MANY_OUT, "fan-out"),
        F.when(F.col("degree") >= MANY, "degree"), F.when(F.col("affected") >= WIDE, "blast-radius"),
    ))
    return out.withColumn("reasons", F.concat_ws(",", reasons)).filter("reasons <> ''").select("repo", "file", "reasons")


def undirected(edges: DataFrame) -> DataFrame:
    """96: (repo, a, b, weight) in both directions; a self-loop stands once."""
    pairs = edges.select("repo", F.col("src").alias("a"), F.col("dst").alias("b"))
    both = pairs.union(pairs.filter("a <> b").select("repo", "b", "a"))
    return both.groupBy("repo", "a", "b").agg(F.count("*").alias("weight"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """97: Q of each repository at resolution 1 for clusters (repo, file, cluster), and weights within and across."""
    links = undirected(edges).withColumn("weight", F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight")))
    of = lambda c: clusters.select("repo", F.col("file").alias(c), F.col("cluster").alias(f"c_{c}"))
    placed = links.join(of("a"), ["repo", "a"]).join(of("b"), ["repo", "b"])
    each = placed.groupBy("repo", "c_a").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0)).alias("inside"))
    all_ = each.groupBy("repo").agg(F.sum("total").alias("two_m"), F.sum("inside").alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    q = F.col("inside") / F.col("two_m") - F.col("squares") / (F.col("two_m") * F.col("two_m"))
    return all_.select("repo", F.round(q, 9).alias("modularity"), (F.col("inside") / 2).alias("internal"), (F.col("two_m") - F.col("inside")).cast("double").alias("external"))


def summary(degree: DataFrame, edges: DataFrame, cyclic: DataFrame, coupled: DataFrame) -> DataFrame:
    """99: counts, mean degree and the five most central files of each repository."""
    top = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "file"))
    own = degree.withColumn("k", top).groupBy("repo").agg(
        F.count("*").alias("files"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"), F.round(F.avg("degree"), 6).alias("mean_degree"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "file")))), lambda x: x["file"].cast("string")), ",").alias("top"),
    )
    for name, part in (("edges", edges), ("cyclic", cyclic), ("coupled", coupled)):
        own = own.join(part.groupBy("repo").agg(F.count("*").alias(name)), "repo", "left").fillna(0, [name])
    return own


def capped(degree: DataFrame, edges: DataFrame, most: int, most_links: int | None = None) -> tuple[DataFrame, DataFrame]:
    """100: the `most` most central files of each repository and the edges between them, the first `most_links` of them."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "file"))
    keep = degree.withColumn("rank", rank).filter(F.col("rank") <= most)
    inside = edges.join(keep.select("repo", F.col("file").alias("src")), ["repo", "src"], "left_semi").join(keep.select("repo", F.col("file").alias("dst")), ["repo", "dst"], "left_semi")
    if most_links is not None:
        place = F.row_number().over(Window.partitionBy("repo").orderBy("src", "dst", "kind", "line", "evidence"))
        inside = inside.withColumn("__k", place).filter(F.col("__k") <= most_links).drop("__k")
    return keep, inside


def file_metrics(degree: DataFrame, counts: DataFrame) -> DataFrame:
    """101: centrality, fan-in, fan-out, blast radius and complexity (loc + symbols + in + out) of each file."""
    far = counts.select("repo", "file", F.col("dependents").alias("blast_radius"))
    out = degree.join(far, ["repo", "file"], "left").fillna(0, ["blast_radius"])
    return out.select("repo", "file", F.col("degree").alias("centrality"), "fan_in", "fan_out", "blast_radius", (F.col("loc") + F.col("symbols") + F.col("degree")).alias("complexity"))


def issues(metrics: DataFrame, cyclic: DataFrame) -> DataFrame:
    """102: components of cycles, wide blast radius, coupled files and repositories of isolated files; place orders those
    of a repository by severity, then by kind and file."""
    n = metrics.groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.when(F.col("centrality") == 0, 1).otherwise(0)).alias("alone"))
    of = metrics.join(n, "repo")
    share = F.col("blast_radius") / F.col("n")
    rings = cyclic.groupBy("repo", "component").agg(F.count("*").alias("size"))
    severe = lambda c: F.when(c, "high").otherwise("medium")
    parts = [
        rings.select("repo", F.lit("cycle").alias("issue"), severe(F.col("size") >= 4).alias("severity"), F.col("component").alias("file")),
        of.filter((F.col("n") >= 8) & (share >= 0.25)).select("repo", F.lit("blast-radius"), severe(share >= 0.5), "file"),
        of.filter("centrality >= 20").select("repo", F.lit("coupling"), F.lit("low"), "file"),
        n.filter("alone > 0 and alone * 2 >= n").select("repo", F.lit("isolated"), F.lit("low"), F.lit(None).cast("long")),
    ]
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return reduce(DataFrame.union, parts).withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(rank, "issue", F.col("file").asc_nulls_last())))


def health(metrics: DataFrame, cyclic: DataFrame) -> DataFrame:
    """103, 68: 100 less up to 40 for cycles, 35 for the widest blast radius and 15 for isolated files; and its grade."""
    rings = cyclic.groupBy("repo").agg(F.count_distinct("component").alias("cycles"))
    own = metrics.groupBy("repo").agg(F.count("*").alias("n"), F.max("blast_radius").alias("widest"), F.sum(F.when(F.col("centrality") == 0, 1).otherwise(0)).alias("alone"))
    own = own.join(rings, "repo", "left").fillna(0, ["cycles"])
    part = lambda c: F.least(F.lit(1.0), c / F.col("n"))
    score = 100 - 40 * part(10 * F.col("cycles")) - 35 * part(F.col("widest")) - 15 * part(F.col("alone"))
    return own.withColumn("health", F.floor(score + 0.5).cast("int")).withColumn("grade", grade(F.col("health"))).select("repo", "cycles", "widest", "alone", "health", "grade")


def grade(score: Column) -> Column:
    """68."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def hop_tiers(counts: DataFrame) -> DataFrame:
    """105: how many dependents of each file that has any are one, two, three and more steps away."""
    return counts.filter("dependents > 0").select("repo", "file", "tier1", "tier2", "tier3", "tier4")


def ring_layout(degree: DataFrame, most: int = 64, rings: int = 5) -> DataFrame:
    """109: the files with the highest fan-in on rings around the first, an angle each."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("fan_in"), "file"))
    n = F.count("*").over(Window.partitionBy("repo"))
    out = degree.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("n", n)
    per = F.ceil((F.col("n") - 1) / rings)
    out = out.withColumn("ring", F.when(F.col("rank") == 1, 0).otherwise(F.ceil((F.col("rank") - 1) / per)).cast("int"))
    place = Window.partitionBy("repo", "ring")
    angle = 2 * F.pi() * (F.row_number().over(place.orderBy("rank")) - 1) / F.count("*").over(place)
    return out.select("repo", "file", "ring", (F.round(F.col("ring") * F.cos(angle), 6) + 0.0).alias("x"), (F.round(F.col("ring") * F.sin(angle), 6) + 0.0).alias("y"))


def edge_classes(edges: DataFrame, nodes: DataFrame, layers: int = 5) -> DataFrame:
    """106, 107: lanes by folder, and edges within a lane (data), to a lower one (control) or upwards (violation)."""
    lane = lambda c: nodes.select("repo", F.col("file").alias(c), (F.col("folder") % layers).alias(f"lane_{c}"))
    both = edges.join(lane("src"), ["repo", "src"]).join(lane("dst"), ["repo", "dst"])
    kind = F.when(F.col("lane_src") == F.col("lane_dst"), "data").when(F.col("lane_src") > F.col("lane_dst"), "control").otherwise("violation")
    return both.withColumn("class", kind).groupBy("repo", "class").agg(F.count("*").alias("n"))


def safe_to_change(nodes: DataFrame, counts: DataFrame, most: int = 5) -> DataFrame:
    """108: files with few dependents, none of them in another folder (counts with folders)."""
    out = nodes.select("repo", "file").join(counts.select("repo", "file", F.col("dependents").alias("affected"), "abroad"), ["repo", "file"], "left").fillna(0, ["affected", "abroad"])
    return out.withColumn("safe", (F.col("affected") <= most) & (F.col("abroad") == 0))


def change_impact(nodes: DataFrame, edges: DataFrame, counts: DataFrame, api: Column, entry: Column, most: int = 5) -> DataFrame:
    """108: what changing or moving each file comes to.

    files_to_edit: its direct importers and itself. api_hops: the distance of the nearest dependent in the API, 0 if the file
    is in it. tests, test_hops: tests that reach it. advice: by how many it affects. entry_probable: an entry point, or imported from
    another folder. counts are reach.reach_counts with the marks api and tests; api and entry look at a file's own columns."""
    of = nodes.select("repo", F.col("file").alias("src"), F.col("folder").alias("from"))
    into = edges.join(of, ["repo", "src"]).groupBy("repo", F.col("dst").alias("file"))
    into = into.agg(F.count_distinct("src").alias("importers"), F.collect_set("from").alias("folders"))
    out = nodes.join(into, ["repo", "file"], "left").join(counts.select("repo", "file", "dependents", "api_hops", "tests", "tests_hops"), ["repo", "file"], "left")
    affected, elsewhere = F.coalesce("dependents", F.lit(0)), F.coalesce(F.size(F.array_except("folders", F.array("folder"))) > 0, F.lit(False))
    advice = F.when(affected == 0, "nothing depends on it").when(affected <= most, "reviewable in one change").otherwise("stage it")
    return out.select(
        "repo", "file", (F.coalesce("importers", F.lit(0)) + 1).alias("files_to_edit"), F.when(api, 0).otherwise(F.col("api_hops")).alias("api_hops"),
        F.coalesce("tests", F.lit(0)).alias("tests"), F.col("tests_hops").alias("test_hops"), affected.alias("affected"), (affected <= most).alias("alone"), advice.alias("advice"), (entry | elsewhere).alias("entry_probable"),
    )


def view_model(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """110: edges with a flag for those inside a cycle's component."""
    of = lambda c: cyclic.select("repo", F.col("file").alias(c), F.col("component").alias(f"k_{c}"))
    both = edges.join(of("src"), ["repo", "src"], "left").join(of("dst"), ["repo", "dst"], "left")
    return both.withColumn("in_cycle", F.coalesce(F.col("k_src") == F.col("k_dst"), F.lit(False)))


def focus(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """111: each centre (repo, file) with its neighbours."""
    out = edges.join(centre.withColumnRenamed("file", "src"), ["repo", "src"]).select("repo", F.col("src").alias("centre"), F.col("dst").alias("file"))
    into = edges.join(centre.withColumnRenamed("file", "dst"), ["repo", "dst"]).select("repo", F.col("dst").alias("centre"), F.col("src").alias("file"))
    return out.union(into).filter("centre <> file").distinct()
