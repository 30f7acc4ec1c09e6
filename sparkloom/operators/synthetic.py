"""Questions whose answers are facts of the graph, those answers, and files that look like answers and aren't.

"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import reach as H

#: The kinds in order, and how they are asked.
KINDS = ("imports-of", "who-calls", "blast-radius", "cycle-through", "entry-points")
PHRASES = {
    "imports-of": ("Which files import ", "?"), "who-calls": ("Which files call into ", "?"), "blast-radius": ("What breaks if I change ", "?"),
    "cycle-through": ("Which files are in a dependency cycle with ", "?"), "entry-points": ("Where does execution start in this repository?", ""),
}
WHY = {
    "imports-of": "files the target imports", "who-calls": "same community, no call into the target", "blast-radius": "files the target depends on",
    "cycle-through": "same community, not in a cycle with the target", "entry-points": "files that are no entry points",
}
PER_KIND, CONTROLS, NEGATIVES = 5, 1, 3


def questions(nodes: DataFrame, edges: DataFrame, counts: DataFrame | None, cyclic: DataFrame, entries: DataFrame, per_kind: int = PER_KIND, controls: int = CONTROLS) -> DataFrame:
    """184: (repo, kind, n, file, expected, negative, question): of each kind the first files with an answer and the first without one,
    by degree, then by id, in that order, numbered from 0; and one question for the entry points of a repository that has any.

    edges: of a file's, or counted by kind (graph.code_property_graph); cyclic: reach.in_cycle; entries: (repo, file). No pairs are made: how
    many answers there are is known from counts (reach.reach_counts). Without these, expected is 1 for the radius of any file that has one;
    reach.around counts it for the files chosen (`with_counts`)."""
    cpg = edges if "count" in edges.columns else G.code_property_graph(edges)
    row = lambda df, file, **has: df.select("repo", F.col(file).alias("file"), *[F.coalesce(has[k].cast("long"), F.lit(0)).alias(k) if k in has else F.lit(0).cast("long").alias(k) for k in ("own", "degree", *KINDS[:-1])])
    number = lambda c: F.when(c, 1)
    into = {"imports-of": number(F.col("kind") == "import"), "who-calls": number(F.col("kind") == "call")}
    if counts is None:
        into["blast-radius"] = number(F.col("src") != F.col("dst"))
    ring = cyclic.withColumn("k", F.count("*").over(Window.partitionBy("repo", "component")) - 1)
    rows = [row(nodes, "file", own=F.lit(1)), row(cpg, "src", degree=F.col("count")), row(cpg, "dst", degree=F.col("count"), **into), row(ring, "file", **{"cycle-through": F.col("k")})]
    if counts is not None:
        rows.append(row(counts, "file", **{"blast-radius": F.col("dependents")}))
    facts = reduce(DataFrame.union, rows).groupBy("repo", "file").agg(*[F.sum(k).alias(k) for k in ("own", "degree", *KINDS[:-1])]).filter("own > 0")
    if counts is None:
        facts = facts.withColumn("blast-radius", F.least("blast-radius", F.lit(1)))
    w = Window.partitionBy("repo").orderBy(F.desc("degree"), "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = facts.withColumns({"place": F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "file"))} | {f"yes {k}": F.sum(F.when(F.col(k) > 0, 1).otherwise(0)).over(w) for k in KINDS[:-1]})

    def one(k):
        yes, no = F.col(f"yes {k}"), F.col("place") - F.col(f"yes {k}")
        n = (F.least(yes, F.lit(per_kind)) + F.least(no, F.lit(controls)) - 1).cast("int")  # those kept so far
        return F.when(F.when(F.col(k) > 0, yes <= per_kind).otherwise(no <= controls), F.struct(F.lit(k).alias("kind"), n.alias("n"), F.col(k).alias("expected")))

    kept = facts.select("repo", "file", F.explode(F.array_compact(F.array(*map(one, KINDS[:-1])))).alias("x")).select("repo", "x.kind", "x.n", "file", "x.expected")
    whole = entries.groupBy("repo").agg(F.count_distinct("file").alias("expected")).select("repo", F.lit(KINDS[-1]).alias("kind"), F.lit(0).alias("n"), F.lit(None).cast(nodes.schema["file"].dataType).alias("file"), "expected")
    out = kept.union(whole)
    text = reduce(lambda c, k: c.when(F.col("kind") == k, F.concat(F.lit(PHRASES[k][0]), F.coalesce(F.col("file").cast("string"), F.lit("")), F.lit(PHRASES[k][1]))), KINDS, F)
    return out.withColumns({"negative": F.col("expected") == 0, "question": text})


def with_counts(asked: DataFrame, around: DataFrame) -> DataFrame:
    """Questions made without counts, with how many answers those of a radius have."""
    own = around.select("repo", F.lit(KINDS[2]).alias("kind"), "file", "dependents")
    return asked.join(own, ["repo", "kind", "file"], "left").withColumn("expected", F.coalesce("dependents", "expected")).select(asked.columns)


def answers(asked: DataFrame | None, edges: DataFrame, cyclic: DataFrame, entries: DataFrame, radius: bool = True) -> DataFrame:
    """180: (repo, kind, file, answer) of the questions asked, searches then starting from the files that are asked about only; of None,
    every answer to every file's question of each kind. Without radius, those that take no search."""
    of = lambda kind: asked.filter(F.col("kind") == kind).select("repo", "file").distinct()
    held = lambda df, kind: df if asked is None else df.join(of(kind), ["repo", "file"], "left_semi")
    into = edges.select("repo", F.col("dst").alias("file"), F.col("src").alias("answer"), F.col("kind").alias("edge"))
    direct = lambda kind, edge: held(into.filter(F.col("edge") == edge), kind).select("repo", F.lit(kind).alias("kind"), "file", "answer")
    ring = cyclic.select("repo", "component", F.col("file").alias("answer"))
    through = held(cyclic, "cycle-through").join(ring, ["repo", "component"]).filter("file <> answer")
    none = F.lit(None).cast(edges.schema["dst"].dataType)
    parts = [
        direct("imports-of", "import"), direct("who-calls", "call"), through.select("repo", F.lit("cycle-through"), "file", "answer"),
        (entries if asked is None else entries.join(asked.filter("kind = 'entry-points'").select("repo"), "repo", "left_semi")).select("repo", F.lit("entry-points"), none, "file"),
    ]
    if radius:
        back = G.closure(edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")), starts=None if asked is None else of("blast-radius").withColumnRenamed("file", "src"))
        parts.append(back.select("repo", F.lit("blast-radius"), "src", "dst"))
    return reduce(DataFrame.union, parts).distinct()


def hard_negatives(asked: DataFrame, truth: DataFrame, nodes: DataFrame, edges: DataFrame, clusters: DataFrame, most: int = NEGATIVES, around: DataFrame | None = None) -> DataFrame:
    """185: (repo, kind, file, negatives, strategy): the first `most` files by id that are near and wrong, none of them the file itself or an answer.

    imports-of: what the file imports, which is the other direction. who-calls, cycle-through: files of its community (clusters: repo,
    file, cluster). blast-radius: what it depends on, upstream instead of downstream. entry-points: all other files. Of a radius only
    these files are kept, by the searches that find both directions (around: reach.around of at least the files asked about); truth
    need not have its answers."""
    of = lambda kind: asked.filter(F.col("kind") == kind).select("repo", "kind", "file")
    if around is None:
        around = H.around(edges, of("blast-radius"), most)
    up = of("blast-radius").join(around, ["repo", "file"]).select("repo", "kind", "file", F.slice("beyond", 1, most).alias("negatives")).filter(F.size("negatives") > 0)
    out = edges.filter("kind = 'import'").select("repo", F.col("src").alias("file"), F.col("dst").alias("near"))
    mates = clusters.select("repo", "cluster", F.col("file").alias("near"))
    same = asked.filter(F.col("kind").isin("who-calls", "cycle-through")).select("repo", "kind", "file").join(clusters, ["repo", "file"]).join(mates, ["repo", "cluster"])
    parts = [
        of("imports-of").join(out, ["repo", "file"]).select("repo", "kind", "file", "near"), same.select("repo", "kind", "file", "near"),
        of("entry-points").join(nodes.select("repo", F.col("file").alias("near")), "repo").select("repo", "kind", "file", "near"),
    ]
    near = reduce(DataFrame.union, parts).filter(~F.col("file").eqNullSafe(F.col("near"))).withColumn("right", F.lit(False))
    right = truth.filter("kind <> 'blast-radius'").select("repo", "kind", "file", "answer", F.lit(True))
    # an answer and what is near meet in one shuffle by question, which the groups below share
    wrong = near.union(right).repartition("repo", "kind", "file").groupBy("repo", "kind", "file", "near").agg(F.max("right").alias("right")).filter("not right")
    first = wrong.withColumn("p", F.row_number().over(Window.partitionBy("repo", "kind", "file").orderBy("near"))).filter(F.col("p") <= most)
    why = reduce(lambda c, k: c.when(F.col("kind") == k, WHY[k]), KINDS, F)
    own = first.groupBy("repo", "kind", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "near"))), lambda x: x["near"]).alias("negatives"))
    return own.union(up).withColumn("strategy", why)


def summary(asked: DataFrame, negatives: DataFrame) -> DataFrame:
    """186: of each kind its questions, those without an answer, those with hard negatives, and how many these are."""
    had = negatives.select("repo", "kind", F.col("file").alias("f"), F.size("negatives").alias("k"))
    both = asked.alias("a").join(had.alias("h"), (F.col("a.repo") == F.col("h.repo")) & (F.col("a.kind") == F.col("h.kind")) & F.col("file").eqNullSafe(F.col("f")), "left")
    return both.groupBy(F.col("a.kind").alias("kind")).agg(F.count("*").alias("questions"), F.sum(F.col("negative").cast("long")).alias("controls"), F.count("k").alias("with_negatives"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("negatives"))
