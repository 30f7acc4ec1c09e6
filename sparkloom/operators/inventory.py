
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Manifests with their ecosystem, in order; README names in order; frameworks by package.
MANIFESTS = {"package.json": "npm", "requirements.txt": "pip", "pyproject.toml": "pip", "setup.py": "pip", "go.mod": "go", "Cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "Gemfile": "rubygems", "composer.json": "composer"}
READMES = ["README.md", "Readme.md", "readme.md", "README.markdown", "README.rst", "README.txt", "README", "readme"]
FRAMEWORKS = {"react": "React", "next": "Next.js", "vue": "Vue", "express": "Express", "fastapi": "FastAPI", "django": "Django", "flask": "Flask"}
#: Folder names that put a file in a lane, by the lanes' order.
LANES = {
    "data-configuration": "db database migrations migration schema schemas models model entities entity persistence repository repositories dal prisma queues queue storage store stores",
    "platform-libraries": "lib libs util utils utility utilities common shared helpers helper vendor internal telemetry logging logger log metrics tracing observability compiler bundler codegen toolchain",
    "clients-entry": "cli bin cmd cmds commands scripts worker workers jobs daemon entry main",
    "edge-transport": "server http transport gateway middleware middlewares routes route router routing controllers controller handlers handler rpc grpc socket sockets",
    "application": "api apis ui components component pages page views view screens screen widgets features feature containers hooks app web frontend client",
    "domain-engine": "core domain domains service services engine business logic usecase usecases auth session graph parser parsers analyzer analyzers scheduler resolver resolvers agents agent",
}
#: Entry points by a source file's stem.
STEMS = {"index": "main", "main": "main", "app": "main", "server": "server", "cli": "cli-bin"}


def first_of(files: DataFrame, names: list[str]) -> DataFrame:
    """17: for each repository the first of the names that is a file (repo, path, content)."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    return files.filter(F.col("path").isin(names)).groupBy("repo").agg(F.min_by("path", place).alias("path"), F.min_by("content", place).alias("content"))


def manifests(files: DataFrame) -> DataFrame:
    """17, 43: manifests of each repository with their ecosystem and the frameworks they name: keys of a JSON file's
    dependencies, words of any other."""
    eco = F.element_at(F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), F.col("path"))
    sections = [F.map_keys(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")) for k in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev")]
    none = F.expr("cast(array() as array<string>)")
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(s, none) for s in sections])))
    low = F.lower("content")
    named = [F.when(F.when(F.col("path").endswith(".json"), F.array_contains(keys, k)).otherwise(low.contains(k)), label) for k, label in FRAMEWORKS.items()]
    return files.filter(F.col("path").isin(list(MANIFESTS))).select("repo", "path", eco.alias("ecosystem"), F.array_join(F.array_sort(F.array_compact(F.array(*named))), ",").alias("frameworks"), F.get_json_object("content", "$.bin").isNotNull().alias("bin"), F.get_json_object("content", "$.workspaces").isNotNull().alias("workspaces"), F.coalesce(F.get_json_object("content", "$.main"), F.get_json_object("content", "$.exports")).isNotNull().alias("library"))


def project_type(found: DataFrame) -> DataFrame:
    """44: monorepo, cli, library or application, by hard evidence first; unknown without a manifest."""
    any_ = lambda c: F.bool_or(F.coalesce(F.col(c), F.lit(False)))
    return found.groupBy("repo").agg(F.when(any_("workspaces"), "monorepo").when(any_("bin"), "cli").when(any_("library"), "library").otherwise("application").alias("type"))


def entry_points(files: DataFrame) -> DataFrame:
    """42: (repo, file, kind, evidence) from package.json and from the names of source files (repo, path, role, content)."""
    pkg = files.filter("path = 'package.json'")
    clean = lambda c: F.regexp_replace(F.trim(c), r"^(\./|/+)", "")
    bins = F.coalesce(F.map_values(F.from_json(F.get_json_object("content", "$.bin"), "map<string,string>")), F.array(F.get_json_object("content", "$.bin")))
    leaves = F.regexp_extract_all(F.get_json_object("content", "$.exports"), F.lit(r'"(\.?/?[^"{}]+)"\s*[,}]'), F.lit(1))
    leaves = F.when(F.get_json_object("content", "$.exports").startswith("{"), leaves).otherwise(F.array(F.get_json_object("content", "$.exports")))
    rows = lambda values, kind, evidence: pkg.select("repo", F.explode(values).alias("f"), F.lit(kind).alias("kind"), F.lit(evidence).alias("evidence")).filter("f is not null").select("repo", clean(F.col("f")).alias("file"), "kind", "evidence")
    main = F.array(F.get_json_object("content", "$.main"), F.get_json_object("content", "$.module"))
    stem = F.lower(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in STEMS.items() for x in kv]), stem)
    named = files.filter("role = 'source'").select("repo", F.col("path").alias("file"), kind.alias("kind"), F.lit("filename-convention").alias("evidence")).filter("kind is not null")
    return reduce(DataFrame.union, [rows(bins, "cli-bin", "package-json-bin"), rows(main, "main", "package-json-main"), rows(leaves, "main", "package-json-exports"), named]).distinct()


def symbol_kind(kind: Column, signature: Column) -> Column:
    """41: components and hooks are functions; an unknown kind is told from the signature."""
    starts = lambda p: signature.rlike(rf"^\s*(?:export\s+)?{p}\b")
    told = F.when(starts("interface"), "interface").when(starts("type"), "type").when(starts(r"(?:const\s+)?enum"), "enum").otherwise("variable")
    return F.when(kind.isin("function", "method", "class", "variable"), kind).when(kind.isin("component", "hook"), "function").otherwise(told)


def lane(path: Column, role: Column, entry: Column) -> Column:
    """106: the lane of a file: by role, as an entry point, by the first lane one of its folders names, else by role."""
    folders = F.split(F.regexp_replace(F.lower(path), "/?[^/]*$", ""), "/")
    out = F.when(role == "source", "domain-engine").otherwise("unclassified")
    for name, words in reversed(LANES.items()):
        out = F.when(F.arrays_overlap(folders, F.array(*map(F.lit, words.split()))), name).otherwise(out)
    return F.when(role == "config", "data-configuration").when((role == "test") | entry, "clients-entry").otherwise(out)


def citation_url(base: Column, sha: Column, path: Column, start: Column, end: Column) -> Column:
    """67: the address of cited lines, each segment of the path encoded."""
    encoded = F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
    lines = F.when(start.isNull(), "").otherwise(F.concat(F.lit("#L"), start.cast("string"), F.when(end.isNull() | (end == start), "").otherwise(F.concat(F.lit("-L"), end.cast("string")))))
    return F.concat(base, F.lit("/blob/"), sha, F.lit("/"), encoded, lines)


def citation_label(path: Column, start: Column, end: Column) -> Column:
    """67."""
    return F.when(start.isNull(), path).otherwise(F.concat(path, F.lit(":"), start.cast("string"), F.when(end.isNull() | (end == start), "").otherwise(F.concat(F.lit("-"), end.cast("string")))))


def module_label(path: Column) -> Column:
    """67: folder and file without extension."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def usage(rows: DataFrame, group: str) -> DataFrame:
    """69: usage numbers given as text, summed; measured only if all of them are numbers."""
    n = F.expr("try_cast(tokens as double)")
    ok = n.isNotNull() & (n >= 0)
    return rows.groupBy(group).agg(F.sum(F.when(ok, n).otherwise(0.0)).alias("tokens"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("measured"))


def cited_in(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """60, 182: whether lines (file, start, end) lie within one retrieved chunk of their file."""
    r = retrieved.select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("end").alias("e"))
    inside = cited.join(r, (F.col("file") == F.col("f")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")), "left_semi").distinct().withColumn("grounded", F.lit(True))
    return cited.join(inside, cited.columns, "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def verify_grounding(claims: DataFrame, tasks: DataFrame, files: DataFrame, retrieved: DataFrame) -> DataFrame:
    """182: three verdicts on each task's claims (task, file, start, end; lines null where a file is meant): (task, verifier, claims, bad, score, passed).

    files: the files claimed are known (file, lines). lines: ranges are possible and inside their file; a file without a count can't be
    checked, and passes. citations: what is cited lies inside one chunk that was retrieved (task, file, start, end). A task that claims nothing
    has made nothing up: its score is 1."""
    own = claims.select("task", "file", "start", "end").distinct()
    known = files.groupBy("file").agg(F.max("lines").alias("lines"), F.lit(True).alias("known"))
    met = own.join(known, "file", "left")
    chunks = retrieved.select(F.col("task").alias("t"), F.col("file").alias("f"), F.col("start").alias("s"), F.col("end").alias("e"))
    inside = (F.col("task") == F.col("t")) & (F.col("file") == F.col("f")) & (F.col("start").isNull() | (F.col("start") >= F.col("s"))) & (F.col("end").isNull() | (F.col("end") <= F.col("e")))
    outside = own.join(chunks, inside, "left_anti").select("task", "file", "start", "end", F.lit(True).alias("outside"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("task", "file", "start", "end")]
    cited = own.alias("a").join(outside.alias("b"), same, "left").select("a.task", F.col("outside").isNotNull().alias("bad"))
    ranged = F.col("start").isNotNull() & F.col("end").isNotNull()
    wrong = (F.col("start") < 1) | (F.col("end") < F.col("start")) | F.coalesce(F.col("end") > F.col("lines"), F.lit(False))
    parts = {"files": met.select("task", "file", F.col("known").isNull().alias("bad")).distinct().drop("file"), "lines": met.filter(ranged).select("task", wrong.alias("bad")), "citations": cited}
    out = None
    for name, rows in parts.items():
        n = rows.groupBy("task").agg(F.count("*").alias("claims"), F.sum(F.col("bad").cast("long")).alias("bad"))
        one = tasks.select("task").distinct().join(n, "task", "left").fillna(0, ["claims", "bad"]).withColumn("verifier", F.lit(name))
        out = one if out is None else out.union(one)
    score = F.when(F.col("claims") == 0, 1.0).otherwise(1 - F.col("bad") / F.when(F.col("claims") > 0, F.col("claims")))
    return out.select("task", "verifier", "claims", "bad", F.round(score, 6).alias("score"), (F.col("bad") == 0).alias("passed"))


def hits(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """61: pairs of a chunk and a target of one file whose lines overlap."""
    t = targets.select(F.col("file").alias("f"), F.col("start").alias("ts"), F.col("end").alias("te"), "target")
    return chunks.join(t, (F.col("file") == F.col("f")) & (F.col("start") <= F.col("te")) & (F.col("end") >= F.col("ts"))).select("chunk", "target")


def scope_chains(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """124: names of the symbols around each chunk (file, chunk, start, end, symbol), the widest first."""
    s = symbols.select(F.col("file").alias("f"), "name", F.col("start").alias("s"), F.col("end").alias("e"))
    around = chunks.join(s, (F.col("file") == F.col("f")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")) & ~F.col("name").eqNullSafe(F.col("symbol")) & ((F.col("s") != F.col("start")) | (F.col("e") != F.col("end"))))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((F.col("s") - F.col("e")).alias("w"), "s", "name"))), lambda x: x["name"]))
    return around.groupBy("file", "chunk").agg(F.array_join(names, " > ").alias("scope"))


def run_mode(skipped: Column, exhausted: Column) -> list[Column]:
    """217: the mode of a run and why it fell short."""
    reasons = F.array_compact(F.array(F.when(F.array_contains(skipped, "synthesize"), "no-chat-provider"), F.when(F.array_contains(skipped, "rag"), "no-embedding-provider"), F.when(exhausted, "budget-exhausted")))
    return [F.when(F.size(reasons) > 0, "deterministic-only").otherwise("full").alias("mode"), F.array_join(reasons, ",").alias("degradations")]


def suggested_questions(repos: DataFrame) -> DataFrame:
    """170: at most three questions by repository from its key file, entry point and cycle, if it has them."""
    q = F.array_compact(F.array(
        F.when(F.col("central").isNotNull(), F.concat(F.lit("What breaks if I change "), F.col("central").cast("string"), F.lit("?"))),
        F.when(F.col("entry").isNotNull(), F.concat(F.lit("What happens when "), F.col("entry").cast("string"), F.lit(" runs?"))),
        F.when(F.col("cycle").isNotNull(), F.concat(F.lit("Why is there a cycle through "), F.col("cycle").cast("string"), F.lit("?"))), F.lit("What's safe to delete?"),
    ))
    return repos.select("repo", F.array_join(F.slice(q, 1, 3), " ").alias("questions"))


def fact_packs(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, most_rows: int = 40, most_files: int = 25) -> DataFrame:
    """159, 83: for each cluster its first files and its edges within, into and out of it, so many of each."""
    of = lambda c: clusters.select("repo", F.col("file").alias(c), F.col("cluster").alias(f"c_{c}"))
    both = edges.select("repo", "src", "dst").join(of("src"), ["repo", "src"]).join(of("dst"), ["repo", "dst"])
    inner = both.filter("c_src = c_dst").select("repo", F.col("c_src").alias("cluster"), F.lit("internal").alias("side"), "src", "dst")
    into = both.filter("c_src <> c_dst").select("repo", F.col("c_dst").alias("cluster"), F.lit("inbound").alias("side"), "src", "dst")
    out = both.filter("c_src <> c_dst").select("repo", F.col("c_src").alias("cluster"), F.lit("outbound").alias("side"), "src", "dst")
    files = nodes.join(clusters, ["repo", "file"]).select("repo", "cluster", F.lit("file").alias("side"), F.col("file").alias("src"), F.col("file").alias("dst"))
    rows = reduce(DataFrame.union, [inner, into, out, files]).withColumn("k", F.row_number().over(Window.partitionBy("repo", "cluster", "side").orderBy("src", "dst")))
    return rows.filter(F.col("k") <= F.when(F.col("side") == "file", most_files).otherwise(most_rows)).groupBy("repo", "cluster", "side").agg(F.count("*").alias("shown"), F.min("src").alias("first"), F.max("dst").alias("last"))


def synthesis_scores(order: DataFrame, key_files: DataFrame, expected: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """172, 167: recall of expected entry points among the first k files of the reading order and the first k key
    files, and the share of the order that is known. Nothing expected has recall 1."""
    shown = order.filter(F.col("position") <= k).select("repo", "file").union(key_files.filter(F.col("position") <= k).select("repo", "file")).distinct().withColumn("s", F.lit(1))
    recall = expected.select("repo", "file").distinct().join(shown, ["repo", "file"], "left").groupBy("repo").agg(F.avg(F.coalesce("s", F.lit(0))).alias("recall"))
    grounded = order.join(known.select("repo", "file").distinct().withColumn("g", F.lit(1)), ["repo", "file"], "left").groupBy("repo").agg(F.avg(F.coalesce("g", F.lit(0))).alias("resolved"))
    return grounded.join(recall, "repo", "left").select("repo", F.round(F.coalesce("recall", F.lit(1.0)), 6).alias("recall"), F.round("resolved", 6).alias("resolved"))


def symbol_search(symbols: DataFrame, names: DataFrame, most: int = 25) -> DataFrame:
    """150: symbols by exact name where there are some, else by any name that holds it, whatever its case."""
    exact = symbols.join(names, "name").select(F.col("name").alias("asked"), "name", "path", F.lit(True).alias("exact"))
    rest = names.join(exact.select(F.col("asked").alias("name")), "name", "left_anti").withColumnRenamed("name", "asked")
    # whatever holds a text holds its first three characters, which make an equality to join on
    low = F.lower("name")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substr(low, i, n)))))
    keyed = symbols.filter("name <> ''").select("name", "path", F.explode(grams).alias("key"))
    part = keyed.join(rest.withColumn("key", F.lower(F.substring("asked", 1, 3))), "key").filter(F.lower("name").contains(F.lower("asked"))).select("asked", "name", "path", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("path", "name"))
    return exact.union(part).withColumn("k", rank).filter(F.col("k") <= most)
