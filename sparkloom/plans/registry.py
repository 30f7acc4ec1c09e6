
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse as P
from ..functions.text import extension
from ..operators import agentops, evaluation, retrieval


@dataclass
class Registry:
    """206-213: parsers by extension, rerankers, embedders, tools, verifiers, stages and scorers.

    Each is a function over DataFrames or Columns, so that whatever is added stays inside one plan:
    parser: lines (path, line, text) -> facts; reranker: (candidates, queries, chunks) -> ranked; embedder:
    chunks (id, text) -> (id, v); tool: (tables, arguments) -> rows; verifier: sets (id, expected, found) -> verdicts;
    stage: tables -> tables; scorer: a Column over candidates."""

    parsers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    rerankers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    embedders: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    verifiers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    stages: list[tuple[str, Callable[[dict], dict]]] = field(default_factory=list)
    scorers: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def parse(self, files: DataFrame) -> dict[str, DataFrame]:
        """Facts by extension of files (path, content); extensions without a parser give none."""
        lines = P.numbered(files)
        return {ext: f(lines.filter(extension(F.col("path")) == ext)) for ext, f in self.parsers.items()}

    def run(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """212: the stages in their order; a stage may add tables, not replace those of another."""
        for name, stage in self.stages:
            new = stage(tables)
            if twice := set(new) & set(tables):
                raise ValueError(f"{name} writes {sorted(twice)} again")
            tables = tables | new
        return tables


def defaults() -> Registry:
    out = Registry()
    out.parsers = {e: P.js_symbols for e in (".ts", ".tsx", ".js", ".jsx")}
    out.rerankers = {"lexical-overlap": retrieval.lexical_rerank, "identity": lambda candidates, queries, chunks: candidates}
    out.embedders = {"hashed": retrieval.hashed_embedding}
    out.tools = {"callers": lambda tables, file: tables["edges"].filter((F.col("dst") == file) & (F.col("kind") == "call")), "references": lambda tables, file: tables["edges"].filter(F.col("dst") == file)}
    out.verifiers = {"sets": evaluation.verify_sets}
    out.scorers = {"grounding": lambda: F.round(0.5 * F.col("grounding") + 0.3 * F.col("coverage") + 0.2 * F.col("substance"), 6)}
    return out


def cross_encoder(name: str, score: Callable[[list[str], list[str]], list[float]], most_chars: int = 2000, batch: int = 16) -> Callable[..., DataFrame]:
    """118: a reranker from a model's scores of (query, text) pairs, cut to a length and batched; a wrong count of
    scores fails instead of being laid against the wrong candidates."""

    def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        def run(q: pd.Series, t: pd.Series) -> pd.Series:
            out: list[float] = []
            for at in range(0, len(q), batch):
                part = score(q[at : at + batch].tolist(), [x[:most_chars] for x in t[at : at + batch]])
                if len(part) != len(q[at : at + batch]):
                    raise ValueError(f"{name} returned {len(part)} scores for {len(q[at : at + batch])} pairs")
                out += part
            return pd.Series(out, dtype=float)

        pairs = candidates.select("query_id", "id").join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(chunks.select("id", "text"), "id")
        return retrieval.top(pairs.select("query_id", "id", F.round(F.pandas_udf(run, T.DoubleType())("q", "text"), 6).alias("score")), 2**31 - 1)

    return rerank


def register_parser_udtf(spark: SparkSession, name: str = "python_facts") -> None:
    """206: Python facts as a table function, for LATERAL joins in SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="line int, kind string, name string")
    class Facts:
        def eval(self, path: str, content: str):
            if content is not None:
                try:
                    rows = P._python_by_tree(path, content)
                except (SyntaxError, ValueError, RecursionError):
                    rows = P._python_by_lines(path, content)
                for r in rows:
                    yield r[1], r[2], r[3]

    spark.udtf.register(name, Facts)


def hybrid_scorer(candidates: DataFrame, registry: Registry, scorer: str, by: list[str]) -> DataFrame:
    """213: the best candidate by a scorer from the registry."""
    return agentops.best_of(candidates, by, registry.scorers[scorer]())
