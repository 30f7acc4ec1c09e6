"""Queries of generated questions, their answers and hard negatives, and their SQL. Communities are folders; entry points are files of the folders 0 to 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from .graph_queries import _BASE, _CYCLIC, _DEGREE, _REACH
from .operators import graph as G
from .operators import reach as H
from .operators import synthetic as Y
from .plans.lineage import cut
from .sources.bindings import edges, nodes

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_WAYS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(Y.KINDS[:-1]))
_ALL = f"""{_BASE}, {_REACH}, {_CYCLIC}, {_DEGREE}, entries as (select repo, file from nodes where folder < 3),
truth as (select repo, 'imports-of' as kind, dst as file, src as answer from edges where kind = 'import' union select repo, 'who-calls', dst, src from edges where kind = 'call' union select repo, 'blast-radius', dst, src from reach
  union select a.repo, 'cycle-through', a.file, b.file from cyclic a join cyclic b on b.repo = a.repo and b.component = a.component and b.file <> a.file),
counted as (select d.repo, k.kind, d.file, d.degree, coalesce(t.n, 0) as expected from degree d cross join (values {_WAYS}) k(i, kind)
  left join (select repo, kind, file, count(*) as n from truth group by all) t on t.repo = d.repo and t.kind = k.kind and t.file = d.file),
placed as (select *, row_number() over (partition by repo, kind, expected = 0 order by degree desc, file) as place from counted),
asked as (select repo, kind, (row_number() over (partition by repo, kind order by degree desc, file) - 1)::int as n, file, expected from placed where place <= case when expected = 0 then 1 else 5 end
  union all select repo, 'entry-points', 0, null, count(*) from entries group by repo),
answers as (select t.* from truth t join asked a on a.repo = t.repo and a.kind = t.kind and a.file = t.file union all select repo, 'entry-points', null, file from entries),
near as (select a.repo, a.kind, a.file, e.dst as near from asked a join edges e on e.repo = a.repo and e.src = a.file and e.kind = 'import' where a.kind = 'imports-of'
  union select a.repo, a.kind, a.file, y.file from asked a join nodes x on x.repo = a.repo and x.file = a.file join nodes y on y.repo = a.repo and y.folder = x.folder where a.kind in ('who-calls', 'cycle-through')
  union select a.repo, a.kind, a.file, r.dst from asked a join reach r on r.repo = a.repo and r.src = a.file where a.kind = 'blast-radius'
  union select a.repo, a.kind, a.file, n.file from asked a join nodes n on n.repo = a.repo where a.kind = 'entry-points'),
wrong as (select *, row_number() over (partition by repo, kind, file order by near) as p from near x where file is distinct from near
  and not exists (select 1 from answers t where t.repo = x.repo and t.kind = x.kind and t.file is not distinct from x.file and t.answer = x.near)),
negatives as (select repo, kind, file, string_agg(near::varchar, ',' order by near) as negatives, count(*) as k from wrong where p <= 3 group by all)"""
_SAYS = "case kind " + " ".join(f"when '{k}' then '{a}' || coalesce(file::varchar, '') || '{b}'" for k, (a, b) in Y.PHRASES.items()) + " end"
_WHY = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in Y.WHY.items()) + " end"


def _asked(spark, d):
    """Files, edges by kind, files in cycles, entry points, the questions and the searches from files whose radius is asked about. Tables, as each is read more than once."""
    n, e = cut(nodes(spark, d).select("repo", "file", "folder")), cut(G.code_property_graph(edges(spark, d)))
    cyclic, entries = H.in_cycle(e), n.filter("folder < 3").select("repo", "file")
    asked = cut(Y.questions(n, e, None, cyclic, entries))
    return n, e, cyclic, entries, asked, cut(H.around(e, asked.filter("kind = 'blast-radius'"), Y.NEGATIVES))


def _negatives(spark, d):
    n, e, cyclic, entries, asked, around = _asked(spark, d)
    truth = Y.answers(asked, e, cyclic, entries, radius=False)
    return asked, Y.hard_negatives(asked, truth, n, e, n.select("repo", "file", F.col("folder").alias("cluster")), around=around)


@query(f"{_ALL} select repo, kind, file, answer from truth union all select repo, 'entry-points', null, file from entries")
def q180_oracle_truths(spark, d):
    e = edges(spark, d)
    return Y.answers(None, e, H.in_cycle(e), nodes(spark, d).filter("folder < 3").select("repo", "file"))


@query(f"{_ALL} select *, expected = 0 as negative, {_SAYS} as question from asked")
def q184_synthetic_questions(spark, d):
    return Y.with_counts(*_asked(spark, d)[-2:])


@query(f"{_ALL} select repo, kind, file, negatives, {_WHY} as strategy from negatives")
def q185_graph_negatives(spark, d):
    return _negatives(spark, d)[1].withColumn("negatives", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ","))


@query(f"""{_ALL} select a.kind, count(*) as questions, count(*) filter (where expected = 0) as controls, count(k) as with_negatives, coalesce(sum(k), 0)::bigint as negatives
from asked a left join negatives g on g.repo = a.repo and g.kind = a.kind and g.file is not distinct from a.file group by a.kind""")
def q186_synthetic_summary(spark, d):
    return Y.summary(*_negatives(spark, d))
