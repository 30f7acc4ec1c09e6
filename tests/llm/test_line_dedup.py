import hashlib
from collections import Counter

from cases import clashing, prose, table
from pyspark.sql import functions as F

from sparkloom.llm.line_dedup import SPACE, dedup_lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    holders = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(SPACE).translate(LOW)
    for i, lines in split:
        for x in lines:
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(-(2**63) if i is None else i)
    out = []
    for i, lines in split:
        own = -(2**63) if i is None else i
        keep = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and own != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return Counter(out)


def run(df, *limits):
    out = dedup_lines(df, *limits).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return Counter(tuple(r) for r in out.collect())


def test_brute_force(spark):
    line = "A line that MANY documents hold, like a licence ÉÀ"
    own = [(i, f"{prose(i, 30)}\n \t{line if i % 2 else line.lower().replace('é', 'É').replace('à', 'À')} \x0b\nend {i}\n{line}", "en", "s", 1) for i in range(9)]
    own += [(3, own[3][1], "en", "s", 1), (None, line, "en", "s", 1), (50, None, None, None, None), (51, "", None, None, 0), (52, "\n\n", None, None, 2), (53, "\n".join([line] * 3000), "en", "s", 1)]
    df = table(spark, own)
    got = run(df)
    assert got == brute([(r[0], r[1]) for r in own], 40, 5)
    assert sum(k[2] * v for k, v in got.items()) > 10


def test_edges(spark):
    from cases import rows

    for df in (table(spark), clashing(spark)):
        assert run(df, 4, 2) == brute([(r[0], r[1]) for r in rows()], 4, 2)
    out = dedup_lines(clashing(spark))
    assert set(out.columns) == set(clashing(spark).columns) and out.filter("id <> 'mine'").count() == 0
    assert dedup_lines(table(spark, [])).count() == 0
