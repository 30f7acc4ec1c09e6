import hashlib
import random
import re

import regex
from cases import clashing, rows, table
from pyspark.sql import functions as F

from sparkloom.llm import surrogates as S
from sparkloom.llm.common import Scratch

MAIL = "anna.berg@mail.example.org"


def run(spark, texts, key="k"):
    own = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in S.pseudonymise(table(spark, own), key).collect()}


def test_types_formats_and_coreference(spark):
    texts = [
        f"Write to {MAIL} or call +1 (017) 555-7713, at 10.1.2.3.", f"{MAIL.upper()} again; (017) 555-7713; Mr. John Smith and Mrs Jane Smith", "Mr John Smith met Госпожа Анна Петрова; 4111 1111 1111 1111",
        "card 4111-1111-1111-1111, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00 / DE89370400440532013000", "nothing here, 12 apples and 3.5 pears, version 1.2.3", "999.1.1.1 and a@b and 1.2.3.4.5",
    ]
    out = run(spark, texts)
    for i, t in enumerate(texts):
        for entity in (MAIL, "555-7713", "10.1.2.3", "Smith", "Анна", "Петрова", "4111", "123-45", "3704"):
            assert entity.lower() not in out[i].text.lower()
        if i >= 4:
            assert out[i].text == t and out[i].n_entities == 0
    assert out[0].entity_kinds == "email:1,ip:1,phone:1" and out[3].entity_kinds == "card:1,iban:2,ssn:1"
    a, b = re.search(r"Write to (\S+) or call (\+1 \(\d{3}\) \d{3}-\d{4}), at (\d+\.\d+\.\d+\.\d+)\.$", out[0].text), re.search(r"^(\S+) again; (\(\d{3}\) \d{3}-\d{4}); Mr\. (\w+ \w+) and Mrs (\w+ \w+)$", out[1].text)
    assert a and b and a[1].upper() == b[1] and a[2].endswith(b[2]) and b[3] != b[4]
    assert b[3].split()[0] in S.GIVEN["mLatin"] and b[4].split()[0] in S.GIVEN["fLatin"]
    c = re.search(r"^Mr (\w+ \w+) met Госпожа ([\w]+ [\w]+); (\d{4} \d{4} \d{4} \d{4})$", out[2].text)
    assert c and c[1] == b[3] and c[2].split()[0] in S.GIVEN["fCyrillic"] and re.fullmatch("[А-Яа-я ]+", c[2])
    d = re.search(r"^card (\S+), ssn \d{3}-\d{2}-\d{4}, iban (DE[\dA-Z ]+) / (DE\S+)$", out[3].text)
    assert d and d[1].replace("-", "") == c[3].replace(" ", "") and d[2].replace(" ", "") == d[3]


def test_key_decides(spark):
    texts = [f"{MAIL} 10.9.8.7"]
    assert run(spark, texts)[0].text == run(spark, texts)[0].text != run(spark, texts, "other")[0].text


def test_distinct_entities_stay_distinct(spark):
    names = [(f"m{a} {b}",) for a in "abcdefghij" for b in "klmnopqrstuvwxyz"] + [(f"f{x}{y}{z}",) for x in "abcdef" for y in "aeiou" for z in "bcdfgh"]
    df = spark.createDataFrame([("person", n) for (n,) in names] + [("ssn", f"{i:09d}") for i in range(500)] + [("ip", f"1.1.{i % 250}.{i // 250}") for i in range(500)], "kind string, name string")
    got = S.assign(df, "k", Scratch(spark, "t")).collect()
    assert len(got) == df.count() and len({(r.kind, r.surrogate.lower()) for r in got}) == len(got)
    taken = {(r.kind, r.name[1:] if r.kind == "person" else r.name) for r in got}
    assert not any((r.kind, r.surrogate.lower()) in taken for r in got)


def test_collisions_are_resolved(spark, monkeypatch):
    real = S._surrogate
    monkeypatch.setattr(S, "_surrogate", lambda kind, name, salt: F.lit("same") if salt == 0 else real(kind, name, salt))
    df = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(50)], "kind string, name string")
    got = S.assign(df, "k", Scratch(spark, "t")).collect()
    assert len({r.surrogate for r in got}) == 50 and sum(r.surrogate == "same" for r in got) == 1


def test_edges(spark):
    for df in (table(spark), clashing(spark)):
        out = S.pseudonymise(df, "k")
        assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == sorted((str(r[0]), r[1]) for r in rows() if r[1])
        assert out.count() == len(rows())
    assert S.pseudonymise(table(spark, []), "k").count() == 0
    own = [(7, f"x {MAIL} y", None, None, None)] * 3 + [(7, MAIL * 1, None, None, None), (None, "z" * 10_000 + f" {MAIL}", None, None, None)]
    out = S.pseudonymise(table(spark, own), "k").collect()
    assert len(out) == 5 and len({re.search(r"\S+@\S+", r.text)[0] for r in out}) == 1 and all(r.n_entities == 1 for r in out)


SCRIPT_OF = {s: regex.compile(rf"(?=\p{{L}})\p{{Script={s}}}") for s in ["Latin", *S.SCRIPTS]}


def model(texts, key):
    """Plain Python: mentions by the same patterns, entities, proposals round after round, texts."""
    kinds = {k: regex.compile(f"(?:{p})") for k, p in S.KINDS.items()}
    kind_of = lambda hit: next(k for k, p in kinds.items() if p.fullmatch(hit))
    strip = lambda hit: regex.sub(S.TITLE, "", hit, count=1)
    own = lambda hit: regex.sub(S.COUNTRY, "", hit)

    def canonical(kind, hit):
        if kind in S.DIGITS:
            return regex.sub(r"\D", "", own(hit))
        if kind == "person":
            return ("f" if regex.match(S.TITLE, hit)[1].rstrip(".") in S.FEMALE else "m") + strip(hit).lower()
        return hit.replace(" ", "") if kind == "iban" else hit.lower()

    def proposal(kind, name, salt):
        h = hashlib.sha512(f"{key}|{kind}|{name}|{salt}".encode()).hexdigest()
        byte = lambda i: int(h[i % 64 * 2 : i % 64 * 2 + 2], 16)
        digits = lambda n: (h * 8).translate(str.maketrans("abcdef", "135792"))[:n]
        more = max(0, salt - S.FIXED + 1)
        letters = h.translate(str.maketrans("0123456789", "ghijklmnop"))[:more]

        def shaped(text, skip=0):
            out = ""
            for i, c in enumerate(text):
                new = c
                if i >= skip and c in "0123456789":
                    new = "0123456789"[byte(i) % 10]
                elif i >= skip:
                    for s, p in SCRIPT_OF.items():
                        if p.fullmatch(c):
                            a = S.SCRIPTS.get(s, S.LATIN)
                            new = a[byte(i) % len(a)]
                            break
                    new = new.upper() if c != c.lower() else new
                out += new
            return out

        if kind in S.DIGITS:
            return digits(len(name)) + digits(more)
        if kind == "ip":
            six = ":".join(["2001:db8"] + [h[4 * i : 4 * i + 4] for i in range(6)])
            return six if ":" in name or salt >= S.FIXED else f"{byte(3) % 223 + 1}.{byte(0)}.{byte(1)}.{byte(2)}"
        if kind == "iban":
            return shaped(name, 2) + digits(more)
        if kind == "email":
            local, host = name.rsplit("@", 1)
            labels = [x for x in host.rsplit(".", 1)[0].split(".") if x]
            return shaped(local) + letters + "@" + ".".join("host" + h[i % 16 * 4 + 64 :][:4] for i, _ in enumerate(labels)) + ".example"
        script = next((s for s in ("Cyrillic", "Greek") if any(SCRIPT_OF[s].fullmatch(c) for c in name[1:])), "Latin")
        family = "".join(S.FAMILY[script][byte(i) % 16] for i in range(1, 4 + salt // 2)).capitalize()
        given = S.GIVEN[name[0] + script]
        return f"{given[byte(0) % len(given)]} {family}" if " " in name else family

    any_kind = regex.compile(S.ANY)
    entities = {(kind_of(m[0]), canonical(kind_of(m[0]), m[0])) for t in texts for m in any_kind.finditer(t)}
    taken = {(k, n[1:] if k == "person" else n) for k, n in entities}
    done, rest, salt = {}, entities, 0
    while rest:
        free = {}
        for kind, name in sorted(rest):
            new = proposal(kind, name, salt)
            if (kind, new.lower()) not in taken:
                free.setdefault((kind, new.lower()), ((kind, name), new))
        done |= dict(free.values())
        taken |= set(free)
        rest, salt = rest - set(done), salt + 1

    def put(m):
        hit = m[0]
        kind = kind_of(hit)
        new = done[kind, canonical(kind, hit)]
        if kind in S.DIGITS or kind == "iban":
            code = (regex.match(S.COUNTRY, hit) or [""])[0] if kind in S.DIGITS else ""
            left = iter(new)
            body = "".join(next(left) if (c.isdigit() if kind in S.DIGITS else c != " ") else c for c in hit[len(code) :])
            return code + body + "".join(left)
        if kind == "person":
            return regex.match(S.TITLE, hit)[1] + " " + new
        return new.upper() if kind == "email" and hit == hit.upper() != hit.lower() else new

    return [any_kind.sub(put, t) for t in texts]


def test_brute_force(spark, monkeypatch):
    r = random.Random(5)
    name = lambda: r.choice(["John", "Ann", "Li", "O'Neil", "Müller-Lüdenscheid", "Анна", "Петров", "Γιώργος", "Παπαδόπουλος"])
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    some = [
        lambda: f"{r.choice(['Mr', 'Mrs.', 'Herr', 'Frau', 'Madame', 'Sr.', 'Госпожа', 'Господин'])} {name()}" + r.choice(["", f" {name()}"]),
        lambda: f"{r.choice(['a', 'b.c', 'Ann_7', 'ИВАН', '李明', 'محمد', 'ΝΙΚΟΣ', 'x+y'])}@{r.choice(['mail', 'a.b', 'ex-1'])}.{r.choice(['org', 'COM'])}",
        lambda: f"10.{r.randrange(3)}.0.{r.randrange(3)}", lambda: "2001:db8::" + r.choice(["1", "2:3"]), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: r.choice(["4111 1111 1111 1111", "3782 822463 10005", "4111-1111-1111-1111"]), lambda: r.choice(["+49 30 1234567", "+33 6 12 34 56 78", "01 23 45 67 89", "030 1234567", "(017) 555-7713", "+44 20 7946 0958"]),
        lambda: r.choice(["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "FR7630006000011234567890189"]), lambda: r.choice(["plain words", "v1.2.3", "12:30", "é𝒳"]),
    ]
    texts = [r.choice([" ", "\n", ", "]).join(r.choice(some)() for _ in range(r.randrange(1, 8))) + "." for _ in range(300)]
    want = model(texts, "k")
    got = run(spark, texts)
    assert [got[i].text for i in range(len(texts))] == want and sum(a != b for a, b in zip(texts, want, strict=True)) > 200
    assert sum(c not in LATIN_TEXT for t in want for c in t) > 50


LATIN_TEXT = set(map(chr, range(0x250)))


def test_names_never_run_out(spark):
    """All nine-digit-like numbers of two digits and all short names: surrogates get longer, but stay distinct."""
    many = [("ssn", f"{i:02d}") for i in range(100)] + [("email", f"{a}@x.org") for a in "abcdefgh"] + [("ip", f"9.9.9.{i}") for i in range(9)]
    df = spark.createDataFrame(many, "kind string, name string")
    got = S.assign(df, "k", Scratch(spark, "t")).collect()
    assert len(got) == len(many) == len({(r.kind, r.surrogate) for r in got}) and not {r.surrogate for r in got} & {n for _, n in many}


def test_scripts_are_kept(spark):
    texts = ["李明@mail.org 山田@mail.org", "محمد@mail.org", "דוד@mail.org", "नमन@mail.org", "Mr. Γιώργος Παπαδόπουλος", "Mr Արամ Հակոբյան", "민준@mail.org"]
    out = run(spark, texts)
    for i, t in enumerate(texts):
        scripts = lambda x: {s for s, p in SCRIPT_OF.items() if any(p.fullmatch(c) for c in regex.sub(r"@\S+|Mr\.?", "", x))}
        assert out[i].text != t and scripts(out[i].text) == scripts(t), out[i].text


def test_long_runs_take_linear_time(spark):
    import time

    n = 2_000_000
    texts = ["a" * n + " 1", "A" * n + " 1", "a1." * (n // 3) + " 1", "a" * n + f" {MAIL}", ("Mr " + "A" * 50 + " ") * 1000 + "@", "1" * n]
    began = time.time()
    out = run(spark, texts)
    assert time.time() - began < 150
    assert [out[i].text == texts[i] for i in range(3)] == [True] * 3 and out[3].n_entities == 1 and out[3].text.startswith("a" * n + " ") and MAIL not in out[3].text


def test_mentions_side_by_side(spark):
    out = run(spark, ["(030) 555-1234a@b.org", "x 10.1.2.3a@b.org, c.@d.org", "fe80::1 and 12:30:45"])
    assert "a@b.org" not in out[0].text and out[0].n_entities == 2 and out[1].text.endswith(", c.@d.org") and out[2].n_entities == 1 and out[2].text.endswith(" and 12:30:45")


def test_one_number_in_two_formats(spark):
    texts = ["call +49 30 1234567 or +49301234567", "+1 212 555 0147", "+44 212 555 0147", "+351 21 123 4567, +351211234567"]
    out = run(spark, texts)
    a = re.fullmatch(r"call \+49 (\d\d) (\d{7}) or \+49(\d{9})", out[0].text)
    assert a and a[1] + a[2] == a[3] != "301234567"
    b = re.fullmatch(r"\+351 (\d\d) (\d{3}) (\d{4}), \+351(\d{9})", out[3].text)
    assert b and b[1] + b[2] + b[3] == b[4]
    assert out[1].text.startswith("+1 ") and out[2].text.startswith("+44 ") and out[1].text != out[2].text
