"""Surrogates for personal data, by native operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blank, hidden, known_id, shown

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: What a mention may look like; of two kinds at one place the first named is taken.
KINDS = {
    # tried once for each run of such characters: where it begins, or right after another mention
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]*[\p{L}\p{N}]@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)|(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,5}})(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3}[ .-]\d{3,4}(?!\d)|\+\d{8,14}(?!\d)"
    r"|\+(?=(?:[ .()-]{0,2}\d){8,15}(?![ .-]?\d))\d{1,3}(?:[ .-]\(?\d{1,8}\)?){2,6}(?!\d)|(?<!\d)0\d(?:[ .]\d{2}){4}(?!\d)|(?<!\d)0\d{2,4}[ /]\d{6,8}(?!\d)",
    "person": r"(?<!\p{L})(?:Mrs|Mr|Ms|Miss|Herrn|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Госпожа|Господин)\.? \p{Lu}[\p{L}'-]*\p{L}(?: \p{Lu}[\p{L}'-]*\p{L})?",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Titles, given names and family name syllables.
TITLE = r"^(\p{L}+\.?) "
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
GIVEN = {
    "fLatin": ["Anna", "Clara", "Emma", "Ines", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Teresa", "Vera"],
    "mLatin": ["Adrian", "Bruno", "Daniel", "Emil", "Felix", "Hugo", "Julian", "Leo", "Martin", "Oscar", "Simon", "Victor"],
    "fGreek": ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Νίκη", "Σοφία"],
    "mGreek": ["Αντώνης", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Στέλιος"],
    "fCyrillic": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    "mCyrillic": ["Андрей", "Борис", "Виктор", "Глеб", "Иван", "Лев", "Олег", "Павел"],
}
FAMILY = {
    "Latin": ["ba", "cor", "del", "fen", "gal", "har", "jo", "kel", "lin", "mar", "nor", "per", "ral", "sen", "tor", "vel"],
    "Greek": ["βα", "γερ", "δελ", "ζαν", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ραλ", "σελ", "ταν", "φωτ", "χαρ", "ψαλ"],
    "Cyrillic": ["ба", "вел", "гор", "дан", "зор", "кал", "лин", "мар", "нов", "пер", "рад", "сол", "тар", "фед", "хар", "шел"],
}
#: Letters that stand for others of their script.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփք",
    "Georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    "Thai": "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてと",
    "Katakana": "アイウエオカキクケコサシスセソタチツテト",
    "Hangul": "가나다라마바사아자차카타파하",
    "Han": "的一是不了人我在有他中大来上国个到说们为",
}
DIGITS = ("ssn", "card", "phone")
#: Rounds of proposals before the surrogates of numbers and addresses get longer than what they stand for.
FIXED = 6
#: A number's country code (one, two or three digits), which stays and isn't part of its identity, be it set apart or not.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _kind(hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(KINDS.items()):
        # what stands around a mention is tested in the text; alone, the mention must match as a whole
        out = F.when(hit.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def canonical(kind: Column, hit: Column) -> Column:
    """What all mentions of one entity have in common: the digits of numbers, lower case, a person's gender and name."""
    person = F.concat(F.when(F.rtrim(F.regexp_extract(hit, TITLE, 1), F.lit(".")).isin(FEMALE), "f").otherwise("m"), F.lower(F.regexp_replace(hit, TITLE, "")))
    return F.when(kind.isin(*DIGITS), F.regexp_replace(F.regexp_replace(hit, COUNTRY, ""), r"\D", "")).when(kind == "person", person).when(kind == "iban", F.replace(hit, F.lit(" "))).otherwise(F.lower(hit))


def _byte(i: Column) -> Column:
    """Byte i of the keyed stream, which starts again after 64."""
    return F.conv(F.substr(F.col("__hex"), (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (_byte(i) % len(options) + 1).cast("int"))


def _shaped(text: Column, skip: int = 0) -> Column:
    """Each letter and digit replaced by one of its script and case; the first `skip` characters stay, and so do letters
    of scripts that SCRIPTS doesn't have."""

    def one(c: Column, i: Column) -> Column:
        letter = lambda a: F.substr(F.lit(a), _byte(i) % len(a) + 1, F.lit(1))
        new = F.when(c.rlike(r"^\d$"), letter("0123456789")).when(c.rlike(r"^\p{IsLatin}$"), letter(LATIN))
        for script, letters in SCRIPTS.items():
            new = new.when(c.rlike(rf"^(?=\p{{L}})\p{{Is{script}}}$"), letter(letters))
        new = new.otherwise(c)
        return F.when(i < skip, c).otherwise(F.when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _longer(salt: int, letters: bool) -> Column:
    """What is added to a surrogate when proposals of its own length have collided FIXED times: one character more with each
    salt, so that distinct surrogates never run out."""
    n = max(0, salt - FIXED + 1)
    return F.substr(F.translate(F.repeat("__hex", 1 + n // 64), *(("0123456789", "ghijklmnop") if letters else ("abcdef", "135792"))), F.lit(1), F.lit(n))


def _surrogate(kind: Column, name: Column, salt: int) -> Column:
    """From the keyed stream __hex. Numbers keep their length, addresses their form, persons gender and script.
    All get longer with the salt, names soon and others late, so that there are always enough of them."""
    digits = F.concat(F.substr(F.translate(F.repeat(F.col("__hex"), 8), "abcdef", "135792"), F.lit(1), F.length(name)), _longer(salt, False))
    octet = lambda i: _byte(F.lit(i)).cast("string")
    group = lambda i: F.substr(F.col("__hex"), F.lit(4 * i + 1), F.lit(4))
    six = F.concat_ws(":", F.lit("2001:db8"), *map(group, range(6)))
    four = F.concat_ws(".", (_byte(F.lit(3)) % 223 + 1).cast("string"), octet(0), octet(1), octet(2))
    ip = six if salt >= FIXED else F.when(name.contains(":"), six).otherwise(four)
    host = F.array_join(F.transform(F.filter(F.split(F.regexp_extract(name, r"@(.*)\.", 1), r"\."), lambda x: x != ""), lambda x, i: F.concat(F.lit("host"), F.substr(F.col("__hex"), i % 16 * 4 + 65, F.lit(4)))), ".")
    email = F.concat(_shaped(F.regexp_extract(name, "^(.*)@", 1)), _longer(salt, True), F.lit("@"), host, F.lit(".example"))
    family = lambda s: F.initcap(F.concat(*[_pick(FAMILY[s], F.lit(i)) for i in range(1, 4 + salt // 2)]))
    female = F.substr(name, F.lit(1), F.lit(1)) == "f"
    person = lambda s: F.concat_ws(" ", F.when(female, _pick(GIVEN[f"f{s}"], F.lit(0))).otherwise(_pick(GIVEN[f"m{s}"], F.lit(0))) if s else None, family(s))
    alone = ~name.contains(" ")
    named = lambda s: F.when(alone, family(s)).otherwise(person(s))
    who = F.when(name.rlike(r"\p{IsCyrillic}"), named("Cyrillic")).when(name.rlike(r"\p{IsGreek}"), named("Greek")).when(name.rlike(r"^.\p{IsLatin}"), named("Latin"))
    who = who.otherwise(F.initcap(F.concat(_shaped(F.substr(name, F.lit(2))), _longer(salt, True))))
    return F.when(kind.isin(*DIGITS), digits).when(kind == "ip", ip).when(kind == "email", email).when(kind == "iban", F.concat(_shaped(name, 2), _longer(salt, False))).otherwise(who)


def _taken(kind: Column, name: Column) -> Column:
    """A person's name without its gender mark, so that surrogates are told from names in the texts."""
    return F.when(kind == "person", F.substr(name, F.lit(2))).otherwise(name)


def assign(entities: DataFrame, key: str, work: Scratch) -> DataFrame:
    """(kind, name, surrogate) for distinct entities (kind, name): no two of a kind share a surrogate, and none is
    an entity of the texts. Keyed proposals that collide are proposed again with the next salt; as they get longer, the
    rounds come to an end however many entities there are."""
    names = entities.select("kind", _taken(F.col("kind"), F.col("name")).alias("__low")).distinct()
    done, rest, salt = None, entities, 0
    while True:
        seed = F.concat_ws("|", F.lit(key), "kind", "name", F.lit(str(salt)))
        made = rest.withColumn("__hex", F.sha2(seed.cast("binary"), 512)).withColumn("surrogate", _surrogate(F.col("kind"), F.col("name"), salt)).drop("__hex")
        made = made.withColumn("__low", F.lower("surrogate"))
        free = made.join(names, ["kind", "__low"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.lower("surrogate").alias("__low")), ["kind", "__low"], "left_anti")
        first = free.groupBy("kind", "__low").agg(F.min(F.struct("name", "surrogate")).alias("x")).select("kind", "x.*")
        first = work.table(first)
        done = first if done is None else work.table(done.unionByName(first))
        rest = work.table(rest.join(first, ["kind", "name"], "left_anti"))
        salt += 1
        if rest.isEmpty():
            return done


def _put(kind: Column, hit: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format: digits poured into its separators, its title kept."""
    code, own = F.regexp_extract(hit, COUNTRY, 0), F.regexp_replace(hit, COUNTRY, "")
    digit = lambda c, i: F.when(c.rlike(r"^\d$"), F.substr(surrogate, F.length(F.regexp_replace(F.substr(own, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)
    poured = F.concat(code, F.array_join(F.transform(F.split(own, ""), digit), ""), F.substr(surrogate, F.length(F.regexp_replace(own, r"\D", "")) + 1))
    char = lambda c, i: F.when(c == " ", c).otherwise(F.substr(surrogate, F.length(F.replace(F.substr(hit, F.lit(1), i + 1), F.lit(" "))), F.lit(1)))
    spaced = F.concat(F.array_join(F.transform(F.split(hit, ""), char), ""), F.substr(surrogate, F.length(F.replace(hit, F.lit(" "))) + 1))
    upper = F.when((hit == F.upper(hit)) & (hit != F.lower(hit)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin(*DIGITS), poured).when(kind == "iban", spaced).when(kind == "person", F.concat(F.regexp_extract(hit, TITLE, 1), F.lit(" "), surrogate)).when(kind == "email", upper).otherwise(surrogate)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replaces e-mail, IP, account, card, social security and phone numbers and titled persons by surrogates.

    An entity has one surrogate wherever it stands (coreference), entities have different ones, and the key alone
    decides which, but for collisions. The texts between mentions stay as they are.

    Returns the columns of docs with text replaced, and n_entities and entity_kinds (kind:count, in order of kind),
    which replace columns of that name. A text of any length is read whole, but its mentions are one row each. Texts without mentions and null texts come back unchanged, rows that repeat
    are treated alike, null doc_ids are as others, an empty table gives an empty table.
    """
    work, docs = Scratch(docs.sparkSession, "surrogates"), hidden(docs)
    row = {"__id": known_id("doc_id"), "__t": F.xxhash64("text")}
    has = F.col("text").rlike(r"\d|@|(?<!\p{L})\p{Lu}\p{L}++\.? \p{Lu}") & F.col("text").rlike(ANY)
    pieces = F.arrays_zip(F.split("text", ANY, -1).alias("gap"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("hit"))
    parts = docs.filter(has).select(*[c.alias(n) for n, c in row.items()], F.posexplode(pieces).alias("__i", "__x"))
    parts = parts.select("__id", "__t", "__i", F.col("__x.gap").alias("gap"), F.col("__x.hit").alias("hit")).withColumn("kind", _kind(F.col("hit")))
    parts = work.table(parts.withColumn("name", canonical(F.col("kind"), F.col("hit"))))
    known = assign(work.table(parts.filter("kind is not null").select("kind", "name").distinct()), key, work)
    parts = parts.join(known, ["kind", "name"], "left")
    new = F.when(F.col("surrogate").isNotNull(), _put(F.col("kind"), F.col("hit"), F.col("surrogate"))).otherwise(blank("hit"))
    of = parts.groupBy("__id", "__t").agg(F.collect_set(F.struct(F.col("__i").alias("i"), F.concat("gap", new).alias("s"), "kind")).alias("__p"))
    text = F.array_join(F.transform(F.array_sort("__p"), lambda x: x["s"]), "")
    kinds = F.filter(F.transform("__p", lambda x: x["kind"]), lambda x: x.isNotNull())
    each = F.array_join(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.concat_ws(":", k, F.size(F.filter(kinds, lambda x: x == k)).cast("string"))), ",")
    of = of.select("__id", "__t", text.alias("__text"), F.size(kinds).cast("long").alias("__n"), each.alias("__kinds"))
    own = docs.withColumns(row)
    out = own.join(of, ["__id", "__t"], "left")
    out = out.withColumns({"text": F.coalesce("__text", "text"), "n_entities": F.coalesce("__n", F.lit(0).cast("long")), "entity_kinds": F.coalesce("__kinds", F.lit(""))})
    return shown(out.drop("__id", "__t", "__text", "__n", "__kinds"))


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="sparkloom")
    return out.select("doc_id", "n_entities", "entity_kinds", "text")
