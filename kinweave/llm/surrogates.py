"""PII surrogates: detected entities get keyed replacements of their own type, with DataFrame functions only.

Kinds: e-mail, IPv4, phone, card, social security number, and names: a known given name (in any case, single or hyphenated) with a surname, or what
follows a form of address (Mr, Dr, Frau, Mme, Sra ...). Each entity has a
canonical form (letter case, separators, a phone number's country code and trunk zero left out) and its surrogate follows from a keyed hash of kind and canonical
form, so that mentions of one entity stay one entity in all documents, and is written in the form of each mention. Letters become letters of the same script and
case, digits digits; a card keeps its first digit and a valid check digit, a phone number its country code. Given names
become names of the same gender and script by a keyed permutation of each list in which no name stays; surnames, and given names that no list has,
are made of syllables of their script, with a feminine ending where the mention has one; each part is keyed by itself, so relatives still share a surname.

Collisions: of canonical forms that got one surrogate the smallest keeps it, and the others and those whose surrogate
is itself an entity of the corpus are hashed again with the next attempt, until all are distinct. Every GROW attempts surrogates get longer, so there are always enough.

Defined cases: a null text stays null, an empty one empty, with no entities. Repeated rows give repeated rows. Overlaps go to the leftmost, then
the kind listed first. Patterns repeat single characters only, which Java matches without recursion, so a text may be of any length. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_one, table

#: Given names by script and gender.
GIVEN = {
    "Latin": {"f": ("Mary", "Linda", "Susan", "Karen", "Nancy", "Helen", "Ursula", "Greta", "Ingrid", "Claire", "Sophie", "Camille", "Carmen", "Lucia", "Elena"), "m": ("James", "Robert", "Michael", "William", "David", "Thomas", "Heinrich", "Jürgen", "Wolfgang", "Pierre", "Jacques", "Louis", "Carlos", "Miguel", "Javier")},
    "Cyrillic": {"f": ("Мария", "Анна", "Ольга", "Елена", "Татьяна", "Ирина", "Наталья"), "m": ("Иван", "Пётр", "Сергей", "Николай", "Дмитрий", "Алексей", "Андрей")},
}
SYLLABLES = {"Latin": ("bar", "cor", "del", "fen", "gar", "hol", "ker", "lan", "mor", "nel", "par", "rud", "sel", "tor", "val", "wen"), "Cyrillic": ("бар", "вол", "гор", "дан", "зим", "кал", "лад", "мор", "ник", "пол", "род", "сав", "тим", "фад", "чер", "шал")}
#: Forms of address that a name follows, by the gender that they tell.
ADDRESS = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Lady", "Herr", "Frau", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Señor", "Señora", "Señorita", "Sr", "Sra", "Don", "Doña", "господин", "госпожа")
#: Country calling codes of one and of two digits; all others have three.
CODES = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_GIVEN = [n for genders in GIVEN.values() for names in genders.values() for n in names]
_NAMES = "|".join(x for n in _GIVEN for x in (n, n.upper()))
_PART = r"\p{Lu}[\p{L}\p{M}'’]++"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]*\.[A-Za-z]{2,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9])0[0-9]{2,4}[ /-][0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,2}(?![0-9])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}-])(?:{_NAMES})(?:-{_PART})?+(?: {_PART}(?:-{_PART})?+)(?![\p{{L}}])|(?=\p{{Lu}})(?<=(?<![\p{{L}}])(?:{'|'.join(ADDRESS)})\.? ){_PART}(?:-{_PART})?+(?: {_PART}(?:-{_PART})?+)?+",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A cheap test that every text with an entity passes.
HINT = rf"@|[0-9]{{3}}|[+][0-9]|(?:[0-9]\.[0-9]{{1,3}}\.[0-9])|(?:{_NAMES})[ -]|(?:{'|'.join(ADDRESS)})\.? \p{{Lu}}"
#: Attempts after which a surrogate gets longer.
GROW = 8


def kind_of(surface: Column) -> Column:
    out = F.lit("name")
    for kind in ("phone", "card", "ip", "ssn", "email"):
        out = F.when(surface.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _digits(surface: Column) -> Column:
    return F.regexp_replace(surface, "[^0-9]", "")


def canonical(kind: Column, surface: Column) -> Column:
    """The same for all forms of one entity; of a phone number the national digits."""
    abroad = F.regexp_replace(_digits(surface), f"^(?:{CODES}|[0-9]{{3}})", "")
    phone = F.when(surface.startswith("+"), abroad).otherwise(F.regexp_replace(_digits(surface), "^0+", ""))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(surface)).when(kind == "email", F.lower(surface)).otherwise(surface)


def _stream(seed: Column) -> Column:
    """256 hex digits that follow from the seed."""
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)])


def _number(stream: Column, i: Column) -> Column:
    """The i-th number from 0 to 4095 of a stream; a longer text goes round."""
    return F.conv(F.substr(stream, F.pmod(i, F.lit(85)) * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _once(value: Column, f) -> Column:
    """f of the value, which is worked out once and not for each character."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _alike(text: Column, stream: Column) -> Column:
    """Digits for digits, letters for letters."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def all_of(known: Column) -> Column:
        swap = lambda c, i: F.when(c.rlike("[0-9]"), F.substr(F.lit(digits), _number(known, i) % 10 + 1, F.lit(1))).when(c.rlike("[a-z]"), F.substr(F.lit(letters), _number(known, i) % 26 + 1, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(text, ""), swap), "")

    return _once(stream, all_of)


def _luhn(first: Column) -> Column:
    """The check digit that completes 15 digits."""
    value = lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(first, ""), value), F.lit(0), lambda a, x: a + x)
    return F.concat(first, F.pmod(-total, F.lit(10)).cast("string"))


def given_names(key: str) -> dict[str, str]:
    """Each given name's surrogate: the next of its list in an order that the key decides, so all differ and none is itself."""
    out = {}
    for genders in GIVEN.values():
        for names in genders.values():
            order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).hexdigest())
            out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _made(form: Column, stream: Column, extra: Column) -> Column:
    """A name of syllables, five and what the attempts add; Russian surnames end as such."""
    made = lambda script: _once(stream, lambda known: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), extra + 4), lambda i: F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[script]]), _number(known, i) % 16 + 1)), "")))
    return F.when(form.rlike("[\\x{0400}-\\x{04FF}]"), F.concat(made("Cyrillic"), F.regexp_extract(form, "(?:ов|ев|ин|ский)$", 0))).otherwise(made("Latin"))


def replacement(kind: Column, form: Column, key: str, attempt: Column) -> Column:
    """Surrogate of a canonical form. `given` and `family` are parts of a name, in lower case."""
    stream, extra = _stream(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string"))), F.floor(attempt / GROW).cast("int")
    more = F.repeat(F.lit("0"), extra)  # digits that a longer surrogate adds
    # a domain has its own key, so one domain stays one domain, but a further attempt changes the local part only
    domain = F.regexp_extract(form, "@(.*)$", 1)
    host, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    email = F.concat(_alike(F.concat(F.regexp_extract(form, "^([^@]*)@", 1), more), stream), F.lit("@"), _alike(host, _stream(F.concat(F.lit(key + "|domain|"), domain))), top)
    ip = F.concat_ws(".", *[(_number(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    card = _luhn(F.concat(F.substring(form, 1, 1), _alike(F.concat(F.substring(form, 2, 14), more), stream)))
    given = F.initcap(F.element_at(F.create_map(*[F.lit(n) for a, b in given_names(key).items() for n in (a.lower(), b)]), form))
    return (
        F.when(kind == "email", email).when(kind == "ip", F.concat(ip, F.when(extra > 0, F.concat(F.lit("."), extra.cast("string"))).otherwise(""))).when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), _alike(F.concat(form, more), stream)).when(kind == "given", F.coalesce(given, _made(form, stream, extra))).otherwise(_made(form, stream, extra))
    )


def surrogates(forms: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """forms has distinct kind and form; adds surrogate, distinct within a kind (listed given names by permutation, the others by rounds)."""
    forms = scratch.keep(forms.withColumn("attempt", F.lit(0)), "forms")
    listed = (F.col("kind") == "given") & F.col("form").isin([n.lower() for n in _GIVEN])
    done = forms.where(listed).select("kind", "form", replacement(F.col("kind"), F.col("form"), key, F.col("attempt")).alias("surrogate"))
    done, pending = scratch.keep(done, "listed"), forms.where(~listed)
    while pending.limit(1).count():
        tried = scratch.keep(pending.withColumn("surrogate", replacement(F.col("kind"), F.col("form"), key, F.col("attempt"))), "tried").withColumn("low", F.lower("surrogate"))
        taken = forms.select("kind", F.col("form").alias("low")).unionByName(done.select("kind", F.lower("surrogate").alias("low")))
        firsts = tried.join(taken, ["kind", "low"], "left_anti").groupBy("kind", "low").agg(F.min(F.struct("form", "surrogate")).alias("f"))
        good = scratch.keep(firsts.select("kind", "f.form", "f.surrogate"), "good")
        done = done.unionByName(good)
        pending = scratch.keep(tried.select("kind", "form", "attempt").join(good, ["kind", "form"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "pending")
    return done


def _shaped(kind: Column, surface: Column, form: Column, surrogate: Column) -> Column:
    """The surrogate in the form of a mention: its separators, its letter case, a phone number's digits before the national ones."""
    before = F.when(kind == "phone", F.substr(_digits(surface), F.lit(1), F.length(_digits(surface)) - F.length(form))).otherwise("")
    digits = F.concat(before, surrogate)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    chars = F.split(surface, "")
    put = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substr(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    filled = F.aggregate(chars, start, put, lambda a: F.concat(a["out"], F.substr(digits, a["at"], F.length(digits))))
    cased = _once(chars, lambda old: F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.get(old, i).rlike("[A-Z]"), F.upper(c)).otherwise(c)), ""))
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(kind == "email", cased).otherwise(surrogate)


def _parts(name: Column) -> Column:
    """The parts of a name: kind (given or family), form (lower case, a Russian surname's masculine one), ending, capitals or not, separator before it."""
    words = F.split(name, "(?<=[ -])|(?=[ -])")
    pieces = F.filter(words, lambda w: ~w.isin(" ", "-"))
    first = F.array_position(words, " ")
    listed = [n.lower() for n in _GIVEN]

    def part(w: Column, i: Column) -> Column:
        low = F.lower(w)
        # the last blank-separated word is the surname; what stands before it are given names
        given = (first > 0) & (2 * i + 1 < first) | ((first == 0) & low.isin(listed))
        woman = ~given & low.rlike("(?:ов|ев|ин|ск)(?:а|ая)$")
        man = F.when(low.endswith("ая"), F.regexp_replace(low, "ая$", "ий")).otherwise(F.regexp_replace(low, "а$", ""))
        return F.struct(
            F.when(given, "given").otherwise("family").alias("kind"), F.when(woman, man).otherwise(low).alias("form"), woman.alias("woman"),
            ((w == F.upper(w)) & (F.length(w) > 1)).alias("capitals"), F.when(i == 0, "").otherwise(F.get(words, 2 * i - 1)).alias("sep"),
        )

    return F.transform(pieces, part)


def replace_pii(docs: DataFrame, key: str, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_entities and text with surrogates of every row of docs (doc_id and text); whoever knows the key can tell the originals."""
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    # the texts are searched once, and rows numbered as they are written
    docs = scratch.keep(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.coalesce(found, F.array().cast("array<string>")).alias("found")), "found")
    some = docs.where(F.size("found") > 0)
    mentions = some.select("row", F.posexplode("found").alias("pos", "surface")).distinct().withColumn("kind", kind_of(F.col("surface"))).withColumn("form", canonical(F.col("kind"), F.col("surface")))
    mentions = scratch.keep(mentions, "mentions")
    people = scratch.keep(mentions.where("kind = 'name'").select("row", "pos", F.posexplode(_parts(F.col("surface"))).alias("nth", "p")).select("row", "pos", "nth", "p.*"), "people")
    plain = mentions.where("kind <> 'name'")
    known = scratch.keep(surrogates(plain.select("kind", "form").unionByName(people.select("kind", "form")).distinct(), scratch, key), "known").withColumn("k", F.struct("kind", "form")).select("k", "surrogate")
    plain = join_one(scratch.keep(plain.withColumn("k", F.struct("kind", "form")), "plain"), known, "k", scratch)
    plain = plain.select("row", "pos", _shaped(F.col("kind"), F.col("surface"), F.col("form"), F.col("surrogate")).alias("new"))
    named = join_one(people.withColumn("k", F.struct("kind", "form")), known, "k", scratch)
    ending = F.when(~F.col("woman"), F.col("surrogate")).when(F.col("surrogate").endswith("ий"), F.regexp_replace("surrogate", "ий$", "ая")).otherwise(F.concat("surrogate", F.lit("а")))
    spelt = F.concat("sep", F.when(F.col("capitals"), F.upper(ending)).otherwise(ending))
    named = named.groupBy("row", "pos").agg(F.array_sort(F.collect_list(F.struct("nth", spelt.alias("s")))).alias("ps")).select("row", "pos", F.array_join(F.col("ps.s"), "").alias("new"))
    new = plain.unionByName(named).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("news"))
    pieces = F.flatten(F.transform(F.split("text", ENTITY, -1), lambda p, i: F.array(p, F.coalesce(F.get("news", i)["new"], F.lit("")))))
    changed = some.join(new, "row").select("doc_id", F.size("found").cast("long").alias("n_entities"), F.array_join(pieces, "").alias("text"))
    return docs.where(F.size("found") == 0).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text").unionByName(changed)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """With the key of spark.kinweave.pii.key, where it is set; else with one that is drawn for this run and forgotten."""
    return replace_pii(table(spark, sf_dir, "documents"), spark.conf.get("spark.kinweave.pii.key", None) or secrets.token_hex(32))
