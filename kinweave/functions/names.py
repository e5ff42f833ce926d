"""Name and identifier functions as column expressions; nothing here leaves the JVM.

Letter tables, endings, titles and scripts below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters whose Latin form is one letter, several letters, or nothing.
SINGLE = dict(zip("абвгдезийклмнопрстуфыэіґ", "abvgdeziyklmnoprstufyeig", strict=True))
SEVERAL = {"ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ї": "yi", "є": "ye"}
SILENT = "ъь"
#: Letters that don't decompose, and their plain forms.
PLAIN = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "þ": "th", "Þ": "TH", "đ": "dj", "Đ": "Dj"}
PLAIN_SINGLE = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "å": "a", "Å": "A", "ð": "d", "Ð": "D", "ı": "i", "İ": "I", "õ": "o", "Õ": "O"}
#: Code point ranges of scripts.
SCRIPTS = {
    "Latin": "[A-Za-z\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}]",
    "Cyrillic": "[\\x{0400}-\\x{052F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}]",
    "Hebrew": "[\\x{0590}-\\x{05FF}]",
    "Arabic": "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]",
    "Greek": "[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]",
}
#: Letters, endings and parts that tell a language.
LITHUANIAN = "[ąčęėįšųūž]|(auskas|aitis|ūnas|ėnas|onis|inis|ulis|ienė|ytė|aitė|utė|ūtė)$"
ESTONIAN = "õ|mäe|mägi|mets|saar|pere|nurm|vald|järv"
LATVIAN = "[āčēģīķļņšūž]|(iņš|āns|ēns)$"
POLISH = "[ąćęłńóśźż]"
GERMAN_PARTS = "müller|schmidt|schneider|fischer|meyer|weber|schäfer|köhler|böhm|günther|größ|weiß"
UKRAINIAN_ENDINGS = "(енко|ейко|ченко|шенко|чук|щук)$"


def transliterate(name: Column) -> Column:
    """Latin spelling of Cyrillic letters; other characters stay."""
    out = name
    for letter, latin in SEVERAL.items():
        out = F.replace(F.replace(out, F.lit(letter), F.lit(latin)), F.lit(letter.upper()), F.lit(latin.capitalize()))
    ones = "".join(SINGLE)
    return F.translate(out, ones + ones.upper() + SILENT + SILENT.upper(), "".join(SINGLE.values()) + "".join(SINGLE.values()).upper())


def normalize(name: Column) -> Column:
    """Transliterated, lower case, without hyphens, apostrophes, dots and blanks; null if nothing is left."""
    return F.nullif(F.translate(F.lower(transliterate(name)), "-'. ", ""), F.lit(""))


def comparison_form(name: Column) -> Column:
    """As normalize(), but blanks inside stay."""
    return F.trim(F.translate(F.lower(transliterate(name)), "-'.", ""))


def normalize_place(place: Column) -> Column:
    return F.trim(F.translate(F.replace(F.lower(place), F.lit("."), F.lit("")), "-", " "))


def gedcom_id(value: Column) -> Column:
    """@X1@ spelling; null if blank."""
    bare = F.regexp_replace(F.trim(value), "^@+|@+$", "")
    return F.when(F.length(bare) > 0, F.concat(F.lit("@"), bare, F.lit("@")))


def numeric_id(value: Column) -> Column:
    """The digits of @I1@, I1, geni:1, profile-1, profile-g1 or plain digits; null otherwise."""
    found = F.regexp_extract(F.trim(value), "(?i)^(?:@?I|geni:|profile-g?|g)?([0-9]+)@?$", 1)
    return F.nullif(found, F.lit(""))


def profile_id(value: Column) -> Column:
    """The bare id of a profile address or key; an empty text for null."""
    last = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^.*/", "")
    return F.regexp_replace(last, "(?i)^(profile-)?g?(?=[0-9]+$)|^profile-", "")


def is_guid(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9]{16,}$"), F.lit(False))


def once(value: Column, use) -> Column:
    """use(value) with the value taken once, however often use names it: plain expressions would be written out again at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def script(text: Column) -> Column:
    """The one script of the text's letters, Mixed or Unknown."""
    found = F.filter(F.array(*[F.when(text.rlike(p), k) for k, p in SCRIPTS.items()]), lambda k: k.isNotNull())
    return once(found, lambda f: F.when(F.size(f) == 0, "Unknown").when(F.size(f) == 1, F.get(f, F.lit(0))).otherwise("Mixed"))


def split_by_script(text: Column) -> Column:
    """struct(cyrillic, latin, hebrew): the words of each script, in order; null where there are none. A word of several scripts is split by its letters."""
    words = F.filter(F.split(text, r"[ /|()\[\]\\-]+"), lambda w: F.length(w) > 0)
    read = F.transform(words, lambda w: F.struct(w.alias("w"), (script(w) == "Mixed").alias("mixed")))

    def of(rows: Column, k: str) -> Column:
        own = F.transform(F.filter(rows, lambda r: r["w"].rlike(SCRIPTS[k])), lambda r: F.when(r["mixed"], F.regexp_replace(r["w"], f"(?!{SCRIPTS[k]}).", "")).otherwise(r["w"]))
        return F.nullif(F.array_join(own, " "), F.lit(""))

    return once(read, lambda rows: F.struct(*[of(rows, k).alias(k.lower()) for k in ("Cyrillic", "Latin", "Hebrew")]))


def contains(text: Column, script_: str) -> Column:
    return F.coalesce(text.rlike(SCRIPTS[script_]), F.lit(False))


def is_purely(text: Column, script_: str) -> Column:
    """Letters of that script and of no other."""
    return script(text) == script_


def is_ukrainian(text: Column) -> Column:
    return F.coalesce(text.rlike(SCRIPTS["Cyrillic"]) & (text.rlike("[іїєґІЇЄҐ]") | F.lower(text).rlike(UKRAINIAN_ENDINGS)), F.lit(False))


def latin_language(text: Column) -> Column:
    """lt, et, lv, pl, de or en, in this order of tests; null for a blank text."""
    low = F.lower(text)
    german = low.rlike("ß") | (low.rlike("[äöü]") & low.rlike(GERMAN_PARTS))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit(None).cast("string"))
        .when(low.rlike(LITHUANIAN), "lt").when(low.rlike(ESTONIAN), "et").when(low.rlike(LATVIAN), "lv").when(low.rlike(POLISH), "pl").when(german, "de").otherwise("en")
    )


def _decomposed() -> tuple[str, str]:
    """Letters below U+2000 that decompose to one ASCII letter and marks, from the Unicode tables."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.category(x) == "Mn" for x in d[1:]) and c not in PLAIN_SINGLE]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def remove_diacritics(text: Column) -> Column:
    out = text
    for letter, plain in PLAIN.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    letters, plain = _decomposed()
    return F.regexp_replace(F.translate(out, "".join(PLAIN_SINGLE) + letters, "".join(PLAIN_SINGLE.values()) + plain), "\\p{Mn}", "")


def clean_special(name: Column) -> Column:
    """Without edge marks, leading digits and characters that no name has; blanks squeezed."""
    out = F.regexp_replace(name, r"^[*?#~`^+=<>|\\/_]+|[*?#~`^+=<>|\\/_]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^[0-9]+\s*", ""), r"[\[\]{}@#$%^&*+=<>|\\~`]", "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def capitalize(name: Column) -> Column:
    """Words, and their parts after a hyphen or apostrophe, with a capital, where all letters are of one case."""
    letters = F.regexp_replace(name, r"[^\p{L}]", "")
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{M}0-9.]+|[^\p{L}\p{M}0-9.]+"), F.lit(0))
    fixed = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")
    one_case = (F.length(letters) > 0) & ((letters == F.upper(letters)) | (letters == F.lower(letters)))
    return F.when(one_case, fixed).otherwise(name)


def feminine(surname: Column) -> Column:
    """The feminine form of a Slavic surname in Cyrillic or Latin; others stay."""
    low, stem = F.lower(surname), lambda n: F.substr(surname, F.lit(1), F.length(surname) - n)
    return (
        F.when(low.rlike("(ко|ых|их|ko|ykh|ikh)$"), surname)
        .when(low.rlike("(ский|цкий)$"), F.concat(stem(2), F.lit("ая"))).when(low.rlike("ний$"), F.concat(stem(2), F.lit("яя"))).when(low.rlike("ий$"), F.concat(stem(2), F.lit("ая")))
        .when(low.rlike("(ов|ев|ёв|ин|ын)$"), F.concat(surname, F.lit("а")))
        .when(low.rlike("skiy$"), F.concat(stem(2), F.lit("aya"))).when(low.rlike("sky$"), F.concat(stem(1), F.lit("aya"))).when(low.rlike("iy$"), F.concat(stem(2), F.lit("aya")))
        .when(low.rlike("(ov|ev|yov|in|yn)$"), F.concat(surname, F.lit("a"))).otherwise(surname)
    )


def photo_source(url: Column) -> Column:
    """myheritage, geni or other, by the host and its parents."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.when(host.rlike(r"(^|\.)(myheritage\.com|myheritageimages\.com)$"), "myheritage").when(host.rlike(r"(^|\.)geni\.com$"), "geni").otherwise("other")
