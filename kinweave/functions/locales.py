"""Locales of names and places, base forms of surnames, and romanisation, as column expressions.

The word lists, letters and endings below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names

#: Parts of place names by locale, in the order of tests.
PLACES = (
    ("ru", "россия|russia|москва|moscow|санкт-петербург|st. petersburg|киев|kyiv|kiev|одесса|odessa|минск|minsk|харьков|kharkiv|баку|baku|тбилиси|tbilisi|ереван|yerevan|ташкент|tashkent|алма-ата|almaty|новосибирск|novosibirsk|екатеринбург|yekaterinburg|казань|kazan|нижний новгород|ростов|ростов-на-дону|воронеж|самара|омск|челябинск|уфа|пермь|волгоград|красноярск|саратов|тюмень|тула|иркутск|владивосток|хабаровск|краснодар|оренбург|рязань|пенза|липецк|астрахань|ярославль|барнаул|ульяновск|томск|кемерово|курск|владимир|калуга|смоленск|брянск|белгород|тверь|иваново|калининград|архангельск|мурманск|псков|новгород|вологда|чебоксары|сочи|ставрополь|imperio ruso|russian empire|российская империя|ссср|ussr"),
    ("uk", "україна|ukraine|украина|львів|lviv|львов|дніпро|dnipro|запоріжжя|zaporizhzhia|донецьк|donetsk|полтава|вінниця|чернігів|житомир|черкаси|суми|херсон|миколаїв|івано-франківськ|тернопіль|луцьк|рівне|хмельницький"),
    ("he", "ישראל|israel|израиль|jerusalem|ירושלים|tel aviv|תל אביב|haifa|חיפה|beer sheva|באר שבע|netanya|נתניה|ashdod|אשדוד|ramat gan|רמת גן|bnei brak|בני ברק|petah tikva|פתח תקווה|holon|חולון"),
    ("de", "germany|deutschland|германия|berlin|берлин|munich|münchen|мюнхен|hamburg|гамбург|frankfurt|франкфурт|cologne|köln|кёльн|stuttgart|штутгарт|düsseldorf|дюссельдорф|dortmund|дортмунд|essen|эссен|leipzig|лейпциг|bremen|бремен|dresden|дрезден|hannover|ганновер|nürnberg|нюрнберг"),
    ("pl", "poland|polska|польша|warsaw|warszawa|варшава|krakow|kraków|краков|łódź|лодзь|wrocław|вроцлав|poznań|познань|gdańsk|гданьск|szczecin|щецин|lublin|люблин"),
    ("be", "belarus|беларусь|белоруссия|brest|брест|гомель|gomel|гродно|grodno|могилёв|mogilev|витебск|vitebsk"),
    ("lt", "lithuania|lietuva|литва|vilnius|вильнюс|kaunas|каунас|klaipėda|клайпеда|šiauliai|panevėžys"),
    ("lv", "latvia|latvija|латвия|riga|рига|daugavpils|даугавпилс|liepāja|лиепая"),
    ("en", "usa|united states|сша|америка|america|new york|нью-йорк|los angeles|лос-анджелес|chicago|чикаго|houston|хьюстон|phoenix|philadelphia|san antonio|san diego|dallas|austin|jacksonville|san francisco|seattle|denver|boston|бостон|detroit|детройт|atlanta|атланта|miami|майами|washington|вашингтон|brooklyn|бруклин|queens|manhattan|манхэттен|bronx|бронкс|staten island|uk|united kingdom|великобритания|england|англия|london|лондон|manchester|манчестер|birmingham|бирмингем|liverpool|ливерпуль|glasgow|глазго|edinburgh|эдинбург|leeds|лидс|sheffield|bristol|cardiff"),
)
#: Letters that tell the locale of a Cyrillic or a Latin name, in the order of tests.
CYRILLIC_LETTERS = (("uk", "іїєґІЇЄҐ"), ("be", "ўЎ"))
LATIN_LETTERS = (("de", "äöüßÄÖÜ"), ("pl", "ąćęłńśźżĄĆĘŁŃŚŹŻ"), ("lt", "ėįųūĖĮŲŪ"), ("lv", "āēģīķļņĀĒĢĪĶĻŅ"), ("fr", "çœÇŒ"))
#: Endings of women's surnames and the men's for them, in the order of tests; alike where they don't change.
ENDINGS = (
    ("ская", "ский"), ("цкая", "цкий"), ("ная", "ный"), ("ая", "ий"), ("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ына", "ын"),
    ("енко", "енко"), ("ук", "ук"), ("юк", "юк"), ("ак", "ак"), ("як", "як"), ("ska", "ski"), ("cka", "cki"), ("dzka", "dzki"), ("na", "ny"),
    ("skaya", "skiy"), ("tskaya", "tskiy"), ("aya", "iy"), ("ova", "ov"), ("eva", "ev"), ("yova", "yov"), ("ina", "in"), ("yna", "yn"),
    ("enko", "enko"), ("uk", "uk"), ("yuk", "yuk"), ("ak", "ak"), ("yak", "yak"),
)
#: Surnames that look like women's forms and aren't.
UNCHANGED = "сковорода skovoroda кочерга kocherga лоза loza гроза groza сирота sirota шевченко shevchenko бондаренко bondarenko коваленко kovalenko ткаченко tkachenko savchenko савченко саакашвили saakashvili джугашвили dzhugashvili франко franko".split()
#: Latin letters for Cyrillic ones where a name is romanised for display.
ROMAN_SINGLE = dict(zip("абвгдезийклмнопрстуфыэіґ", "abvgdeziiklmnoprstufyeig", strict=True)) | {"й": "j"}
ROMAN_SEVERAL = {"ё": "jo", "ж": "zh", "х": "kh", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shh", "ю": "ju", "я": "ja", "ї": "ji", "є": "je", "ў": "u"}


def place_locale(place: Column) -> Column:
    """The locale that a place name tells; null if none does."""
    low, out = F.lower(place), F.lit(None).cast("string")
    for locale, parts in reversed(PLACES):
        out = F.when(low.rlike(parts.replace(".", r"\.")), locale).otherwise(out)
    return out


def _letters(name: Column, table: tuple, default: str) -> Column:
    out = F.lit(default)
    for locale, letters in reversed(table):
        out = F.when(name.rlike(f"[{letters}]"), locale).otherwise(out)
    return out


def cyrillic_locale(name: Column) -> Column:
    return _letters(name, CYRILLIC_LETTERS, "ru")


def latin_locale(name: Column) -> Column:
    return _letters(name, LATIN_LETTERS, "en")


def main_script(name: Column) -> Column:
    """The script of more than 80 % of the letters that have one, else Mixed; Unknown without any."""
    counts = {k: F.regexp_count(name, F.lit(p)) for k, p in names.SCRIPTS.items()}
    total, out = sum(counts.values(), F.lit(0)), F.lit("Mixed")
    for k, n in counts.items():
        out = F.when(n > 0.8 * total, k).otherwise(out)
    return F.when(name.isNull() | (total == 0), "Unknown").otherwise(out)


def script_locale(script: Column) -> Column:
    out = F.lit("unknown")
    for k, locale in (("Cyrillic", "ru"), ("Hebrew", "he"), ("Arabic", "ar"), ("Greek", "el"), ("Latin", "en")):
        out = F.when(script == k, locale).otherwise(out)
    return out


def surname_base(surname: Column) -> Column:
    """A surname's masculine form, its ending in the case that the surname's has; an empty text for a blank one."""
    trimmed = F.trim(surname)
    out = trimmed
    for woman, man in reversed(ENDINGS):
        stem, tail = F.substr(trimmed, F.lit(1), F.length(trimmed) - len(woman)), F.right(trimmed, F.lit(len(woman)))
        put = trimmed if woman == man else F.concat(stem, F.when(tail == F.upper(tail), man.upper()).otherwise(man))
        out = F.when(F.lower(trimmed).endswith(woman), put).otherwise(out)
    return F.when(surname.isNull() | (trimmed == ""), "").when(F.lower(trimmed).isin(UNCHANGED), trimmed).otherwise(out)


def same_surname(a: Column, b: Column) -> Column:
    return F.lower(surname_base(a)) == F.lower(surname_base(b))


def romanise(name: Column) -> Column:
    """Latin spelling for display: words and their parts after a hyphen keep their capitals."""
    out = name
    for letter, latin in ROMAN_SEVERAL.items():
        out = F.replace(F.replace(out, F.lit(letter), F.lit(latin)), F.lit(letter.upper()), F.lit(latin.capitalize()))
    ones = "".join(ROMAN_SINGLE)
    latin = "".join(ROMAN_SINGLE.values())
    return F.translate(out, ones + ones.upper() + names.SILENT + names.SILENT.upper(), latin + latin.upper())


def to_ascii(name: Column) -> Column:
    return names.remove_diacritics(romanise(name))


def is_basic_latin(name: Column) -> Column:
    return ~F.coalesce(name.rlike(r"[^\x00-\x7F]"), F.lit(False))


def needs_romanising(name: Column) -> Column:
    return F.length(name).isNotNull() & ~is_basic_latin(name)
