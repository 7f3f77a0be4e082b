"""Normalisation of multilingual names and addresses, as Column expressions that stay in the JVM.

Addresses map full state names to codes only; `saint` becomes `st` like `street`; codes may collide across countries
(ga, tn, co, ste). Those are properties of the vocabulary, kept for equal results.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: legal forms and their short forms
LEGAL = {
    "corporation": "corp", "incorporated": "inc", "company": "co", "limited": "ltd", "llc": "llc", "llp": "llp",
    "lp": "lp", "plc": "plc", "holdings": "hold", "group": "grp", "private": "pvt", "pvt": "pvt", "prvt": "pvt",
    "sarl": "sarl", "sas": "sas", "sasu": "sas", "eurl": "eurl", "snc": "snc", "societe": "ste", "ste": "ste",
    "gmbh": "gmbh", "ag": "ag", "bv": "bv", "nv": "nv",
}
# fixed values: street words and their short forms
STREET = {
    "road": "rd", "rd": "rd", "street": "st", "st": "st", "saint": "st", "avenue": "ave", "ave": "ave", "av": "ave",
    "boulevard": "blvd", "blvd": "blvd", "bd": "blvd", "lane": "ln", "ln": "ln", "drive": "dr", "dr": "dr",
    "court": "ct", "ct": "ct", "place": "pl", "pl": "pl", "square": "sq", "sq": "sq", "highway": "hwy", "hwy": "hwy",
    "parkway": "pkwy", "pkwy": "pkwy", "suite": "ste", "apartment": "apt", "apt": "apt", "floor": "flr",
    "marg": "marg", "nagar": "nagar", "colony": "colony", "sector": "sector", "cross": "cross", "main": "main",
    "phase": "phase", "block": "blk", "rue": "rue", "allee": "allee", "impasse": "imp", "chemin": "chem",
    "quai": "quai", "cours": "cours",
}
# fixed values: states of the United States and their codes
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}
# fixed values: states of India and their codes
INDIAN_STATES = {
    "tamil nadu": "tn", "tamilnadu": "tn", "karnataka": "ka", "kerala": "kl", "maharashtra": "mh", "gujarat": "gj",
    "rajasthan": "rj", "punjab": "pb", "haryana": "hr", "west bengal": "wb", "uttar pradesh": "up",
    "madhya pradesh": "mp", "andhra pradesh": "ap", "telangana": "tg", "bihar": "br", "odisha": "od", "orissa": "od",
    "assam": "as", "jharkhand": "jh", "chhattisgarh": "cg", "uttarakhand": "uk", "goa": "ga", "delhi": "dl",
    "new delhi": "dl",
}
STATES = US_STATES | INDIAN_STATES
# fixed values: words that are never a blocking token
STOPWORDS = "de la le du des les un une et aux au the of and at in on for near opp opposite no nos new old".split()
TOKENS = LEGAL | STREET


def states_longest_first() -> list[tuple[str, str]]:
    return sorted(STATES.items(), key=lambda kv: -len(kv[0]))


@cache
def _letters() -> tuple[str, str]:
    """Accented Latin letters and the plain letter each decomposes to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs += [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0x1E00, 0x1F00)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "ð": "d"}


# fixed values: letters of alphabets and what they are spelt with, signs included
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "iu",
    "я": "ia", "є": "ie", "і": "i", "ї": "yi", "ґ": "g",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r",
    "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
ARABIC = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z",
    "ع": "`", "غ": "g", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "پ": "p", "چ": "ch", "گ": "g",
}
#: The scripts that are spelt letter by letter: first and last code point.
SPELT = ((0x370, 0x6FF), (0x900, 0xD7F), (0x3040, 0x30FF))
_VOWELS = {"a", "aa", "i", "ii", "u", "uu", "e", "ee", "ai", "o", "oo", "au"}


def _spelling(c: str) -> str:
    """What a letter of SPELT is spelt with. Indic letters and kana go by their Unicode names: consonants without the vowel they
    bear by themselves, as signs spell it; marks without a sound by nothing."""
    for table in (CYRILLIC, GREEK, ARABIC):
        plain = unicodedata.normalize("NFD", c.lower())[0]
        sound = table.get(c.lower()) or table.get(plain)
        if sound is not None:
            return sound.capitalize() if c != c.lower() else sound
    name = unicodedata.name(c, "")
    if unicodedata.digit(c, None) is not None:
        return str(unicodedata.digit(c))
    for kind in (" LETTER ", " VOWEL SIGN ", " SIGN "):
        if kind in name and "CYRILLIC" not in name and "GREEK" not in name and "ARABIC" not in name:
            sound = name.rsplit(kind, 1)[1].lower().split()[-1]
            if kind == " SIGN ":
                return {"anusvara": "n", "candrabindu": "n", "chandrabindu": "n", "visarga": "h"}.get(sound, "")
            kana = "HIRAGANA" in name or "KATAKANA" in name
            return sound[:-1] if kind == " LETTER " and not kana and sound not in _VOWELS and sound.endswith("a") else sound
    return "" if unicodedata.category(c).startswith("M") else c


@cache
def _spellings() -> list[tuple[int, list[str]]]:
    return [(low, [_spelling(chr(c)) for c in range(low, high + 1)]) for low, high in SPELT]


@cache
def _syllables() -> tuple[list[str], list[str], list[str]]:
    """First, middle and last sounds of Hangul syllables, by the rule of their names."""
    name = lambda c: unicodedata.name(chr(c)).rsplit(" ", 1)[1].lower()
    middle = [name(0xAC00 + 11 * 588 + 28 * v) for v in range(21)]  # the eleventh first sound is silent
    first = [name(0xAC00 + 588 * i).removesuffix(middle[0]) for i in range(19)]
    last = [name(0xAC00 + 11 * 588 + i).removeprefix(middle[0]) for i in range(28)]
    return first, middle, last


def _spelt(c: Column) -> Column:
    """One character: looked up by its code point."""
    code = F.ascii(c)
    out = c
    for low, sounds in _spellings():
        out = F.when(code.between(low, low + len(sounds) - 1), F.get(F.array(*map(F.lit, sounds)), code - low)).otherwise(out)
    first, middle, last = (F.array(*map(F.lit, x)) for x in _syllables())
    at = code - 0xAC00
    syllable = F.concat(F.get(first, F.floor(at / 588).cast("int")), F.get(middle, F.floor(at % 588 / 28).cast("int")), F.get(last, at % 28))
    return F.when(code.between(0xAC00, 0xD7A3), syllable).otherwise(out)


def romanise(x: Column) -> Column:
    """Null becomes ''; ASCII stays as it is; accents are dropped, ligatures and letters of other alphabets spelt out.

    Spelt: Cyrillic, Greek, Arabic, the Indic scripts from Devanagari to Malayalam and Sinhala's neighbours, kana and
    Hangul. Han characters have no sound by rule and stay, so `basic_clean` drops them.
    """
    x = F.coalesce(x, F.lit(""))
    plain = F.translate(x, *_letters())
    for letter, letters in _LIGATURES.items():
        plain = F.replace(plain, F.lit(letter), F.lit(letters))
    ranges = "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in (*SPELT, (0xAC00, 0xD7A3)))
    spelt = F.array_join(F.transform(F.split(plain, ""), _spelt), "")
    full = F.when(plain.rlike(f"[{ranges}]"), spelt).otherwise(plain)
    return F.when(is_ascii(x), x).otherwise(F.regexp_replace(full, "\\p{M}+", ""))


def is_ascii(x: Column) -> Column:
    return x.rlike("\\A[\\x00-\\x7F]*\\z")


def basic_clean(x: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space to blanks, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9\\s]+", " "), "\\s+", " "))


def canon_tokens(x: Column) -> Column:
    known = F.create_map(*(F.lit(s) for pair in TOKENS.items() for s in pair))
    return F.array_join(F.transform(F.split(x, " "), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def canon_states(x: Column) -> Column:
    """Longest names first; texts without any state name, most of them, pass one test only."""
    out = x
    for name, code in states_longest_first():
        out = F.regexp_replace(out, f"\\b{name}\\b", code)
    return F.when(x.rlike(f"\\b({'|'.join(name for name, _ in states_longest_first())})\\b"), out).otherwise(x)


def normalize_name(x: Column) -> Column:
    return canon_tokens(basic_clean(romanise(x)))


def normalize_address(x: Column) -> Column:
    return canon_states(normalize_name(x))


def digit_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1))


def digit_signature(x: Column) -> Column:
    """All digit runs, sorted as text, joined by '-'."""
    return F.array_join(F.array_sort(digit_runs(x)), "-")


def house_number(x: Column) -> Column:
    return F.regexp_extract(x, "([0-9]+)", 1)


def postal_code(x: Column) -> Column:
    return F.regexp_extract(x, "\\b([0-9]{5,6})\\b", 1)


def first_alpha_token(x: Column, skip: dict | list) -> Column:
    left_out = F.array(*(F.lit(t) for t in sorted({*skip, *STOPWORDS})))
    good = F.filter(F.split(x, " "), lambda t: t.rlike("^[a-z]{2,}$") & ~F.array_contains(left_out, t))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def was_nonascii(x: Column) -> Column:
    return (~is_ascii(F.coalesce(x, F.lit("")))).cast("tinyint")


def strip_zeros(t: Column) -> Column:
    bare = F.ltrim(t, F.lit("0"))
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def digit_tokens(x: Column, k: int = 3) -> Column:
    """Up to k distinct zero-stripped digit runs other than '0', longest first, then by text."""
    runs = F.filter(F.array_distinct(F.transform(digit_runs(x), strip_zeros)), lambda t: t != "0")
    ordered = F.array_sort(F.transform(runs, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(ordered, lambda s: s["t"]), 1, k)


def alpha_tokens(x: Column) -> Column:
    """Distinct alphabetic words of three or more letters."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: t.rlike("^[a-z]{3,}$")))


def token_set(x: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(x, "\\s+", " "), " ")), "")


def add_normalized_columns(records: DataFrame, keep_raw: bool = True) -> DataFrame:
    """name_n, addr_n and what is derived from them; `records` has business_name and business_address."""
    out = records.withColumn("name_n", normalize_name(F.col("business_name"))).withColumn("addr_n", normalize_address(F.col("business_address")))
    out = out.withColumns(
        {
            "addr_digits": digit_signature(F.col("addr_n")),
            "addr_house": house_number(F.col("addr_n")),
            "addr_pin": postal_code(F.col("addr_n")),
            "addr_tok1": first_alpha_token(F.col("addr_n"), STREET),
            "name_tok1": first_alpha_token(F.col("name_n"), LEGAL),
            "was_nonascii": was_nonascii(F.col("business_name")),
        }
    )
    return out if keep_raw else out.drop("business_name", "business_address")


def text_extras(x: Column) -> dict[str, Column]:
    return {
        "n_chars_all": F.length(x), "n_space": F.regexp_count(x, F.lit("\\s")), "n_digit": F.regexp_count(x, F.lit("[0-9]")), "n_upper": F.regexp_count(x, F.lit("[A-Z]")),
    }


def url_filename(url: Column) -> Column:
    """The last part of a URL's path; '' if there is none."""
    return F.coalesce(F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), -1), F.lit(""))


def pair_text(name: Column, addr: Column, separator: str = " | ") -> Column:
    return F.concat(name, F.lit(separator), addr)
