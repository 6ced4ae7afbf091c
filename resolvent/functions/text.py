"""Text normalisation and key extraction as native Column expressions.

Every function takes a Column and returns a Column; none runs Python per row.
Accents are folded first, since ``\\w`` and ``\\b`` mean different things in
different engines beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
MISSING = ("none", "null", "nan", "")

# Legal forms, phrase to short form, in the order they apply.
LEGAL_FORMS = (
    ("private limited|pvt ltd|p ltd|private ltd", "pvt ltd"),
    ("limited|ltd", "ltd"),
    ("corporation|corp", "corp"),
    ("incorporated|inc", "inc"),
    ("limited liability company|llc", "llc"),
    ("limited liability partnership|llp", "llp"),
    ("company|co", "co"),
)
# Legal suffixes and their short forms.
LEGAL_SUFFIXES = {
    "incorporated": "inc", "corporation": "corp", "company": "co", "limited liability company": "llc", "limited": "ltd", "partnership": "ptnr",
    "general partnership": "gp", "limited partnership": "lp", "private limited": "pvt ltd", "private": "pvt", "limited liability partnership": "llp",
    "one person company": "opc", "proprietorship": "prop", "societe par actions simplifiee": "sas", "societe par actions simplifiee unipersonnelle": "sasu",
    "societe a responsabilite limitee": "sarl", "societe anonyme": "sa", "entreprise unipersonnelle a responsabilite limitee": "eurl",
    "societe civile immobiliere": "sci", "societe en nom collectif": "snc", "groupement d interet economique": "gie", "etablissement": "etbl",
}
# Address words and their short forms.
ADDRESS_SHORT = {"road": "rd", "street": "st", "avenue": "ave", "drive": "dr", "lane": "ln", "boulevard": "blvd", "apartment": "apt", "suite": "ste", "floor": "fl", "nr": "near"}
# Address abbreviations and their long forms.
ADDRESS_LONG = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "dr": "drive", "blvd": "boulevard", "bld": "boulevard", "ln": "lane", "ct": "court",
    "pkwy": "parkway", "apt": "apartment", "ste": "suite", "fl": "floor", "flr": "floor", "bldg": "building", "hwy": "highway", "expy": "expressway",
    "pl": "place", "sq": "square", "opp": "opposite", "nr": "near", "extn": "extension", "mkt": "market", "sec": "sector", "ph": "phase", "no": "number",
    "col": "colony", "chwk": "chowk", "ngr": "nagar", "lyt": "layout", "bzr": "bazaar", "r": "rue", "imp": "impasse", "all": "allee", "che": "chemin",
    "rte": "route", "res": "residence", "bat": "batiment", "zi": "zone industrielle", "za": "zone activite",
}
# Spelling variants of names.
NAME_ALIASES = {
    "laxmi": "lakshmi", "luxmi": "lakshmi", "shree": "sri", "shri": "sri", "chander": "chandra", "bhavan": "bhawan", "jewellers": "jewelers",
    "cloth": "textile", "medical": "pharma", "vidyalaya": "school", "vidyapith": "college", "kirana": "general store", "auto": "automobiles", "dresses": "fashion",
}
# State abbreviations and names.
STATES = {"ca": "california", "ny": "new york", "tx": "texas", "wa": "washington", "fl": "florida", "mh": "maharashtra", "ka": "karnataka", "tn": "tamil nadu", "dl": "delhi", "up": "uttar pradesh"}
DBA = "\\b(doing business as|d\\s*/?\\s*b\\s*/?\\s*a|trading as|t\\s*/?\\s*a|c\\s*/?\\s*o|care of|aka|a\\s*/?\\s*k\\s*/?\\s*a)\\b"
#: The same where a bare ``co`` or ``ta`` is a word.
DBA_STRICT = "\\b(doing business as|d\\s*/?\\s*b\\s*/?\\s*a|trading as|t\\s*/\\s*a|c\\s*/\\s*o|care of|aka|a\\s*/\\s*k\\s*/\\s*a)\\b"
DOMAIN = "(https?://)?(www\\.)?([a-zA-Z0-9\\-]+)\\.(com|org|net|in|fr|co|io|biz|info|store|shop|online)"
STOPWORDS = ("the", "and", "of", "for", "in", "de", "la", "le")


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def clean_missing(c: Column) -> Column:
    """Trimmed; null and the literals none, null and nan become empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(*MISSING), "").otherwise(t)


def fold(c: Column) -> Column:
    """Latin letters without their marks, ligatures apart."""
    x = F.translate(F.coalesce(c, F.lit("")), FOLD_FROM, FOLD_TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def light(c: Column) -> Column:
    return squeeze(F.lower(fold(c)))


def light_and(c: Column) -> Column:
    """Lower case, ``&`` as a word, punctuation as spaces."""
    return squeeze(F.regexp_replace(F.replace(F.lower(fold(clean_missing(c))), F.lit("&"), F.lit(" and ")), "[^a-z0-9\\s]", " "))


def token_normalize(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9_\\s]", " "))


def tokens(c: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens(token_normalize(c)))), " ")


def compact(c: Column) -> Column:
    return F.replace(token_normalize(c), F.lit(" "), F.lit(""))


def compact_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]", "")


def transliterate(c: Column) -> Column:
    return light_and(c)


def legal_canonical(c: Column) -> Column:
    """Legal forms anywhere in the name as their short forms."""
    x = transliterate(c)
    for phrases, short in LEGAL_FORMS:
        x = F.regexp_replace(x, f"\\b({phrases})\\b", short)
    return squeeze(x)


def legal_removed(c: Column) -> Column:
    every = "|".join(p for p, _ in LEGAL_FORMS)
    return squeeze(F.regexp_replace(transliterate(c), f"\\b({every})\\b", " "))


def legal_suffix(c: Column) -> Column:
    """The longest legal suffix of a normalised name as its short form."""
    out = c
    for phrase, short in sorted(LEGAL_SUFFIXES.items(), key=lambda x: len(x[0])):
        cut = F.concat(F.substring(c, F.lit(1), F.length(c) - len(phrase)), F.lit(short))
        out = F.when(c.endswith(" " + phrase), cut).when(c == phrase, short).otherwise(out)
    return F.trim(out)


def replace_words(c: Column, words: dict[str, str]) -> Column:
    """Whole words of a normalised text by a table; one pass, so a result is not replaced again."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def name_aliases(c: Column) -> Column:
    return replace_words(c, NAME_ALIASES)


def address_long(c: Column) -> Column:
    return replace_words(token_normalize(c), ADDRESS_LONG)


def address_short(c: Column) -> Column:
    return replace_words(transliterate(c), ADDRESS_SHORT)


def units_removed(c: Column) -> Column:
    """Suites, flats and boxes with their number."""
    return squeeze(F.regexp_replace(transliterate(c), "\\b(suite|ste|apartment|apt|unit|floor|fl|po box)\\s+[a-z0-9]+\\b", " "))


def dba_and_domain(c: Column, legacy: bool = False) -> Column:
    """The trading name behind a marker, or a web address as its words.

    ``legacy`` takes a bare ``co`` for a marker and needs no word end behind a
    domain, as the original rules do; else ``co``, ``ta``, ``dba`` and ``aka``
    count only with a slash or as whole abbreviations.
    """
    x = fold(c)
    domain = DOMAIN if legacy else DOMAIN + "\\b"
    core = F.replace(F.regexp_extract(x, "(?i)" + domain, 3), F.lit("-"), F.lit(" "))
    x = F.when(F.regexp_extract(x, "(?i)" + domain, 3) != "", F.regexp_replace(x, F.lit("(?i)" + domain), core)).otherwise(x)
    marker = "(?i)" + (DBA if legacy else DBA_STRICT)
    parts = F.split(x, marker)
    last, first = token_normalize(F.element_at(parts, -1)), token_normalize(F.element_at(parts, 1))
    return F.when(F.size(parts) > 1, F.when(F.length(last) >= 4, last).otherwise(first)).otherwise(token_normalize(x))


def business_name(c: Column, legacy: bool = True) -> Column:
    return legal_suffix(name_aliases(dba_and_domain(c, legacy)))


def country(c: Column) -> Column:
    return F.upper(token_normalize(c))


def postal_by_country(c: Column, where: Column) -> Column:
    """Five digits in the US and France, six in India, either elsewhere (six first)."""
    x, w = clean_missing(c), F.upper(F.trim(F.coalesce(where, F.lit(""))))
    five, six = F.regexp_extract(x, "\\b([0-9]{5})\\b", 1), F.regexp_extract(x, "\\b([0-9]{6})\\b", 1)
    return F.when(w.isin("US", "USA", "FRANCE", "FR"), five).when(w.isin("INDIA", "IN"), six).otherwise(F.when(six != "", six).otherwise(five))


def postal_from_tokens(t: Column) -> Column:
    """The last token of five or six digits, or empty."""
    return F.coalesce(F.try_element_at(F.filter(t, lambda x: x.rlike("^[0-9]{5,6}$")), F.lit(-1)), F.lit(""))


def postal_anywhere(c: Column) -> Column:
    """The first run of four to six digits that no digit adjoins."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), "(?<![0-9])([0-9]{4,6})(?![0-9])", 1)


def house_leading(c: Column) -> Column:
    return F.regexp_extract(transliterate(c), "^\\s*([0-9]+[a-z0-9\\-/]*)", 1)


def house_from_tokens(t: Column) -> Column:
    """The first of six tokens that is a number of up to five digits, or holds a digit and has up to six characters."""
    good = F.filter(F.slice(t, 1, 6), lambda x: x.rlike("^[0-9]{1,5}$") | (x.rlike("[0-9]") & (F.length(x) <= 6)))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def house_anywhere(c: Column) -> Column:
    return F.regexp_extract(transliterate(c), "\\b([0-9]+[a-z]?)\\b", 1)


def numeric_tokens(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(t, lambda x: x.rlike("[0-9]"))))


def number_list(c: Column) -> Column:
    """Runs of digits and ``#`` masks that hold a digit."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9#]+"), F.lit(0)), lambda x: x.rlike("[0-9]"))


def raw_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))))


def phonetic_skeleton(c: Column) -> Column:
    """Consonants of the first five words, clusters unified and repeats collapsed."""

    def one(t: Column) -> Column:
        for a, b in (("ph", "f"), ("wr", "r"), ("kn", "n"), ("ksh", "ks"), ("x", "ks")):
            t = F.replace(t, F.lit(a), F.lit(b))
        for a, b in (("[ckq]", "k"), ("[zs]", "s"), ("[dt]", "t")):
            t = F.regexp_replace(t, a, b)
        t = F.concat(F.substring(t, 1, 1), F.regexp_replace(t.substr(F.lit(2), F.length(t)), "[aeiouy]", ""))
        return F.regexp_replace(t, "(.)\\1+", "$1")

    return F.array_join(F.transform(F.slice(tokens(token_normalize(c)), 1, 5), one), " ")


def states_expanded(c: Column) -> Column:
    return replace_words(token_normalize(c), STATES)


def ocr_repaired(t: Column) -> Column:
    """Digits read for letters, in words that mix both with letters in the majority."""
    letters, digits = F.length(F.regexp_replace(t, "[^a-z]", "")), F.length(F.regexp_replace(t, "[^0-9]", ""))
    return F.when((digits > 0) & (letters > digits), F.translate(t, "0153487", "olseabt")).otherwise(t)


def initials(c: Column) -> Column:
    return F.array_join(F.transform(tokens(token_normalize(c)), lambda t: F.substring(t, 1, 1)), "")


def strip_country(name: Column, where: Column) -> Column:
    """A name without the words of its country's name."""
    return F.array_join(F.array_except(tokens(token_normalize(name)), tokens(F.lower(country(where)))), " ")


def strip_components(address: Column, gone: tuple[str, ...]) -> Column:
    """An address without the comma-separated components in a list."""
    parts = F.transform(F.split(address, ","), lambda x: F.trim(F.lower(x)))
    return F.array_join(F.filter(parts, lambda x: ~x.isin(*gone) & (x != "")), ", ")


def latin_clean(c: Column) -> Column:
    """Lower-case ASCII words; empty for a text with other characters."""
    x = F.coalesce(c, F.lit(""))
    return F.when(x.rlike("^[\\x00-\\x7F]*$"), squeeze(F.regexp_replace(F.lower(x), "[^a-z0-9]", " "))).otherwise("")


def core_tokens(c: Column) -> Column:
    """Sorted words without stop words and legal forms."""
    legal = {w for p, s in LEGAL_FORMS for x in (*p.split("|"), s) for w in x.split(" ")}
    return F.array_sort(F.array_distinct(F.filter(tokens(token_normalize(c)), lambda t: ~t.isin(*STOPWORDS, *sorted(legal)))))


def format_flags(name: Column, address: Column) -> Column:
    """Ten facts of a name's and seven of an address's spelling as bits."""
    n, a = F.coalesce(name, F.lit("")), F.coalesce(address, F.lit(""))
    facts = [
        n == F.upper(n), n == F.lower(n), n.contains("&"), n.contains("."), n.contains(","), n.contains("-"), n.contains("'"), n.contains("("),
        n.rlike("[0-9]"), n.rlike("  "), a == F.upper(a), a == F.lower(a), a.contains("#"), a.contains(","), a.contains("-"), a.contains("/"), a.rlike("^[0-9]"),
    ]
    out = F.lit(0)
    for i, f in enumerate(facts):
        out = out + F.when(f, F.lit(1 << i)).otherwise(0)
    return out


def char_grams(c: Column, n: int, piece: int = 256) -> Column:
    """Distinct n-grams; a shorter text is its own, an empty one has none.

    Grams are cut from pieces of the text, since substr counts characters from the start.
    """

    def grams(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: p.substr(i, F.lit(n)))

    def pieces(t: Column) -> Column:
        last = F.floor((F.greatest(F.length(t) - n + 1, F.lit(1)) - 1) / piece).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: t.substr(j * piece + 1, F.lit(piece + n - 1)))

    # The text is a lambda's variable, so it is computed once and not for every piece.
    all_grams = F.element_at(F.transform(F.array(c), lambda t: F.flatten(F.transform(pieces(t), grams))), 1)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(all_grams))


def padded_grams(c: Column, low: int, high: int) -> Column:
    """Character n-grams of low to high characters inside words padded by a space (with repeats)."""

    def grams(p: Column, n: int) -> Column:
        # A second parameter of the lambda would be the position in the sequence.
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: p.substr(i, F.lit(n)))

    def word(t: Column) -> Column:
        p = F.concat(F.lit(" "), t, F.lit(" "))
        return F.flatten(F.array(*[grams(p, n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(tokens(c), word))


def record_views(df, name: str = "business_name", address: str = "business_address", where: str = "country", legacy: bool = True):
    """All views of a record in one projection."""
    n, a, w = F.col(name), F.col(address), F.col(where)
    df = df.withColumns({"norm_name": business_name(n, legacy), "norm_addr": address_long(a), "country_key": country(w)})
    t = tokens(F.col("norm_addr"))
    return df.withColumns({
        "compact_name": compact(F.col("norm_name")), "phonetic": phonetic_skeleton(F.col("norm_name")), "norm_full": F.trim(F.concat_ws(" ", "norm_name", "norm_addr")),
        "house_number": house_from_tokens(t), "postal_code": postal_from_tokens(t), "numbers": numeric_tokens(F.concat(t, tokens(F.col("norm_name")))), "has_addr": (F.length("norm_addr") > 0).cast("double"),
    })
