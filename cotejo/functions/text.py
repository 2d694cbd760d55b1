"""Column functions on catalog texts."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that are a plain letter and marks, and that letter, in step.
_LETTERS = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
MARKED = "".join(c for c, plain in _LETTERS if len(plain) == 1 and plain != c)
PLAIN = "".join(plain for c, plain in _LETTERS if len(plain) == 1 and plain != c)
# Noise in names, words without content, unit words.
NOISE = [r"\[[^\]]*warehouse[^\]]*\]", r"\bglobal\b", r"\beu\s*plug\b", r"\bus\s*plug\b", r"\buk\s*plug\b", r"\bnew\b", r"\bversion\b"]
STOP_WORDS = ["de", "con", "para", "the", "and", "y", "a", "en", "un", "una", "inch", "pulgadas", "color", "network", "support", "black", "white"]
UNITS = r"gb|mb|tb|kg|mah|watts?|hz|kpa|pulgadas?|in"

# How names tell memory, screen and refresh rate.
_PAIR = r"(?iU)(\d+)\s*GB\s*[+/]?\s*(\d+)\s*(GB|TB)\b"
_SINGLE = r"(?iU)\b(\d+)\s*(GB|TB)\b"
_SCREEN = r'(?iU)(\d+(?:\.\d+)?)\s*(?:inch|"|pulgadas)'
_HERTZ = r"(?iU)(\d+)\s*Hz"
# Fixed value: a word of letters and digits that can name a model.
_MODEL = r"\b(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]{2,10}\b"
# Fixed value: gigabytes without their B.
_BARE_G = r"(?<=\d)G(?=\s|$|[^a-zA-Z])"

_NOISE = "(?iU)" + "|".join(NOISE)


def fold_accents(text: Column) -> Column:
    """Marks off Latin letters; combining marks go."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{Mn}", "")


def normal_identifier(raw: Column) -> Column:
    """A ten-character store number as it is, else the digits if they make a bar code (8, 12, 13 or 14, not all zero); otherwise null."""
    trimmed = F.trim(F.coalesce(raw, F.lit("")))
    digits = F.regexp_replace(trimmed, r"[^0-9]", "")
    store_number = trimmed.rlike("^[A-Z0-9]{10}$") & ~trimmed.rlike("^[0-9]{10}$")
    return F.when(store_number, trimmed).when(F.length(digits).isin(8, 12, 13, 14) & ~digits.rlike("^0+$"), digits)


def normal_text(name: Column) -> Column:
    """Noise and punctuation off, single spaces, lower case."""
    plain = F.regexp_replace(F.regexp_replace(name, _NOISE, " "), r"(?U)[^\w\s]", " ")
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def specs(name: Column) -> Column:
    """Struct of ram_gb, storage_gb, screen_in, refresh_hz, each null where the name does not tell."""

    def found(pattern: str, group: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, group), F.lit("")).try_cast(kind)

    def gigabytes(pattern: str, group: int) -> Column:
        return found(pattern, group, "long") * F.when(F.upper(F.regexp_extract(name, pattern, group + 1)) == "TB", 1024).otherwise(1)

    return F.struct(
        found(_PAIR, 1, "long").alias("ram_gb"),
        F.when(found(_PAIR, 1, "long").isNotNull(), gigabytes(_PAIR, 2)).otherwise(gigabytes(_SINGLE, 1)).alias("storage_gb"),
        F.bround(found(_SCREEN, 1, "double"), 2).alias("screen_in"),
        found(_HERTZ, 1, "long").alias("refresh_hz"),
    )


def model_tokens(name: Column) -> Column:
    """Words of letters and digits, and neighbouring word and number pairs outside specifications; upper case, sorted."""
    clean = F.regexp_replace(name, _NOISE, " ")
    mixed = F.regexp_extract_all(clean, F.lit(_MODEL), F.lit(0))
    for pattern in (_PAIR, _SINGLE, _SCREEN, _HERTZ):
        clean = F.regexp_replace(clean, pattern, " ")
    words = F.regexp_extract_all(clean, F.lit(r"[A-Za-z]+|[0-9]+"), F.lit(0))
    number = lambda w: w.rlike("^[0-9]+$")
    fits = lambda n, w: number(n) & ~number(w) & (F.length(n) <= 3) & (F.length(w) >= 2)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(fits(a, b) | fits(b, a), F.concat(a, b)))
    both = F.concat(mixed, F.filter(pairs, lambda p: p.isNotNull()))
    return F.array_sort(F.array_distinct(F.transform(both, F.upper)))


def content_tokens(normal: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(normal, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))))


def search_text(text: Column) -> Column:
    """Lower case without marks; digits and letters apart; runs of anything else are one space."""
    x = F.lower(fold_accents(F.coalesce(text, F.lit(""))))
    x = F.regexp_replace(F.regexp_replace(x, r"(?<=\d)(?=[a-z])", " "), r"(?<=[a-z])(?=\d)", " ")
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def search_tokens(text: Column) -> Column:
    return F.filter(F.split(search_text(text), " "), lambda w: w != "")


def variant_key(text: Column) -> Column:
    """Brackets, commas, dashes and bars are spaces; a number and its unit are one word."""
    spaced = F.regexp_replace(text, r"[(),\-/|]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, rf"(?i)(\d)\s*({UNITS})\b", "$1$2"), r"\s{2,}", " "))


def full_gigabytes(title: Column) -> Column:
    return F.regexp_replace(title, _BARE_G, "GB")


def without_brand(title: Column, brand: Column) -> Column:
    """The title after a leading brand and white space, whatever its case."""
    n = F.length(brand)
    leads = (n > 0) & (F.lower(F.substring(title, F.lit(1), n)) == F.lower(brand)) & F.substring(title, n + 1, F.lit(1)).rlike(r"(?U)^\s$")
    return F.when(F.coalesce(leads, F.lit(False)), F.regexp_replace(F.substring(title, n + 1, F.length(title)), r"(?U)^\s+", "")).otherwise(title)


def slug(text: Column) -> Column:
    plain = F.regexp_replace(fold_accents(text), r"[^\x00-\x7F]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def title_case(text: Column) -> Column:
    return F.initcap(F.lower(text))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def same_product_prompt(source_a: Column, name_a: Column, source_b: Column, name_b: Column) -> Column:
    """A yes-or-no question on two listings, for whoever reviews them."""
    said = "¿Son el mismo producto físico estas dos publicaciones? Responde SI o NO y la variante si difiere.\nTienda A (%s): %s\nTienda B (%s): %s\n"
    return F.format_string(said, source_a, name_a, source_b, name_b)
