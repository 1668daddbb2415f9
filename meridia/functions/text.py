"""Normalisers and similarities of names, phones, licences and addresses on the web."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .values import is_blank, once, strip, text


def is_sentinel(c: Column, words=S.SENTINELS_MATCHING) -> Column:
    return F.lower(text(c)).isin("", *words)


def unless_sentinel(c: Column, value: Column) -> Column:
    return F.when(is_sentinel(c), F.lit("")).otherwise(value)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_arabic(c: Column) -> Column:
    out = F.translate(F.regexp_replace(text(c), r"[\x{064B}-\x{065F}\x{0670}]", ""), *S.AR_LETTERS)
    # longest first, where the order matters: one listed word may hold another
    for words in (S.AR_SUFFIXES, S.AR_CATEGORY_WORDS):
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            out = F.replace(out, F.lit(w), F.lit(""))
    return unless_sentinel(c, squeeze(F.regexp_replace(out, r"(?U)[^\w\s\x{0600}-\x{06FF}]", "")))


def _without_suffixes(c: Column) -> Column:
    dotted, plain = "|".join(S.EN_SUFFIXES_WITH_DOT), "|".join(S.EN_SUFFIXES)
    return F.regexp_replace(F.lower(text(c)), rf"(?U)\b(?:(?:{dotted})\.?|{plain})\b", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def normalize_english(c: Column) -> Column:
    kept = F.filter(_words(_without_suffixes(c)), lambda w: ~w.isin(*S.EN_CATEGORY_WORDS))
    return unless_sentinel(c, squeeze(F.regexp_replace(F.array_join(kept, " "), r"(?U)[^\w\s]", "")))


def brand_words(c: Column) -> Column:
    bare = F.regexp_replace(_without_suffixes(c), r"(?U)[^\w\s]", "")
    return F.filter(_words(bare), lambda w: ~w.isin(*S.EN_CATEGORY_WORDS, *S.EN_STOPWORDS) & (F.length(w) > 1))


def normalize_phone(c: Column) -> Column:
    digits = F.ltrim(F.ltrim(F.regexp_replace(text(c), r"(?U)\D", ""), F.lit("96")), F.lit("0"))
    return unless_sentinel(c, F.when(F.length(digits) >= 7, F.substring(digits, 1, 9)).otherwise(F.lit("")))


def normalize_license(c: Column) -> Column:
    return unless_sentinel(c, F.regexp_replace(text(c), r"(?U)\D", ""))


def website_domain(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"^https?://", ""), r"^www\.", "")
    return unless_sentinel(c, F.substring_index(F.substring_index(bare, "/", 1), "?", 1))


def transliterate(c: Column) -> Column:
    """Greedy, longest rule first; spaces stay, other characters go."""
    rules = sorted(S.TRANSLITERATION, key=lambda k: (-len(k), k))
    table = F.create_map(*(F.lit(x) for k in rules for x in (k, S.TRANSLITERATION[k])), F.lit(" "), F.lit(" "))
    parts = F.regexp_extract_all(F.lower(c), F.lit("(" + "|".join(rules) + "| )"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.element_at(table, p)), "")


def _bigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array(c))


def dice(a: Column, b: Column, short: str = "equal") -> Column:
    """100 * Dice of character pairs without spaces.

    Texts of one character: ``equal`` gives 100 or 0 by equality where either is
    that short, ``set`` treats the character as the only member.
    """
    bare = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "))

    def score(x: Column, y: Column) -> Column:
        grams = once(_bigrams(x), lambda p: once(_bigrams(y), lambda q: F.size(F.array_intersect(p, q)) * 2.0 / (F.size(p) + F.size(q)) * 100))
        out = F.when((x == "") | (y == ""), F.lit(0.0))
        if short == "equal":
            out = out.when((F.length(x) < 2) | (F.length(y) < 2), F.when(x == y, 100.0).otherwise(0.0))
        return out.otherwise(grams)

    return once(bare(a), lambda x: once(bare(b), lambda y: score(x, y)))


def brand_similarity(a: Column, b: Column) -> Column:
    """Jaccard of brand words; less if the shorter name is a small part of the longer."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    jaccard = F.size(F.array_intersect(x, y)) * 100.0 / F.size(F.array_union(x, y))
    small, large = F.when(F.size(a) <= F.size(b), x).otherwise(y), F.when(F.size(a) <= F.size(b), y).otherwise(x)
    part = (F.size(F.array_except(small, large)) == 0) & (F.least(F.size(a), F.size(b)) * 1.0 / F.greatest(F.size(a), F.size(b)) < 0.5)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.when(part, jaccard * 0.6).otherwise(jaccard))


def title(c: Column) -> Column:
    """A capital after anything that is no letter, small letters elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 10_000)))), "")


def media_urls(c: Column) -> Column:
    """URLs of a field that are separated by commas or space, without placeholders."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,\s]+"), lambda u: (u != "") & ~F.contains(F.upper(u), F.lit("UNAVAILABLE")))


def yes_no(c: Column) -> Column:
    """The word boolean of a free spelling; null stays null, blanks and UNAPPLICABLE stay."""
    v = F.lower(strip(c))
    return (
        F.when(v.isin("yes", "y", "true", "1"), "Yes").when(v.isin("no", "n", "false", "0"), "No").when(c.isNull() | (v == "") | (v == "unapplicable"), c).otherwise("UNAVAILABLE")
    )


def fix_phone(c: Column) -> tuple[Column, Column]:
    """Value and error: digits with the country's 966, or the value as it is and INVALID_PHONE; blanks pass."""
    raw = F.when(F.upper(text(c)).contains("E+"), F.coalesce(text(c).try_cast("double").try_cast("decimal(20,0)").cast("string"), text(c))).otherwise(text(c))
    digits = F.regexp_replace(raw, r"\D", "")
    full = F.when(raw.rlike(r"^\+?966"), F.concat(F.lit("966"), F.ltrim(digits, F.lit("96")))).when(F.length(digits).isin(9, 10), F.concat(F.lit("966"), digits)).otherwise(digits)
    good = F.length(full).between(9, 12)
    blank = is_blank(c, "batch")
    return F.when(blank | ~good, c).otherwise(full), F.when(~blank & ~good, F.lit("INVALID_PHONE"))
