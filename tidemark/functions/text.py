"""Scalars on texts and on lists that arrive as text. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that Unicode calls white space, since ``trim`` takes blanks only.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

# Terms that stand for "nothing named", by where they are dropped.
CODING_SENTINELS = ("none", "no supplements mentioned", "yes", "n/a", "na", "", "nan", "no supplements", "not mentioned", "no")
TOP_SENTINELS = ("none", "no supplements mentioned", "yes", "n/a", "na", "")
REPORT_SENTINELS = ("no supplements mentioned", "none", "no supplements", "n/a", "")
# Symptoms that are left out, and those that count as one.
SYMPTOM_EXCLUSIONS = ("none", "n/a", "no symptoms mentioned", "menopause", "perimenopause")
MOOD_WORDS = ("mood swings", "mood changes", "anxiety", "stress", "depression", "irritability")
MOOD_LABEL = "mood changes"
# Spellings with a name of their own in the report.
REPORT_ALIASES = {"omega-3": "Omega-3", "hrt": "HRT", "hormone replacement therapy": "HRT", "vitamin d": "Vitamin D", "vitamin d3": "Vitamin D3"}


def _empty() -> Column:
    return F.array().cast("array<string>")


def strip(col: Column) -> Column:
    """``col`` without white space of any kind at its ends."""
    return F.btrim(col, F.lit(WHITE))


def split_terms(col: Column) -> Column:
    """The parts of a list that arrives as text, ``[a, 'b']`` or ``a, b``.

    Brackets go from both ends of the text, white space and then quotes from both
    ends of each part. A null is an empty list; blank parts stay.
    """
    parts = F.split(F.btrim(col, F.lit("[]")), ",")
    return F.coalesce(F.transform(parts, lambda x: F.btrim(strip(x), F.lit("'\""))), _empty())


def _nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def parse_list(col: Column, mode: str = "quoted") -> Column:
    """As ``split_terms``, minding quotes, without blank parts.

    In brackets, what stands between any two quote characters is a part; without
    quotes the inside is cut at commas. Other texts are cut at commas. A field
    that says "nothing" (``REPORT_SENTINELS``) is empty. Mode ``json`` first reads
    the text as a JSON array of strings, so that an apostrophe inside double
    quotes does no harm.
    """
    return F.when(col.isNull(), _empty()).otherwise(_let(strip(col), lambda text: _parsed(text, mode)))


def _let(value: Column, used: Callable[[Column], Column]) -> Column:
    """``used(value)`` with ``value`` worked out once, however often it occurs there."""
    return F.transform(F.array(value), used)[0]


def _parsed(text: Column, mode: str) -> Column:
    """The parts of a list, of its text without white space at the ends."""
    inside = _nonblank(F.split(F.substr(text, F.lit(2), F.length(text) - 2), ","))
    bracketed = _let(F.regexp_extract_all(text, F.lit("['\"]([^\\n]*?)['\"]"), F.lit(1)), lambda quoted: F.when(F.size(quoted) > 0, _nonblank(quoted)).otherwise(inside))
    is_list = text.startswith("[") & text.endswith("]") & (F.length(text) >= 2)
    if mode == "json":
        read = F.try_variant_get(F.try_parse_json(text), "$", "array<string>")
        bracketed = F.coalesce(_nonblank(F.filter(read, lambda x: x.isNotNull())), bracketed)
    found = F.when(is_list, bracketed).otherwise(_nonblank(F.split(text, ",")))
    return F.when(F.lower(text).isin(*REPORT_SENTINELS), _empty()).otherwise(found)


def drop_sentinels(terms: Column, sentinels: Iterable[str]) -> Column:
    """``terms`` without those that, in lower case, are among ``sentinels``."""
    return F.filter(terms, lambda x: ~F.lower(x).isin(*sentinels))


def title_case(col: Column) -> Column:
    """T4: a capital after everything that isn't a letter, else lower case.

    Unlike ``initcap`` this also raises the letter after a digit or an apostrophe.
    """
    low = F.lower(col)
    letters = F.split(low, "")
    before = lambda i: F.coalesce(F.get(letters, i - 1), F.lit(""))
    return F.array_join(F.transform(letters, lambda c, i: F.when(before(i).rlike(r"\p{L}"), c).otherwise(F.upper(c))), "")


def alias_key(col: Column, aliases: Mapping[str, str] = REPORT_ALIASES) -> Column:
    """The alias of a term, or else the term in lower case: equal for terms of the same name, and cheap."""
    low = F.lower(strip(col))
    return F.coalesce(F.try_element_at(_table(aliases), low), low) if aliases else low


def alias_name(key: Column, aliases: Mapping[str, str] = REPORT_ALIASES) -> Column:
    """The name that an ``alias_key`` stands for; title case takes a look at every letter, so names are best made of distinct keys."""
    return F.when(key.isin(*set(aliases.values())), key).otherwise(title_case(key)) if aliases else title_case(key)


def _table(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def alias_title(col: Column, aliases: Mapping[str, str] = REPORT_ALIASES) -> Column:
    """T5: the alias of a term, or else the term in title case."""
    text = strip(col)
    return F.coalesce(F.try_element_at(_table(aliases), F.lower(text)), title_case(text))


def term_key(col: Column) -> Column:
    """What a term is looked up by: trimmed, lower case, without dots at its end."""
    return F.rtrim(F.lower(strip(col)), F.lit("."))


def symptom_keys(terms: Column) -> Column:
    """Symptoms in lower case, exclusions dropped, mood words under one label."""
    kept = F.filter(F.transform(terms, F.lower), lambda x: ~x.isin(*SYMPTOM_EXCLUSIONS))
    return F.transform(kept, lambda x: F.when(x.isin(*MOOD_WORDS), F.lit(MOOD_LABEL)).otherwise(x))


def normalize_symptoms(terms: Column) -> Column:
    """Symptoms in title case, exclusions dropped, mood words under one label."""
    return F.transform(symptom_keys(terms), title_case)


def loose_bool(col: Column) -> Column:
    """Whether a text says true or 1; anything else, null too, is false."""
    return F.coalesce(F.lower(col.cast("string")).isin("true", "1"), F.lit(False))


def strip_url_param(col: Column, name: str) -> Column:
    """L1: a URL without one query parameter; URLs that don't have it stay as they are."""
    cut = F.regexp_replace(col, rf"([?&]){name}=[^&]*&?", "$1")
    return F.when(F.contains(col, F.lit(f"{name}=")), F.rtrim(cut, F.lit("?&"))).otherwise(col)


def clock_to_seconds(col: Column) -> Column:
    """Seconds of ``m:ss`` or ``h:mm:ss``; null if any part isn't a whole number."""
    parts = F.transform(F.split(strip(col), ":"), lambda x: x.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.when(F.size(parts) > 1, total)
