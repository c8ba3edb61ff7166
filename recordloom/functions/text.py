"""Text normalisation, hashing and keys as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(c: Column) -> Column:
    """Empty string counts as missing (the ``a || b`` rule of the source records)."""
    return F.nullif(c, F.lit(""))


def trimmed_or_null(c: Column) -> Column:
    return blank_to_null(F.trim(c))


def first_text(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def squash_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def norm_text_keep_dots(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9.]+", " "))


def norm_name(c: Column) -> Column:
    """Strict name key: trim, lower case, single blanks; punctuation is kept."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def norm_status(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def kebab(c: Column) -> Column:
    return F.substring(norm_status(c), 1, 60)


def slug(c: Column) -> Column:
    return F.coalesce(blank_to_null(F.substring(F.replace(norm_text(c), F.lit(" "), F.lit("-")), 1, 60)), F.lit("group"))


def named_id(c: Column) -> Column:
    """A readable id that differs wherever the names differ, apart from case and punctuation.

    A name of up to 60 ASCII letters and digits is its own id. Of any other, in whatever script, the first 60 of these are
    followed by 128 bits of a hash of the whole name.
    """
    short = norm_status(c)
    whole = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", "-"), "^-+|-+$", "")
    told = (F.length(short).between(1, 60)) & (short == whole)
    return F.when(told, short).otherwise(F.concat_ws("-", blank_to_null(F.substring(short, 1, 60)), F.substring(F.sha2(F.when(whole == "", F.coalesce(c, F.lit(""))).otherwise(whole), 256), 1, 32)))


def _capitalise_pieces(c: Column, boundary: str) -> Column:
    pieces = F.split(c, boundary)
    raised = F.transform(
        pieces,
        lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))).otherwise(p),
    )
    return F.array_join(raised, "")


def title_words(c: Column) -> Column:
    """Upper-case the first letter of every word, leave the rest as it is (``initcap`` would lower it)."""
    return _capitalise_pieces(c, r"(?<![A-Za-z0-9_])(?=[a-z])")


def title_letters(c: Column) -> Column:
    """Lower-case all, then raise every letter that follows a non-letter (digits and hyphens included)."""
    return _capitalise_pieces(F.lower(c), r"(?<!\p{L})(?=[a-z])")


def title_case_parts(parts: Column) -> Column:
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return title_words(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


def fnv1a_base36(c: Column) -> Column:
    """32-bit FNV-1a over the characters, in base 36 (characters above U+FFFF hash by code point)."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("bigint"))
    folded = F.aggregate(
        codes,
        F.lit(2166136261).cast("bigint"),
        lambda h, code: ((h.bitwiseXOR(code)) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )
    empty = F.lit(2166136261).cast("bigint")
    return F.lower(F.conv(F.when(c == "", empty).otherwise(folded).cast("string"), 10, 36))


def sorted_distinct(values: Column) -> Column:
    """Trimmed, non-blank, distinct, in binary order."""
    trimmed = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.trim(v))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda v: v != "")))


def latest_date_text(values: Column) -> Column:
    return F.array_max(sorted_distinct(values))


def tokens_all_match(haystack: Column, query: str) -> Column:
    """Every blank-separated token of ``query`` occurs in ``haystack`` (case-folded by the caller)."""
    tokens = [t for t in query.strip().lower().split() if t]
    if not tokens:
        return F.lit(False)
    hit = F.contains(haystack, F.lit(tokens[0]))
    for token in tokens[1:]:
        hit = hit & F.contains(haystack, F.lit(token))
    return hit


def js_round(c: Column) -> Column:
    """Half rounds towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def number_text(c: Column) -> Column:
    """A number as the source system prints it: no trailing zeros, no exponent in the usual range."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", "")
    fraction_ok = (F.abs(c) >= F.lit(1e-3)) & (F.abs(c) < F.lit(1e7))
    return F.when(whole, c.cast("bigint").cast("string")).when(fraction_ok, c.cast("string")).otherwise(plain)


def relationship_group_key(types: Column, group_id: Column) -> Column:
    return F.concat(F.array_join(F.array_sort(types), "+"), F.lit(":"), group_id)


def record_key(resource_type: Column, record_id: Column) -> Column:
    return F.concat(resource_type, F.lit("/"), record_id)


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


# Words that carry no meaning in a medication name.
NAME_STOP_WORDS = ("and", "or", "the", "with", "without", "tablet", "capsule", "solution", "suspension", "oral", "product", "inhalant")


def meaningful_tokens(c: Column, stop_words=NAME_STOP_WORDS) -> Column:
    return F.filter(F.split(norm_text(c), " "), lambda t: (F.length(t) >= 4) & ~t.isin(*stop_words))
