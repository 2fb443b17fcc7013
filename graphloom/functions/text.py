"""Titles, slugs, identifiers and labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ABBREVIATIONS, BARE_GENERICS, LEVEL_TOKENS, SECTION_KEYS


#: The characters that the web's string trimming takes as white
#: space.
SPACE = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(x) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), f"[{SPACE}]+", " "))


def slugify(title) -> Column:
    """Lower case, other characters to single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(title)), "[^a-z0-9]+", "-"), "^-|-$", "")


def normalize_title(title) -> Column:
    """The token form that the exact gate compares."""
    low = F.replace(F.lower(_c(title)), F.lit("&"), F.lit(" and "))
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), F.lit(" "))
    spelled = reduce(
        lambda t, kv: F.replace(t, F.lit(f" {kv[0]} "), F.lit(f" {kv[1]} ")), ABBREVIATIONS, padded
    )
    return F.trim(F.regexp_replace(spelled, r"\s+", " "))


def looks_aggregate(title) -> Column:
    base = F.regexp_replace(_c(title), r"\([^)]*\)", "")
    parts = F.filter(F.transform(F.split(base, r"\|| or "), strip), lambda p: p != "")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: F.char_length(p) >= 8)


def is_bare_generic(title) -> Column:
    return normalize_title(title).isin(*BARE_GENERICS)


def level_tokens(title) -> Column:
    """Distinct level tokens of a title, in order of the alphabet."""
    tokens = F.split(normalize_title(title), " ")
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(t) for t in LEVEL_TOKENS])))


def qualified_title(title, parent_title) -> Column:
    """A generic title made specific by its parent."""
    parent = strip(F.regexp_replace(_c(parent_title), rf"[{SPACE}]*\([^)]*\)", ""))
    return F.concat(F.regexp_replace(_c(title), r"\.+$", ""), F.lit(" in "), parent)


def clean_title(title) -> Column:
    """Single spaces, and a pipe with the blanks round it as a slash."""
    return F.regexp_replace(collapse(title), r" *\| *", "/")


def id_type(node_id) -> Column:
    return F.substring_index(_c(node_id), ":", 1)


def id_slug(node_id) -> Column:
    """All after the first colon (more colons stay)."""
    at = F.instr(_c(node_id), ":")
    return F.substring(_c(node_id), at + 1, F.char_length(_c(node_id)))


def split_id(node_id) -> Column:
    """struct(type, slug); raises where either part would be empty."""
    c = _c(node_id)
    at = F.instr(c, ":")
    bad = F.raise_error(F.concat(F.lit("malformed node id: "), c)).cast("struct<type:string,slug:string>")
    return F.when(
        (at > 1) & (at < F.char_length(c)), F.struct(id_type(c).alias("type"), id_slug(c).alias("slug"))
    ).otherwise(bad)


def node_href(node_id, prefix: str = "/careers") -> Column:
    return F.concat(F.lit(f"{prefix}/"), id_type(node_id), F.lit("/"), id_slug(node_id))


def explore_href(node_id, parent_id=None) -> Column:
    base = node_href(node_id, "/explore")
    if parent_id is None:
        return base
    parent = _c(parent_id)
    return F.when(parent.isNull(), base).otherwise(F.concat(base, F.lit("?from="), F.url_encode(parent)))


def readable_id(node_id) -> Column:
    return F.replace(F.substring_index(_c(node_id), ":", -1), F.lit("-"), F.lit(" "))


def title_from_id(node_id) -> Column:
    return F.replace(id_slug(node_id), F.lit("-"), F.lit(" "))


def humanize(label) -> Column:
    """Underscores to spaces, first letters to upper case, others as they are."""
    words = F.split(F.replace(_c(label), F.lit("_"), F.lit(" ")), " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.char_length(w)))), " "
    )


def long_date(day) -> Column:
    return F.date_format(_c(day), "d MMMM yyyy")


def embedding_text(node_type, title, description) -> Column:
    return F.concat(
        _c(node_type), F.lit(": "), _c(title), F.lit(" — "), F.substring(_c(description), 1, 160)
    )


def pair_text(title, context) -> Column:
    """A title and the last two parts of its slash-separated context, which
    may be empty or null."""
    parts = F.split(F.coalesce(_c(context), F.lit("")), "/")
    size = F.least(F.size(parts), F.lit(2))
    return F.concat(_c(title), F.lit(" — context: "), F.array_join(F.slice(parts, -size, size), " / "))


def font_bucket(title) -> Column:
    n = F.char_length(_c(title))
    return F.when(n > 80, "small").when(n > 40, "medium").otherwise("large")


def cache_key(**fields) -> Column:
    """SHA-256 of the fields as JSON with sorted keys."""
    parts = [_c(v).alias(k) for k, v in sorted(fields.items())]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def allowed_keys(node_type) -> Column:
    """Section keys of a type; raises for an unknown type."""
    out = F.raise_error(F.concat(F.lit("unknown node type: "), _c(node_type))).cast("array<string>")
    for name, keys in SECTION_KEYS.items():
        out = F.when(_c(node_type) == name, F.array(*[F.lit(k) for k in keys])).otherwise(out)
    return out


def newline_list(text) -> Column:
    return F.filter(F.transform(F.split(_c(text), "\n"), strip), lambda x: x != "")


def client_ip(forwarded, real) -> Column:
    first = F.nullif(strip(F.substring_index(_c(forwarded), ",", 1)), F.lit(""))
    return F.coalesce(first, F.nullif(strip(real), F.lit("")), F.lit("unknown"))


def today(day: str | None = None) -> Column:
    """The day as yyyy-MM-dd; a given one in tests and reruns."""
    return F.lit(day) if day is not None else F.date_format(F.current_date(), "yyyy-MM-dd")
