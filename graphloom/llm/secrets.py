"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong spans stand alone: ``assign`` (a named value such as ``password=...``),
``access`` (an access-key identifier) and ``hex`` (a long run of lower-case
hexadecimal digits).  Weak candidates mean little alone and are reported only
next to the parts that complete a credential in the same scope (a block of
text without a blank line, however long):

* ``secret``: a run of 32 or more base64 characters that mixes upper case,
  lower case and digits, if the scope has an access identifier;
* ``endpoint``: a service address, if the scope has an access identifier and
  a value (assign, hex or a reported-by-shape secret).

The interval join of spans with the scopes that hold them is a running count
of scope ends over each document's spans ordered by start, and whether a scope
has the complements is a window over it.  No row per pair is emitted, so a
text with thousands of identifiers costs a sort, not a product.

Defined results: a null text counts as empty and has no spans; null ids stay
null, and rows that share an id are told apart by a key of each row; an empty
table gives an empty result; extra columns are ignored (kept by ``redact``),
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?:https?|s3|ftp|jdbc:[a-z]+)://[A-Za-z0-9._~-]+(?::[0-9]+)?"
BREAK = r"\n[ \t]*\n"

#: The order in which kinds are listed when two spans start together.
KINDS = ("assign", "access", "hex", "secret", "endpoint")


def _hits(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """array<struct(kind, i, gap, width, keep)>: for each match the length of
    the text since the previous match and of the match itself."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    widths = F.transform(found, F.char_length)
    kept = keep(text, found) if keep else F.transform(found, lambda _: F.lit(True))
    rows = F.transform(
        F.arrays_zip(
            F.slice(gaps, 1, F.size(found)).alias("gap"), widths.alias("width"), kept.alias("keep")
        ),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.char_length(z["gap"]).alias("gap"),
            z["width"].alias("width"),
            z["keep"].alias("keep"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,width:int,keep:boolean>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), rows).otherwise(none)


def _assign_kept(text: Column, found: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return F.transform(values, lambda v: F.char_length(v) >= 6)


def _secret_kept(text: Column, found: Column) -> Column:
    return F.transform(
        found, lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (row_key, id_col, spans) with
    spans array<struct(start, kind_no, kind, end)> in order, code points,
    end exclusive.  Weak spans appear only where linked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.concat(
        _hits(text, "assign", ASSIGN, _assign_kept),
        _hits(text, "access", ACCESS),
        _hits(text, "hex", HEX),
        _hits(text, "secret", SECRET, _secret_kept),
        _hits(text, "endpoint", ENDPOINT),
    )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        F.col(id_col).alias("id"),
        text.alias("t"),
        hits.alias("hits"),
    ).select(
        "row_key",
        "id",
        F.explode_outer(
            F.when(linkable_of("hits"), F.concat("hits", _hits(F.col("t"), "break", BREAK))).otherwise(F.col("hits"))
        ).alias("h"),
    )
    by_row = Window.partitionBy("row_key")
    in_order = Window.partitionBy("row_key", "h.kind").orderBy("h.i")
    placed = (
        rows.repartition("row_key")
        .withColumn("end", F.sum(F.col("h.gap") + F.col("h.width")).over(in_order).cast("long"))
        .withColumn("start", F.col("end") - F.col("h.width"))
        .select("row_key", "id", F.col("h.kind").alias("kind"), "start", "end", F.col("h.keep").alias("keep"))
    )
    scoped = placed.withColumn(
        "scope", F.sum((F.col("kind") == "break").cast("int")).over(by_row.orderBy("start", "end"))
    ).filter(F.col("kind").isNull() | F.col("keep") & (F.col("kind") != "break"))
    near = Window.partitionBy("row_key", "scope")
    has_access = F.max((F.col("kind") == "access").cast("int")).over(near) == 1
    has_value = F.max(F.col("kind").isin("assign", "hex", "secret").cast("int")).over(near) == 1
    reported = (
        F.col("kind").isin("assign", "access", "hex")
        | ((F.col("kind") == "secret") & has_access)
        | ((F.col("kind") == "endpoint") & has_access & has_value)
    )
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", number.alias("kind_no"), "kind", "end")
    return (
        scoped.withColumn("reported", reported)
        .groupBy("row_key")
        .agg(
            F.first("id").alias(id_col),
            F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("spans"),
        )
    )


def linkable_of(hits: str) -> Column:
    kind_is = lambda *kinds: F.exists(F.col(hits), lambda h: h["kind"].isin(*kinds) & h["keep"])
    return kind_is("secret", "endpoint") & kind_is("access")


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind_no"] <= 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark`` and
    ``n_chars``, if there is one, brought up to date; overlapping spans become
    one mark.

    Spans depend on the text alone and return to it by the text's digest, so
    null and repeated ids make no difference.  Rows are shuffled once for it, by
    the same plan at every size, as texts with spans grow with the input.
    """
    digest_of = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = (
        scan(docs.select(digest_of.alias("digest"), "text"), "digest")
        .filter(F.size("spans") > 0)
        .groupBy("digest")
        .agg(F.first("spans").alias("spans"))
    )
    # Merge overlapping spans, then stitch the text between them.
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(acc, F.lit(-1))["s"].alias("s"),
                        F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["end"]).alias("e"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))),
    )
    key, spans = free_name(docs, "digest"), free_name(docs, "merged")
    small = materialize(found.select(F.col("digest").alias(key), merged.alias(spans)), "spans")
    stitched = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, m: F.struct(
            F.concat(
                acc["out"],
                F.col("text").substr((acc["at"] + 1).cast("int"), (m["s"] - acc["at"]).cast("int")),
                F.lit(mark),
            ).alias("out"),
            m["e"].alias("at"),
        ),
        lambda acc: F.concat(
            acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.char_length("text"))
        ),
    )
    joined = docs.withColumn(key, digest_of).join(small.hint("merge"), key, "left")
    changed = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(stitched))
    if "n_chars" in docs.columns:
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(count))
    return changed.select(*docs.columns)
