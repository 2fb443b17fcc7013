"""Fact documents: validation, citations and their audit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.urls import definitive_failure, normalize_domain_url, public_url, reachable
from ..schemas import FACTS


def section_violations(sections: DataFrame) -> DataFrame:
    """(node_id, rule) of ``sections`` (node_id, type, key, heading, body,
    source_urls, last_reviewed)."""
    blank = lambda c: F.coalesce(text.strip(c) == "", F.lit(True))
    rules = F.array(
        F.when(~F.array_contains(text.allowed_keys("type"), F.col("key")), "unsupported section"),
        F.when(blank(F.col("heading")), "empty heading"),
        F.when(blank(F.col("body")), "no prose"),
        F.when(F.coalesce(F.size("source_urls"), F.lit(0)) == 0, "uncited section"),
        F.when(F.try_to_date("last_reviewed", "yyyy-MM-dd").isNull(), "bad date"),
    )
    return sections.select("node_id", F.explode(F.array_compact(rules)).alias("rule"))


#: What each part of a fact document may hold, and nothing else.
DOCUMENT_KEYS = ("schema_version", "last_reviewed", "quick_facts", "sections", "useful_links", "prov")
PART_KEYS = {
    "quick_facts": ("label", "value", "source_urls"),
    "sections": ("key", "heading", "paragraphs", "bullets", "source_urls"),
    "useful_links": ("label", "url", "kind"),
}
PROV_KEYS = ("model", "prompt_version", "generated_at")


def document_violations(documents: DataFrame, model: str, prompt_version: str, schema_version: int = 1) -> DataFrame:
    """(node_id, rule) for strict fact documents (node_id, type, body: JSON):
    unknown or missing keys, pinned values, dates, blank or uncited parts,
    links that are no public address, sections the type does not have."""
    body = F.col("body")
    known = F.from_json(body, FACTS)
    blank = lambda x: F.coalesce(text.strip(x) == "", F.lit(True))
    extra = lambda json, keys: F.size(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in keys]))) > 0
    more_than = lambda keys: lambda x: extra(x, keys)
    date = lambda x: F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & F.try_to_date(x, "yyyy-MM-dd").isNotNull()
    raw = lambda part: F.coalesce(F.from_json(F.get_json_object(body, f"$.{part}"), "array<string>"), F.array().cast("array<string>"))
    some = lambda part, rule: F.coalesce(F.exists(F.col("d")[part], rule), F.lit(False))
    uncited = lambda x: F.coalesce(F.size(x["source_urls"]), F.lit(0)) == 0
    bad_url = lambda x: normalize_domain_url(x).isNull()
    d = F.col("d")
    rules = [
        (d.isNull() | F.json_object_keys(body).isNull(), "not a document"),
        (extra(body, DOCUMENT_KEYS), "unknown key"),
        (F.coalesce(d["schema_version"] != schema_version, F.lit(True)), "schema version"),
        (~date(d["last_reviewed"]), "bad date"),
        (F.coalesce(F.size(d["sections"]), F.lit(0)) < 1, "no sections"),
        (d["quick_facts"].isNull() | d["useful_links"].isNull(), "missing part"),
        *[(F.exists(raw(part), more_than(keys)), f"unknown key in {part}") for part, keys in PART_KEYS.items()],
        (some("quick_facts", lambda x: blank(x["label"]) | blank(x["value"])), "blank quick fact"),
        (some("quick_facts", uncited), "uncited quick fact"),
        (some("quick_facts", lambda x: F.exists(x["source_urls"], bad_url)) | some("sections", lambda x: F.exists(x["source_urls"], bad_url)), "bad source"),
        (some("sections", lambda x: ~F.coalesce(F.array_contains(text.allowed_keys("type"), x["key"]), F.lit(False))), "unsupported section"),
        (some("sections", lambda x: blank(x["heading"])), "empty heading"),
        (some("sections", lambda x: F.coalesce(F.size(x["paragraphs"]), F.lit(0)) + F.coalesce(F.size(x["bullets"]), F.lit(0)) < 1), "no prose"),
        (some("sections", lambda x: F.exists(x["paragraphs"], blank) | F.exists(x["bullets"], blank)), "blank prose"),
        (some("sections", uncited), "uncited section"),
        (some("useful_links", lambda x: blank(x["label"]) | blank(x["kind"])), "blank link"),
        (some("useful_links", lambda x: bad_url(x["url"])), "bad link"),
        (F.coalesce((d["prov"]["model"] != model) | (d["prov"]["prompt_version"] != prompt_version), F.lit(True)), "provenance"),
        (~date(d["prov"]["generated_at"]), "bad provenance date"),
        (extra(F.get_json_object(body, "$.prov"), PROV_KEYS), "unknown key in prov"),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), rule) for c, rule in rules])
    return documents.select("node_id", "type", "body", known.alias("d")).select("node_id", F.explode(F.array_compact(found)).alias("rule"))


def citations(facts: DataFrame) -> DataFrame:
    """(node_id, urls): distinct URLs of each node in order of first use.
    ``facts`` (node_id, pos, urls) has one row for each part of a document."""
    used = facts.select("node_id", "pos", F.posexplode("urls").alias("at", "url"))
    # Repeats go before the lists form: a URL that every part cites is one row.
    first = used.groupBy("node_id", "url").agg(F.min(F.struct("pos", "at")).alias("first"))
    lists = first.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("first", "url"))).alias("u"))
    return lists.select("node_id", F.transform("u", lambda x: x["url"]).alias("urls"))


def collect_urls(facts: DataFrame, edges: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """Distinct URLs of all parts (last_reviewed, urls) reviewed since a day,
    which drops older documents whole, and of all edges (urls)."""
    kept = facts if since is None else facts.filter(F.col("last_reviewed") >= since)
    found = kept.select(F.explode("urls").alias("url"))
    if edges is not None:
        found = found.unionByName(edges.select(F.explode("urls").alias("url")))
    return found.distinct()


def probe(urls: DataFrame, requester: Callable[[str], tuple[int | None, str | None, str | None]]) -> DataFrame:
    """(url, status, error) by an injected ``requester`` (url -> status,
    location, error); up to five redirects, each target checked again."""

    def one(url: str) -> tuple[str, int | None, str | None]:
        at = public_url(url)
        for _ in range(6):
            if at is None:
                return url, None, "refused"
            status, location, error = requester(at)
            if error or status is None or not 300 <= status < 400 or not location:
                return url, status, error
            at = public_url(location)
        return url, None, "too many redirects"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(u) for u in batch["url"]], columns=["url", "status", "error"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, "url string, status int, error string")


def classify(probed: DataFrame) -> DataFrame:
    return probed.withColumn("reachable", reachable("status")).withColumn(
        "definitive_failure", definitive_failure("status") | F.coalesce(F.col("error") == "refused", F.lit(False))
    )


def split_incremental(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to audit, carried): current URLs that the previous audit did not prove
    reachable are audited again, the proven ones carried, the rest dropped."""
    proven = previous.filter("reachable AND NOT definitive_failure")
    return current.join(proven.select("url"), "url", "left_anti"), proven.join(current.select("url"), "url", "left_semi")


def enrichment_candidates(
    nodes: DataFrame, failures: DataFrame, force: bool = False, retry: bool = False, only: list[str] | None = None, limit: int = 0
) -> DataFrame:
    """Ids to enrich, in order: those without facts and without an earlier
    failure; ``limit`` 0 means all."""
    out = nodes if force else nodes.filter(~F.col("has_facts"))
    if not retry:
        out = out.join(failures.filter("stage = 'enrichment'").select(F.col("node_id").alias("id")), "id", "left_anti")
    if only is not None:
        out = out.filter(F.col("id").isin(*only))
    out = out.select("id").orderBy("id")
    return out.limit(limit) if limit > 0 else out
