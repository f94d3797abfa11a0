"""Safety analysis of pages: scores, findings and the sandbox decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.config import DEFAULT, Settings
from pagelake.functions import html as H
from pagelake.functions import inline_rows
from pagelake.functions import urls


def malicious_pattern(cfg: Settings = DEFAULT) -> str:
    # i: any case; d: only a line feed ends a line, for "."
    return "(?id)" + "|".join(f"(?:{p})" for p in cfg.malicious_patterns)


def _tagged(els: Column, tag: str, condition) -> Column:
    return F.filter(els, lambda e: (e["tag"] == tag) & condition(e))


def addresses(els: Column) -> Column:
    """Sources of scripts, then iframes, then images, then link targets; none empty."""
    groups = [
        F.transform(_tagged(els, t, lambda e: e["src"] != ""), lambda e: e["src"])
        for t in ("script", "iframe", "img")
    ]
    groups.append(F.transform(_tagged(els, "a", lambda e: e["href"] != ""), lambda e: e["href"]))
    return F.concat(*groups)


def analyze(pages: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Add the safety columns to pages (url, html, optional headers map).

    Per page and in one narrow stage: all counts come from the page's own element
    array, so nothing is shuffled. Pages of trusted sites are not scanned.
    """
    url, html = F.col("url"), F.col("html")
    no_elements = F.array().cast("array<struct<tag:string>>")
    staged = pages.withColumn("domain", urls.netloc(url)).withColumn("_trusted", urls.is_trusted(F.col("domain"), cfg))
    staged = staged.withColumn("_els", F.when(~F.col("_trusted"), H.elements(html)))
    els = F.col("_els")
    malicious = malicious_pattern(cfg)
    staged = staged.withColumns(
        {
            "_addresses": addresses(els),
            "_malicious": _tagged(els, "script", lambda e: e["text"].rlike(malicious)),
            "_insecure": F.size(_tagged(els, "script", lambda e: urls.is_plain_http(e["src"]))),
            "_refresh": F.exists(els, lambda e: (e["tag"] == "meta") & (e["http_equiv"] == "refresh")),
        }
    )
    hosts = F.transform(F.col("_addresses"), urls.netloc)
    staged = staged.withColumns(
        {
            "trackers": F.filter(hosts, lambda h: urls.is_tracker(h, cfg)),
            "ads": F.filter("_addresses", lambda u: urls.is_ad(u, cfg)),
            "scripts": F.transform("_malicious", lambda e: F.substring(e["raw"], 1, 100)),
        }
    )
    raw_score = (
        F.pow(F.lit(cfg.malicious_factor), F.size("scripts"))
        * F.pow(F.lit(cfg.tracker_factor), F.size("trackers"))
        * F.pow(F.lit(cfg.ad_factor), F.size("ads"))
        * F.pow(F.lit(cfg.insecure_factor), F.col("_insecure"))
    )
    if "headers" in pages.columns:
        strict_transport = F.exists(F.map_keys("headers"), lambda k: F.lower(k) == "strict-transport-security")
        raw_score = F.when(
            F.coalesce(strict_transport, F.lit(False)),
            F.least(F.lit(1.0), raw_score * cfg.transport_security_factor),
        ).otherwise(raw_score)
    scored = F.when(F.col("_refresh"), raw_score * cfg.refresh_factor).otherwise(raw_score)
    threats = F.concat(
        F.array_repeat(F.lit("malicious_script"), F.size("scripts")),
        F.array_repeat(F.lit("insecure_script"), F.col("_insecure")),
        F.when(F.col("_refresh"), F.array(F.lit("meta_refresh"))).otherwise(F.array().cast("array<string>")),
    )
    none = F.array().cast("array<string>")
    trusted = F.col("_trusted")
    result = staged.withColumn("score", F.when(trusted, F.lit(1.0)).otherwise(scored)).withColumns(
        {
            "threats": F.when(trusted, F.array(F.lit("trusted_domain"))).otherwise(threats),
            "trackers": F.coalesce("trackers", none),
            "ads": F.coalesce("ads", none),
            "scripts": F.coalesce("scripts", none),
            "sandbox_required": F.col("score") < cfg.safety_threshold,
        }
    )
    result = result.withColumn(
        "injection_script", F.when(F.col("sandbox_required"), F.lit(cfg.protection_snippet))
    )
    keep = [
        "domain", "score", "threats", "trackers", "ads", "scripts", "sandbox_required", "injection_script",
    ]
    return result.select(*pages.columns, *keep)


def findings(analysed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per finding: kind, 1-based position in its list, value."""
    kinds = ("threats", "trackers", "ads", "scripts")

    def rows(kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda v, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("long").alias("position"), v.alias("value")),
        )

    return inline_rows(analysed, [key], F.concat(*[rows(k) for k in kinds]), "kind")
