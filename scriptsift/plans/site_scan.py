"""The whole scan: pages and captured responses in, assets and findings out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sourcemaps
from ..operators.bundles import page_framework_hints
from ..operators.pages import inline_scripts, page_script_urls
from ..operators.reflow import best_content, reflow_minified
from ..operators.scan import scan_once_per_hash, scan_patterns
from ..operators.store import captured_bodies, first_captures, persistable_findings, with_body
from ..session import shared_folder, staged
from .chunk_discovery import discover_chunks
from .incremental import scan_incremental


@dataclass
class SiteScan:
    assets: DataFrame
    chunks: DataFrame
    source_files: DataFrame
    findings: DataFrame


def scan_site(
    spark: SparkSession,
    pages: DataFrame,
    responses: DataFrame,
    scope=(),
    cross_origin: bool = False,
    reflow: bool = True,
    folder: str | None = None,
    once_per_hash: bool = False,
    ledger: str | None = None,
    **options,
) -> SiteScan:
    """Scripts of pages, the chunks they load, their sources, and findings.

    Unlike a one-pass crawl, discovered chunks are scanned in the same run.
    Intermediate tables go to the shared folder, so a lost executor costs a
    stage and not the run.  With ``ledger``, a folder kept between runs, only pairs
    of content and detector are scanned that no run before has scanned.
    """
    folder = folder or shared_folder(spark, "site-scan")
    firsts = staged(first_captures(responses), f"{folder}/firsts")
    bodies = captured_bodies(responses, firsts)

    refs = page_script_urls(pages, ("url",), scope=scope, cross_origin=cross_origin)
    refs = staged(refs.select(F.col("url").alias("base_url"), F.col("ref_url").alias("asset_url")), f"{folder}/urls")
    wanted = refs.groupBy("asset_url").agg(F.min("base_url").alias("base_url"))
    external = with_body(wanted, bodies, "asset_url").select(
        "asset_url", "base_url", F.col("body").alias("content"), F.lit("javascript").alias("asset_type"))
    external = staged(external, f"{folder}/external")

    # A bundle is read once, but looked at from every page that loads it.
    hints = page_framework_hints(refs, "base_url", "asset_url")
    loads = refs.distinct().join(hints, "base_url").withColumnRenamed("asset_url", "asset_key")
    keyed = external.select(F.col("asset_url").alias("asset_key"), "content")
    chunks = staged(discover_chunks(keyed, responses, folder, pages=loads, firsts=firsts), f"{folder}/chunks")
    unseen = chunks.join(
        external.select(F.col("asset_url").alias("url")), "url", "left_anti",
    ).groupBy("url").agg(F.min("base_url").alias("base_url"))
    loaded = with_body(unseen, bodies, "url").select(
        F.col("url").alias("asset_url"), "base_url", F.col("body").alias("content"), F.lit("chunk").alias("asset_type"))
    scripts = staged(external.unionByName(loaded), f"{folder}/scripts")

    located = staged(sourcemaps.locate_sourcemaps(
        scripts, firsts.select("url"), ("asset_url",), "asset_url", probe=False), f"{folder}/maps")
    maps = sourcemaps.load_sourcemaps(located, bodies, ("asset_url",))
    source_files = staged(
        sourcemaps.explode_sources(maps, bodies, ("asset_url",), folder), f"{folder}/source_files")
    recovered = sourcemaps.combined_sources(source_files, ("asset_url",))

    text = F.col("content")
    reflowed = reflow_minified(text) if reflow else F.lit(None).cast("string")
    best = scripts.join(recovered, "asset_url", "left").select(
        "asset_url", best_content(F.col("source_mapped_content"), reflowed, text).alias("content"))
    inline = inline_scripts(pages, ("url",)).select("asset_url", "content")

    everything = best.unionByName(inline)
    if once_per_hash or ledger:
        # Read for the distinct texts and again for the assets that hold them.
        everything = staged(everything, f"{folder}/texts_to_scan")
    scan = scan_once_per_hash if once_per_hash else scan_patterns
    if ledger:
        scan = partial(scan_incremental, ledger=ledger)
    findings = persistable_findings(scan(everything, keys=("asset_url",), **options), ("asset_url",))
    return SiteScan(scripts, chunks, source_files, staged(findings, f"{folder}/findings"))
