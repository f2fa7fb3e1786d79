"""Chunk discovery over a set of bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin
from ..operators import bundles
from ..operators.store import captured_bodies, first_captures, first_per, wanted_bodies
from ..session import shared_folder, staged


def discover_chunks(
    assets: DataFrame, responses: DataFrame, folder: str | None = None, compat: bool = False,
    pages: DataFrame | None = None, firsts: DataFrame | None = None,
) -> DataFrame:
    """Chunks reachable from bundles, once per (page, url).

    ``assets`` has asset_key, content and, without ``pages``, base_url (the page).
    ``pages`` has a row for every (asset_key, base_url) and may have the flags of
    ``page_framework_hints``.  The first bundle naming a chunk becomes its parent.
    Texts are read once: what they say about chunks is stored in the shared
    folder, and the eight ways of finding chunks work on that.  Manifests are
    read once for all bundles and parsed once per site.  ``compat`` finds
    numbered chunks as a probe does.  ``firsts`` is a stored result of
    ``first_captures``.
    """
    keys = ("asset_key", "base_url")
    folder = folder or shared_folder(assets.sparkSession, "chunks")
    if firsts is None:
        firsts = staged(first_captures(responses), f"{folder}/firsts")
    inventory = firsts.select("url")
    texts = staged(bundles.bundle_facts(assets, keys if pages is None else ("asset_key",)), f"{folder}/texts")
    placed = texts if pages is None else texts.join(pages, "asset_key")
    facts = staged(
        bundles.placed_facts(placed).withColumn("site", origin(F.col("base_url"))), f"{folder}/facts")

    def of(name):
        return facts.filter(F.col("framework") == name)

    def shaped(rows, framework, source, priority, chunk_id=None, chunk_hash=None):
        absent = F.lit(None).cast("string")
        return rows.select(
            "base_url", "url", "asset_key", F.lit(priority).alias("priority"), F.col("ord").cast("int").alias("ord"),
            (F.col(chunk_id) if chunk_id else absent).alias("chunk_id"),
            (F.col(chunk_hash) if chunk_hash else absent).alias("chunk_hash"),
            F.lit(framework).alias("framework"),
            (source if not isinstance(source, str) else F.lit(source)).alias("source"))

    def per_page(rows, *more):
        """The first bundle of every page."""
        return rows.groupBy("base_url", "site", *more).agg(F.min("asset_key").alias("asset_key"))

    nextjs, vite, webpack = of("nextjs"), of("vite"), of("webpack")

    heads = per_page(nextjs.filter("manifest_url is not null"), "manifest_url")
    manifests = heads.select("site", "manifest_url").distinct()
    asked = manifests.select(F.col("manifest_url").alias("url")).union(bundles.vite_manifest_places(vite).select("url"))
    bodies = staged(wanted_bodies(captured_bodies(responses, firsts), asked, "url"), f"{folder}/manifests")
    listed = bundles.next_build_manifest_refs(manifests, bodies, ("site", "manifest_url"), base="site")

    standard = bundles.next_standard_candidates(nextjs).join(inventory, "url", "left_semi")
    vite_files = bundles.vite_manifest_refs(vite, bodies)
    mapped = bundles.webpack_chunk_refs(webpack, keys)
    hashed = bundles.hash_chunk_refs(bundles.hash_chunk_candidates(webpack, keys), inventory, keys)

    empty_handed = webpack.join(
        mapped.select("asset_key").unionByName(hashed.select("asset_key")).distinct(), "asset_key", "left_anti")
    rooted = empty_handed.groupBy("base_url", "root").agg(F.min("asset_key").alias("asset_key"))
    numbered = rooted.join(
        bundles.numbered_chunks(rooted.select("root").distinct(), inventory, compat), "root",
    ).withColumn("ord", F.col("chunk_id").try_cast("int"))

    found = [
        shaped(bundles.next_chunk_refs(nextjs, keys), "nextjs", "next_static_chunks", 0),
        shaped(heads.join(listed, ["site", "manifest_url"]), "nextjs", "next_build_manifest", 1),
        shaped(per_page(nextjs).join(standard, "site"), "nextjs", "next_standard", 2),
        shaped(per_page(vite).join(vite_files.withColumn("ord", F.col("entry") * 1000 + F.col("pos")), "site"),
               "vite", F.col("source"), 0),
        shaped(bundles.vite_asset_refs(vite, keys), "vite", "vite_asset_ref", 1),
        shaped(mapped, "webpack", "webpack5_map", 0, "chunk_id"),
        shaped(hashed, "webpack", "webpack5_hash", 1, "chunk_id", "chunk_hash"),
        shaped(numbered, "webpack", "numbered", 2, "chunk_id"),
    ]
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    return first_per(every, ["base_url", "url"], ["asset_key", "priority", "ord"])
