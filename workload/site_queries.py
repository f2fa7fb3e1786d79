"""The whole site scan over pages and a capture, and the files it writes.

Pages of 24 sites load scripts of their own and shared ones of a content
network.  Some sites run Next.js with bundles whose text does not say so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptsift.plans.site_scan import scan_site

from .corpus import Derived, keep, keyed, pick, text
from .duck import findings_by_line
from .registry import query

PAGES = Derived("customer", (
    keyed("c_custkey"),
    (
        ("page_id", "k"), ("url", text("https://s~k%24~.example.com/p~k~.html")),
        ("html", pick("k % 3", (
            '<script src="/_next/static/chunks/m~k%5~.js"></script><script src="https://cdn.example.net/lib~k%6~.js"></script>',
            '<script src="/app~k%7~.js"></script><script src="https://cdn.example.net/lib~k%6~.js"></script><script>eval(i~k%9~)</script>',
            '<script src="/map~k%5~.js"></script>',
        ))),
    ),
))
CAPTURE = Derived("orders", (
    keyed("o_orderkey"),
    (*keep("k"), ("n", "cast(floor(k / 8) as bigint) % 24"), ("j", "cast(floor(k / 192) as bigint)")),
    (
        *keep("k"), ("n", "cast(n as string)"), ("j4", "cast(j % 4 as string)"), ("j5", "cast(j % 5 as string)"),
        ("j6", "cast(j % 6 as string)"), ("j7", "cast(j % 7 as string)"),
    ),
    (
        ("response_id", "k"),
        ("url", pick("k % 8", (
            "https://s~n~.example.com/_next/static/chunks/m~j5~.js",
            "https://s~n~.example.com/_next/static/b~n~/_buildManifest.js",
            "https://s~n~.example.com/_next/static/c/x~j4~.js",
            "https://s~n~.example.com/_next/static/chunks/main.js",
            "https://cdn.example.net/lib~j6~.js",
            "https://s~n~.example.com/c/lazy~j6~.chunk.js",
            "https://s~n~.example.com/app~j7~.js",
            "https://s~n~.example.com/map~j5~.js",
        ))),
        ("content", pick("k % 8", (
            '{"buildId":"b~n~"}',
            'self.__BUILD_MANIFEST={"/":["c/x~j4~.js"]}',
            "document.cookie",
            "Math.random()",
            '__webpack_require__.p="/c/";u=({1:"lazy~j6~"}[e]); el.innerHTML = q',
            "eval(z~n~)",
            'localStorage.getItem("key~j7~")',
            'run()~nl~//# sourceMappingURL=data:application/json,{"sources":["a.ts"],"sourcesContent":["document.write(v~n~)"]}',
        ))),
        ("status_code", "CASE WHEN k % 13 = 5 THEN 404 ELSE 200 END"),
        ("error", "CASE WHEN k % 29 = 3 THEN 'Timeout' END"),
        ("captured_at", "MICROS(1704067200000000 + k * 1000000)"),
    ),
))

_P = f"(SELECT page_id AS k, url AS page, regexp_extract(url, '^https://[^/]*') AS site FROM {PAGES.sql})"
_B = (f"(SELECT url, min_by(content, captured_at) AS body FROM {CAPTURE.sql} "
      "WHERE error IS NULL AND status_code BETWEEN 200 AND 399 GROUP BY url)")
_REFS = f"""(
  SELECT page, site, k, site || '/_next/static/chunks/m' || k % 5 || '.js' AS url FROM {_P} WHERE k % 3 = 0
  UNION ALL SELECT page, site, k, site || '/app' || k % 7 || '.js' FROM {_P} WHERE k % 3 = 1
  UNION ALL SELECT page, site, k, site || '/map' || k % 5 || '.js' FROM {_P} WHERE k % 3 = 2
  UNION ALL SELECT page, site, k, 'https://cdn.example.net/lib' || k % 6 || '.js' FROM {_P} WHERE k % 3 < 2)"""
_WITH = f"""b AS MATERIALIZED {_B}, loaded AS MATERIALIZED (SELECT r.*, body FROM {_REFS} r JOIN b USING (url)),
chunks AS MATERIALIZED (
  SELECT l.page, l.site || '/_next/static/' || regexp_extract(m.body, '"(c/[^"]+)"', 1) AS url, 'nextjs' AS framework, 'next_build_manifest' AS source
    FROM loaded l JOIN b m ON l.k % 3 = 0 AND contains(l.body, 'buildId')
    AND m.url = l.site || '/_next/static/' || regexp_extract(l.body, '"buildId":"([^"]+)"', 1) || '/_buildManifest.js'
  UNION ALL SELECT DISTINCT l.page, m.url, 'nextjs', 'next_standard' FROM loaded l JOIN b m ON l.k % 3 = 0
    AND m.url = l.site || '/_next/static/chunks/main.js'
  UNION ALL SELECT page, site || '/c/lazy' || k % 6 || '.chunk.js', 'webpack', 'webpack5_map' FROM loaded WHERE k % 3 = 1 AND url LIKE 'https://cdn%'),
scripts AS MATERIALIZED (
  SELECT DISTINCT url, body, 'javascript' AS asset_type FROM loaded
  UNION ALL SELECT DISTINCT c.url, b.body, 'chunk' FROM chunks c JOIN b USING (url) WHERE c.url NOT IN (SELECT url FROM loaded))"""


def site(spark, sf):
    return scan_site(spark, PAGES.frame(spark, sf), CAPTURE.frame(spark, sf), cross_origin=True)


@query("site_assets", f"WITH {_WITH} SELECT url AS asset_url, asset_type, md5(body) AS digest FROM scripts")
def site_assets(spark, sf):
    return site(spark, sf).assets.select("asset_url", "asset_type", F.md5("content").alias("digest"))


@query("site_chunks", f"WITH {_WITH} SELECT page AS base_url, url, framework, source FROM chunks")
def site_chunks(spark, sf):
    return site(spark, sf).chunks.select("base_url", "url", "framework", "source")


_SCANNED = """(SELECT url AS asset_url, CASE WHEN contains(body, 'sourceMappingURL') THEN regexp_extract(body, 'document.write[^"]*') ELSE body END AS content FROM scripts
  UNION ALL SELECT page || '#inline-script-0', 'eval(i' || k % 9 || ')' FROM {p} WHERE k % 3 = 1)""".replace("{p}", _P)


@query("site_findings", f"WITH {_WITH}, {findings_by_line(_SCANNED, 'asset_url')} SELECT asset_url, pattern_name, value FROM f")
def site_findings(spark, sf):
    return site(spark, sf).findings.select("asset_url", "pattern_name", "value")


# One script per supplier; every fiftieth announces a source of more than two million characters.
_LONG_PAGES = Derived("supplier", (
    keyed("s_suppkey"),
    (("page_id", "k"), ("url", text("https://l~k~.example.com/")), ("html", text('<script src="/m~k~.js"></script>'))),
))
_LONG_CAPTURE = Derived("supplier", (
    keyed("s_suppkey"),
    (
        ("response_id", "k"), ("url", text("https://l~k~.example.com/m~k~.js")),
        ("content", "concat('//# sourceMappingURL=data:application/json,{\"sources\":[\"a.ts\"],\"sourcesContent\":[\"', "
                    "repeat('x', cast(CASE WHEN k % 50 = 0 THEN 2000100 ELSE 10 + k % 7 END as int)), ' eval(q', cast(k as string), ')\"]}')"),
        ("status_code", "200"), ("error", "cast(NULL as string)"), ("captured_at", "MICROS(1704067200000000 + k * 1000000)"),
    ),
))


@query("long_source_findings", f"SELECT url || 'm' || page_id || '.js' AS asset_url, 'eval_call' AS pattern_name, 'eval(' AS value FROM {_LONG_PAGES.sql}")
def long_source_findings(spark, sf):
    scan = scan_site(spark, _LONG_PAGES.frame(spark, sf), _LONG_CAPTURE.frame(spark, sf), finding_types=["dom_sink"])
    return scan.findings.select("asset_url", "pattern_name", "value")
