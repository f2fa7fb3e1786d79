"""Scripts referenced by or embedded in HTML pages.

All of it is row local: one pass cuts the page into comment / raw-text /
script / link tokens, so a comment hides the scripts inside it and a script
hides the markup in its strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, first_by_key
from ..functions.text import strip
from ..functions.urls import resolve_url, same_origin
from .catalog import jvm_regex
from .predicates import classify_response

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_TOKENS = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\z)"
    rf"|<script\b{_ATTRIBUTES}>.*?(?:</script\s*>|\z)"
    rf"|<link\b{_ATTRIBUTES}>"
)
_HEAD = rf"(?is)\A<(?:script|link)\b({_ATTRIBUTES})>"
_ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""

# References to script files inside script text.
_IMPORTS = tuple(
    jvm_regex(rx, "idU")
    for rx in (
        r"""import\s*\(\s*["\']([^"\']+\.js[^"\']*)["\']""",
        r"""require\s*\(\s*["\']([^"\']+\.js[^"\']*)["\']""",
        r"""["\']src["\']\s*:\s*["\']([^"\']+\.js)["\']""",
    )
)
_BUILD_MANIFEST = jvm_regex(r"__BUILD_MANIFEST\s*=\s*(\{[^;]+\})", "dU")


def in_scope(url: Column, base: Column, patterns=(), cross_origin: bool = False) -> Column:
    """Same origin, or any scope expression found in the URL, or everything."""
    if cross_origin:
        return F.lit(True)
    allowed = same_origin(url, base)
    for p in patterns:
        allowed = allowed | url.rlike(jvm_regex(p, "dU"))
    return allowed


def page_tokens(html: Column) -> Column:
    """Comments, raw text, scripts and links of a page, in order."""
    return F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(0))


def _tags(tokens: Column, name: str) -> Column:
    return F.filter(tokens, lambda t: t.rlike(rf"(?i)\A<{name}\b"))


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _attributes(tag: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(tag, _HEAD, 1), F.lit(_ATTRIBUTE), F.lit(0))


def _attribute(attributes: Column, name: str) -> Column:
    """Value of an attribute, '' when it has none, null when absent."""
    mine = F.get(F.filter(attributes, lambda a: a.rlike(rf"(?i)\A{name}(?:\s*=|\z)")), 0)
    raw = F.regexp_replace(mine, r"(?s)\A[^\s=]+(?:\s*=\s*)?", "")
    return _unescape(F.regexp_replace(raw, r"""\A["']|["']\z""", ""))


def script_sources(html: Column) -> Column:
    """Trimmed ``src`` of every external script, in page order."""
    return bind(page_tokens(html), _script_sources)


def _script_sources(tokens: Column) -> Column:
    sources = F.transform(_tags(tokens, "script"), lambda t: bind(_attributes(t), lambda a: _attribute(a, "src")))
    return F.transform(F.filter(sources, lambda s: s.isNotNull()), strip)


def inline_texts(html: Column) -> Column:
    """Distinct, trimmed, non-blank texts of scripts without ``src``."""
    return bind(page_tokens(html), _inline_texts)


def _inline_texts(tokens: Column) -> Column:
    inline = F.filter(
        _tags(tokens, "script"), lambda t: bind(_attributes(t), lambda a: _attribute(a, "src")).isNull())
    bodies = F.transform(
        inline, lambda t: strip(F.regexp_replace(F.regexp_replace(t, _HEAD, ""), r"(?i)</script\s*>\z", "")))
    return F.array_distinct(F.filter(bodies, lambda b: b != ""))


def preload_targets(html: Column) -> Column:
    """``href`` of preload links that announce a script."""
    return bind(page_tokens(html), _preload_targets)


def _preload_targets(tokens: Column) -> Column:
    def target(tag):
        return bind(_attributes(tag), lambda a: bind(
            F.struct(
                F.lower(_attribute(a, "rel")).alias("rel"),
                F.lower(F.coalesce(_attribute(a, "as"), F.lit(""))).alias("as"),
                strip(F.coalesce(_attribute(a, "href"), F.lit(""))).alias("href"),
            ),
            lambda l: F.when(
                l["rel"].contains("preload") & ((l["as"] == "script") | l["href"].endswith(".js")), l["href"]),
        ))

    return F.filter(F.transform(_tags(tokens, "link"), target), lambda h: h.isNotNull())


def import_targets(script: Column) -> Column:
    """Script files named by import(), require() or a "src" property."""
    return F.concat(*[F.regexp_extract_all(script, F.lit(rx), F.lit(1)) for rx in _IMPORTS])


def manifest_targets(script: Column) -> Column:
    """Files of the first build manifest assignment, as site-root paths."""
    refs = F.regexp_extract_all(
        F.regexp_extract(script, _BUILD_MANIFEST, 1), F.lit(r"""["']([^"']*\.js)["']"""), F.lit(1))
    rooted = F.transform(refs, lambda r: F.when(r.rlike(r"\A(?:https?:)?//"), r).otherwise(
        F.concat(F.lit("/_next/static/"), F.ltrim(r, F.lit("/")))))
    return rooted


def _resolved(targets: Column, base: Column, page: Column, patterns, cross_origin) -> Column:
    """Absolute in-scope URLs, nulls dropped, repeats kept."""
    urls = F.transform(targets, lambda t: resolve_url(base, t))
    return F.filter(urls, lambda u: u.isNotNull() & in_scope(u, page, patterns, cross_origin))


def _refs(pages, keys, targets, base, patterns, cross_origin) -> DataFrame:
    urls = F.array_distinct(_resolved(targets, F.col(base), F.col("url"), patterns, cross_origin))
    return pages.select(*keys, F.posexplode(urls).alias("ord", "ref_url"))


def script_refs(pages: DataFrame, keys=("page_id", "url"), base="url", scope=(), cross_origin=False) -> DataFrame:
    return _refs(pages, keys, script_sources(F.col("html")), base, scope, cross_origin)


def preload_refs(pages: DataFrame, keys=("page_id", "url"), base="url", scope=(), cross_origin=False) -> DataFrame:
    return _refs(pages, keys, preload_targets(F.col("html")), base, scope, cross_origin)


def inline_import_refs(pages: DataFrame, keys=("page_id", "url"), base="url", scope=(), cross_origin=False) -> DataFrame:
    targets = F.flatten(F.transform(inline_texts(F.col("html")), import_targets))
    return _refs(pages, keys, targets, base, scope, cross_origin)


def page_next_manifest_refs(scripts: DataFrame, keys=("page_id", "url"), content="content", base="url") -> DataFrame:
    return _refs(scripts, keys, manifest_targets(F.col(content)), base, (), True)


def page_script_urls(pages: DataFrame, keys=("page_id", "url"), base="url", scope=(), cross_origin=False) -> DataFrame:
    """Every script URL of a page, once, labelled with how it was found first:
    script tags, then preload links, then imports in inline scripts."""
    def labelled(targets, how):
        urls = _resolved(targets, F.col(base), F.col("url"), scope, cross_origin)
        return F.transform(urls, lambda u: F.struct(u.alias("ref_url"), F.lit(how).alias("found_by")))

    found = bind(page_tokens(F.col("html")), lambda tokens: F.concat(
        labelled(_script_sources(tokens), "script"),
        labelled(_preload_targets(tokens), "preload"),
        labelled(F.flatten(F.transform(_inline_texts(tokens), import_targets)), "inline_import"),
    ))
    return pages.select(*keys, F.posexplode(first_by_key(found, "ref_url")).alias("ord", "ref")).select(
        *keys, "ord", "ref.ref_url", "ref.found_by")


def inline_scripts(pages: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """One row per distinct inline script, addressed as ``page#inline-script-i``.

    With a ``content_type`` column, a page that is itself a script counts as one
    inline script, and anything that is neither is ignored.
    """
    texts = inline_texts(F.col("html"))
    if "content_type" in pages.columns:
        kind = classify_response(F.col("content_type"), F.col("url"))
        whole = strip(F.col("html"))
        texts = F.when(kind["is_html"], texts).when(
            kind["is_javascript"] & (whole != ""), F.array(whole)).otherwise(F.expr("cast(array() as array<string>)"))
    return pages.select(*keys, F.posexplode(texts).alias("ord", "content")).select(
        *keys, "ord", "content",
        F.concat(F.col("url"), F.lit("#inline-script-"), F.col("ord").cast("string")).alias("asset_url"))


def js_import_edges(assets: DataFrame, url="url", content="content", base=None, scope=(), cross_origin=False) -> DataFrame:
    """Distinct (parent, child) import edges; one hop."""
    targets = import_targets(F.col(content))
    children = F.array_distinct(
        _resolved(targets, F.col(url), F.col(base or url), scope, cross_origin))
    return assets.select(F.col(url).alias("parent_url"), F.explode(children).alias("child_url")).distinct()


def framework_labels(text: Column) -> Column:
    """All frameworks whose traces occur in a page and its script URLs."""
    low = F.lower(text)
    return F.array_compact(F.array(
        F.when(text.contains("_next/") | text.contains("__NEXT_DATA__"), F.lit("nextjs")),
        F.when(low.contains("vite"), F.lit("vite")),
        F.when(low.contains("webpack"), F.lit("webpack")),
        F.when(low.contains("remix"), F.lit("remix")),
        F.when(low.contains("nuxt"), F.lit("nuxt")),
    ))


def detect_frameworks(pages: DataFrame, keys=("page_id", "url"), base="url", scope=(), cross_origin=False) -> DataFrame:
    """(page, framework) from the page text and the URLs of its scripts."""
    urls = bind(page_tokens(F.col("html")), lambda tokens: F.array_distinct(F.concat(*[
        _resolved(t, F.col(base), F.col("url"), scope, cross_origin)
        for t in (
            _script_sources(tokens), _preload_targets(tokens),
            F.flatten(F.transform(_inline_texts(tokens), import_targets)))
    ])))
    text = F.concat("html", F.array_join(urls, " "))
    return pages.select(*keys, F.posexplode(bind(text, framework_labels)).alias("ord", "framework"))
