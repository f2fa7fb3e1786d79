"""Captured-web tables derived from the driver's tables.

The driver's tables hold few scripts, so assets, responses, pages and maps are
computed from their keys.  Each derived table is a chain of projections over one
base table, written once in expressions both engines read, so Spark and the SQL
oracle see the same rows.  Every row of the base table takes part.

Templates: ``~h16~`` is 16 characters of the key's md5 (``H`` upper case, ``g``
a second digest), ``~k~`` the key, ``~k%9~`` the key modulo 9, ``~nl~`` a line
feed, ``~q~`` a single quote.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .registry import dealt

NL = "chr(10)"


def _placeholder(name: str) -> str:
    if name == "k":
        return "cast(k as string)"
    if name == "nl":
        return NL
    if name == "q":
        return "chr(39)"
    if name.startswith("k%"):
        return f"cast(k % {name[2:]} as string)"
    if name in ("uuid", "UUID"):
        cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
        col = "h" if name == "uuid" else "upper(h)"
        return "concat(" + ", '-', ".join(f"substr({col}, {a}, {n})" for a, n in cut) + ")"
    if re.fullmatch(r"[hHg]\d*", name):
        col = {"h": "h", "H": "upper(h)", "g": "g"}[name[0]]
        return f"substr({col}, 1, {name[1:]})" if name[1:] else col
    return name  # a column of the previous projection


def filled(expr: str, *templates: str) -> str:
    """``expr`` with every placeholder of the templates replaced."""
    names = sorted({n for t in templates for n in t.split("~")[1::2]})
    for name in names:
        expr = f"replace({expr}, '~{name}~', {_placeholder(name)})"
    return expr


def text(template: str) -> str:
    return filled(f"'{template}'", template)


def choice(selector: str, templates) -> str:
    """The template a selector (counting from 0) points at, not filled in."""
    return f"split_part('{'@@@'.join(templates)}', '@@@', cast({selector} as int) + 1)"


def pick(selector: str, templates) -> str:
    return filled(choice(selector, templates), *templates)


def tokens(template: str, names) -> str:
    """Spark: a template as an array of literals, each with the place in ``names`` of what follows it; 0 is nothing."""
    pieces = template.split("~")
    pairs = [(piece, names.index(name) + 1) for piece, name in zip(pieces[::2], pieces[1::2])] + [(pieces[-1], 0)]
    return "array(" + ", ".join(f"named_struct('t', '{t}', 'v', {v})" for t, v in pairs if t or v) + ")"


def joined(parts: str, names) -> str:
    """Spark: arrays of ``tokens`` put together, their values computed once a row.

    ``filled`` searches the whole text for every name there is, this takes time in
    proportion to the text.  Needs a column ``u``, the upper-case ``h``.
    """
    values = ", ".join(["''"] + [_placeholder(n).replace("upper(h)", "u") for n in names])
    return (f"transform(array(array({values})), vs -> "
            f"array_join(transform({parts}, p -> concat(p.t, get(vs, p.v))), ''))[0]")


@dataclass(frozen=True)
class Derived:
    table: str
    steps: tuple  # each step: tuple of (name, expression)
    spark_steps: tuple = ()  # other steps to the same rows, for Spark alone

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        first = {c for _, e in self.steps[0] for c in re.findall(r"[a-z]\w*", e)}
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        df = dealt(df.select(*[c for c in df.columns if c in first]))
        return self.project(df)

    def project(self, df: DataFrame) -> DataFrame:
        """The same projections over a given (for example streaming) frame."""
        for step in self.spark_steps or self.steps:
            df = df.selectExpr(*[f"{_spark(e)} AS {n}" for n, e in step])
        return df

    @property
    def sql(self) -> str:
        sql = self.table
        for step in self.steps:
            cols = ", ".join(f"{_duck(e)} AS {n}" for n, e in step)
            sql = f"(SELECT {cols} FROM {sql})"
        return sql


def _spark(expr: str) -> str:
    return expr.replace("MICROS(", "timestamp_micros(")


def _duck(expr: str) -> str:
    return expr.replace("MICROS(", "make_timestamp(")


def keyed(key: str, *extra) -> tuple:
    return (
        ("k", key), ("h", f"md5(cast({key} as string))"),
        ("g", f"md5(concat('g', cast({key} as string)))"), *extra,
    )


def keep(*names):
    return tuple((n, n) for n in names)


# One fragment per detector, in catalog order, then near misses.
FRAGMENTS = (
    'var ak="AKIA~H16~";',
    'var aws_secret="~h~~g8~";',
    'mws("amzn.mws.~uuid~")',
    'var gk="AIza~h~~g3~";',
    'cid="~k~-~h~.apps.googleusercontent.com"',
    'gh("ghp_~h~~g4~")',
    'cfg={github:"~h~~g8~"}',
    'stripe("sk_live_~h~")',
    'rk="rk_test_~g~"',
    'slack("xoxb-~h~")',
    'hook("https://hooks.slack.com/services/T~H8~/B~H10~/~h24~")',
    'var j="eyJ~h16~.~h~.~g16~";',
    'pem="-----BEGIN RSA PRIVATE KEY-----"',
    'fb="AAAA~h7~:~h~~h~~h~~h~~g12~"',
    'sg="SG.~h22~.~h~~g11~"',
    'tw="AC~h~"',
    'tk="SK~g~"',
    'mc="~h~-us~k%20~"',
    'mg="key-~h~"',
    'heroku_key="~UUID~"',
    'login({password: "~h12~"})',
    'db("https://user~k%90~:~h8~@db~k%9~.example.com/main")',
    'npm="npm_~h~~g4~"',
    'bot="M~h23~.~g6~.~h27~"',
    'az="DefaultEndpointsProtocol=https;AccountName=acct~k%40~;AccountKey=~h~~h~~g24~"',
    'get("/api/v1/items~k%300~")',
    'gql("https://gw~k%30~.example.com/graphql?op=~k%7~")',
    'fetch("list~k%500~.json?page=1")',
    'sock("wss://live~k%20~.example.com/s~k~")',
    'nav("/catalog/items/~k%900~")',
    'doc("https://docs.example.org/p~k%700~")',
    'go("/admin/panel~k%80~")',
    'bk="https://bkt~k%60~.s3.us-east-1.amazonaws.com/f.png"',
    'gs="storage.googleapis.com/bkt~k%60~"',
    'ab="acct~k%40~.blob.core.windows.net"',
    'host="staging.host~k%50~.com"',
    'ip="10.~k%250~.~k%99~.7"',
    'dev="http://localhost:~k%9~000/dbg"',
    'el~k%9~.innerHTML = v;',
    'el.outerHTML += v~k~;',
    'document.write(v~k~)',
    'eval(v~k~)',
    'setTimeout("go~k~()", 5)',
    'new Function("a", b)',
    'el.insertAdjacentHTML ("x", v)',
    'im.src = v~k~;',
    '$("#d~k%30~").html(v~k%8~)',
    'window.location.href = v~k~',
    'location.replace(v)',
    'return <b dangerouslySetInnerHTML={{__html:v}}/>',
    'fr.srcdoc = v',
    'w.postMessage(m~k%9~, o)',
    'w.postMessage({a:1}, "*")',
    'window.onmessage = h~k~',
    'addEventListener("message", function(e){run(e.data~k%5~)})',
    'o.__proto__["x"]',
    'o.constructor.prototype.y',
    'Object.assign(t~k%4~, request.body)',
    'localStorage.getItem("pref~k%60~")',
    'sessionStorage.getItem("step~k%60~")',
    'localStorage.setItem("token~k%9~", t)',
    'c = document.cookie',
    'CryptoJS.MD5(v~k~)',
    'sha1(v)',
    'var iv = "~h~";',
    'Math.random()',
    # near misses
    'medieval(v); retrieval(1)',
    'x="XAKIA~H16~"; y="https://cdn.example.org/lib~k%9~.js"',
    'addEventListener("message", function(e){if(e.origin==o)run(e)})',
    'v="110.~k%99~.1.2"; z="172.33.0.1"; t="ab"; password=""',
)
N_FRAGMENTS = len(FRAGMENTS)

# Scripts: three fragments each (the first one twice), every fifth on one long
# line, and a few with thousands of lines before the last fragment.
_PAD = f"CASE WHEN k % 500 = 7 THEN repeat(concat('x();', {NL}), 3000) ELSE '' END"
_BUNDLE_KEYS = (
    ("asset_key", "k"),
    ("asset_url", text("https://app~k%50~.example.com/static/js/b~k~.js")),
    ("project_id", "CASE WHEN k % 3 = 0 THEN 0 ELSE c % 40 END"),
)
_NAMES = (*sorted({n for t in FRAGMENTS for n in t.split("~")[1::2]} | {"k", "nl"}), "pad")


def _chosen(selector: str) -> str:
    return f"element_at(array({', '.join(tokens(t, _NAMES) for t in FRAGMENTS)}), cast({selector} as int) + 1)"


def _line(*parts: str) -> str:
    return f"concat({', '.join(p if p in ('fa', 'fb', 'fc') else tokens(p, _NAMES) for p in parts)})"


BUNDLES = Derived("orders", (
    keyed(
        "o_orderkey", ("c", "o_custkey"),
        ("fa", choice(f"o_orderkey % {N_FRAGMENTS}", FRAGMENTS)),
        ("fb", choice(f"(o_orderkey * 7 + 3) % {N_FRAGMENTS}", FRAGMENTS)),
        ("fc", choice(f"cast(floor(o_orderkey / {N_FRAGMENTS}) as bigint) % {N_FRAGMENTS}", FRAGMENTS)),
    ),
    (
        *keep("k", "h", "g", "c"),
        ("line", f"CASE WHEN k % 5 = 0 THEN concat(fa, ';', repeat('var q=1;', 60), fb, ';', fc) "
                 f"ELSE concat('// bundle ~k~', {NL}, fa, {NL}, '  function f(a){{return a}}', {NL}, "
                 f"fb, {NL}, {NL}, fa, {NL}, '~pad~var z=1;', {NL}, fc, {NL}) END"),
    ),
    (
        *keep("k", "c"),
        ("body", filled("line", "~k~", *FRAGMENTS)),
        ("pad", _PAD),
    ),
    (
        *_BUNDLE_KEYS,
        ("content", "replace(body, '~pad~', pad)"),
    ),
), (
    keyed(
        "o_orderkey", ("c", "o_custkey"),
        ("fa", _chosen(f"o_orderkey % {N_FRAGMENTS}")),
        ("fb", _chosen(f"(o_orderkey * 7 + 3) % {N_FRAGMENTS}")),
        ("fc", _chosen(f"cast(floor(o_orderkey / {N_FRAGMENTS}) as bigint) % {N_FRAGMENTS}")),
    ),
    (*keep("k", "h", "g", "c", "fa", "fb", "fc"), ("u", "upper(h)"), ("pad", _PAD)),
    (
        *_BUNDLE_KEYS,
        ("content", joined(
            f"CASE WHEN k % 5 = 0 THEN {_line('fa', ';' + 'var q=1;' * 60, 'fb', ';', 'fc')} ELSE "
            + _line("// bundle ~k~~nl~", "fa", "~nl~  function f(a){return a}~nl~", "fb", "~nl~~nl~", "fa",
                    "~nl~~pad~var z=1;~nl~", "fc", "~nl~") + " END", _NAMES)),
    ),
))

# Pages with every way of naming a script.
SITE_PAGES = Derived("customer", (
    keyed("c_custkey"),
    (
        *keep("k"),
        ("url", text("https://shop~k%30~.example.com/dir/p~k~.html")),
        ("trace", pick("k % 6", (
            '<script id="__NEXT_DATA__" type="application/json">{"page":"/p~k~"}</script>',
            '<i data-x="/@vite/client"></i>',
            '<i data-x="webpackJsonp"></i>',
            "<i>__remixContext</i>",
            "<i>window.__NUXT__</i>",
            "<i>plain invite</i>",
        ))),
    ),
    (
        ("page_id", "k"), ("url", "url"),
        ("html", text(
            '<!DOCTYPE html><html><head><title>a <script src="/no.js"> b</title>~trace~'
            '<!-- <script src="/hidden~k~.js"></script> -->'
            '<link rel="modulepreload" href="/chunks/m~k%40~.js">'
            "<link as=script rel=~q~preload~q~ href=../pre/~k~ >"
            '<link rel="preload" as="style" href="/s.css"><link rel="stylesheet" href="/t.js">'
            '<script src="/static/app~k%7~.js"></script>'
            '<script async src=~q~lib/l~k~.js?x=1&amp;y=2~q~></script>'
            "<script src=//cdn~k%5~.example.net/v.js></script>"
            '<SCRIPT defer SRC = "https://shop~k%30~.example.com/static/app~k%7~.js"></SCRIPT>'
            '<script src="../up/./u~k%9~.js"></script><script src=""></script></head><body>'
            '<script>import("./lazy~k%11~.js");</script>'
            '<script type="module"> var x = require(~q~/vendor/~k%3~.js?v=2~q~); "src": "img/i~k~.js" </script>'
            "<script>  ~nl~ </script>"
            '<script>import("./lazy~k%11~.js");</script>'
            '<script>var s="</p>"; el~k%4~.innerHTML = s; self.__BUILD_MANIFEST = '
            '{"/":["static/chunks/a~k%6~.js","https://cdn.example.net/b.js"],"/x":["/c~k~.js"]}; done()</script>'
            "</body></html>")),
    ),
))

# Responses of a live capture: many copies, several kinds, some failures.
RESPONSES = Derived("events", (
    keyed("event_id", ("ts", "cast(ts as timestamp)"), ("u", "user_id"), ("t", "event_type")),
    (
        *keep("k", "ts", "t"),
        ("b", "CASE WHEN k % 3 = 0 THEN 0 ELSE k % 700 END"),
        ("url", pick("k % 6", (
            "https://site~k%20~.example.com/a~k%97~.js",
            "https://site~k%20~.example.com/page~k%50~",
            "https://site~k%20~.example.com/x~k%31~.JS?v=1",
            "https://site~k%20~.example.com/m~k%40~.js.map",
            "https://site~k%20~.example.com/b~k%60~.js??",
            "https://site~k%20~.example.com",
        ))),
        ("content_type", "CASE k % 8 WHEN 0 THEN 'application/javascript; charset=utf-8' WHEN 1 THEN 'text/html' "
                         "WHEN 2 THEN 'TEXT/JAVASCRIPT' WHEN 3 THEN 'image/png' WHEN 4 THEN '' "
                         "WHEN 5 THEN 'application/json' WHEN 6 THEN 'x/ecmascript2' "
                         "ELSE 'text/html; x=text/javascript' END"),
    ),
    (
        ("response_id", "k"), ("url", "url"),
        ("status_code", "CASE t WHEN 'error' THEN 500 WHEN 'signup' THEN 301 WHEN 'view' THEN 404 ELSE 200 END"),
        ("content",
         "CASE WHEN k % 41 = 0 THEN '  ' ELSE concat('eval(x', cast(b as string), ');', chr(10), 'var token=\"', "
         "md5(cast(b as string)), '\";', chr(10), 'el.innerHTML = y;', chr(10), "
         "CASE WHEN b % 2 = 0 THEN 'Math.random()' ELSE 'document.cookie' END) END"),
        ("content_type", "content_type"), ("final_url", "url"),
        ("error", "CASE WHEN k % 17 = 0 THEN 'Timeout' WHEN k % 19 = 0 THEN '' END"),
        ("captured_at", "ts"),
    ),
))

# Stored tables.  Project 0 owns a third of everything.
PROJECTS = Derived("supplier", (
    keyed("s_suppkey"),
    (
        ("id", "k"), ("name", text("proj-~k~")), ("target_url", text("https://t~k%30~.example.com")),
        ("scope_patterns", "CASE k % 3 WHEN 0 THEN '[\"a.*b\",\"c\"]' WHEN 1 THEN '[]' ELSE 'not json' END"),
        ("created_at", "CASE WHEN k % 11 = 4 THEN NULL ELSE MICROS(1704067200000000 + (k % 29) * 86400000000) END"),
    ),
))
ASSETS = Derived("customer", (
    keyed("c_custkey"),
    (
        ("id", "k"), ("project_id", "CASE WHEN k % 3 = 0 THEN 0 ELSE k % 120 END"),
        ("url", text("https://t~k%30~.example.com/static/some/long/folder/name/for/listing/a~k~.js?v=~k%5~")),
        ("asset_type", "CASE WHEN k % 4 = 0 THEN 'chunk' ELSE 'javascript' END"),
        ("content_hash", "substr(h, 1, 16)"),
        ("chunk_id", "CASE WHEN k % 4 = 0 THEN cast(k % 17 as string) END"),
        ("parent_url", "CASE WHEN k % 4 = 0 AND k >= 3 THEN concat('https://t', cast((k - 3) % 30 as string), "
                       "'.example.com/static/some/long/folder/name/for/listing/a', cast(k - 3 as string), "
                       "'.js?v=', cast((k - 3) % 5 as string)) END"),
        ("is_chunk", "k % 4 = 0"), ("has_sourcemap", "k % 7 = 0"), ("status_code", "200"),
        ("content_length", "k * 3"),
        ("discovered_at", "MICROS(1704067200000000 + (k % 29) * 3600000000)"),
    ),
))
# Who led to whom, by project: chains, a hub with a third of all assets, circles, and a long chain.
_LED = "concat('https://t', cast({0} % 30 as string), '.example.com/led/a', cast({0} as string), '.js')"
PROVENANCE = Derived("customer", (
    (
        ("id", "c_custkey"), ("p", "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 40 END"),
        ("n", "cast(floor(c_custkey / 40) as bigint)"),
    ),
    (
        *keep("id", "p", "n"),
        ("parent", "CASE WHEN p = 0 THEN CASE WHEN id % 3 = 0 AND id > 3 THEN 3 END "
                   "WHEN p = 1 THEN CASE WHEN n % 9 >= 3 THEN id - 120 ELSE id + 240 END "
                   "WHEN p = 2 THEN CASE WHEN n % 240 >= 3 THEN id - 120 END "
                   "WHEN n % 16 >= 3 THEN id - 120 END"),
    ),
    (
        ("id", "id"), ("project_id", "p"), ("url", _LED.format("id")), ("asset_type", "'chunk'"), ("chunk_id", "cast(n as string)"),
        ("parent_url", "CASE WHEN parent IS NOT NULL THEN " + _LED.format("parent") + " END"),
    ),
))
FINDINGS = Derived("orders", (
    keyed("o_orderkey", ("c", "o_custkey")),
    (
        ("id", "k"), ("project_id", "CASE WHEN k % 3 = 0 THEN 0 ELSE c % 120 END"),
        ("asset_id", "CASE WHEN k % 3 = 0 THEN 3 ELSE c + 40 END"),
        ("finding_type", "CASE k % 4 WHEN 0 THEN 'secret' WHEN 1 THEN 'endpoint' WHEN 2 THEN 'dom_sink' ELSE 'storage' END"),
        ("category", text("cat~k%9~")),
        ("value", "CASE WHEN k % 6 = 0 THEN concat(repeat(md5(cast(k % 200 as string)), 20), cast(k as string)) "
                  "ELSE md5(cast(k % 2000 as string)) END"),
        ("context", "repeat(h, 40)"),
        ("line_number", "cast(k % 900 + 1 as int)"),
        ("confidence", "CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END"),
        ("severity", "CASE k % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' "
                     "WHEN 4 THEN 'info' WHEN 5 THEN 'odd' ELSE 'medium' END"),
        ("pattern_name", text("p~k%66~")),
        ("is_bookmarked", "k % 50 = 0"), ("notes", "''"),
        ("discovered_at", "MICROS(1704067200000000 + (k % 29) * 3600000000)"),
        ("p_ord", "cast(k % 66 as int)"), ("m_ord", "cast(k as int)"),
    ),
))

# References of every form against bases of several forms.
LINKS = Derived("orders", (
    keyed("o_orderkey"),
    (
        *keep("k"),
        ("base", pick("k % 5", (
            "https://a~k%9~.example.com/x/y/z.html?q=1#f", "http://b.example.com:8080", "https://u:p@c.example.com/",
            "HTTPS://D.example.com/one/", "https://e.example.com/one//two/./three"))),
        ("ref", pick("cast(floor(k / 5) as bigint) % 22", (
            "a/b~k%9~.js", "../x.js", "/root//y~k%7~.js", "?q=~k~", "#f~k~", "//cdn.example.net/z.js",
            "https://o.example.org/p/../q", "data:text/plain,x", "javascript:void(0)", "../../../../z", "./", "..",
            "HTTP://Up.example.org/q", "mailto:a@b.c", "", "  spaced.js ", "a/./b/../c.js?d=/../e#g", "/../../t",
            "x//y///z.js", ".", "https:rel.js", "a;b/..;c/d"))),
    ),
))

# Bundles of each bundler, and what a capture of their sites holds.
BUNDLERS = Derived("part", (
    keyed("p_partkey"),
    (
        ("asset_key", "k"),
        ("url", text("https://app~k%12~.example.com/js/b~k~.js")),
        ("base_url", text("https://app~k%12~.example.com/shop/index.html")),
        ("content", pick("k % 8", (
            'x="_next/";a="/_next/static/chunks/pg~k%40~.js";b={"buildId":"bld~k%12~"};'
            'c="/_next/static/chunks/main-~k%5~.js";d="/_next/static/chunks/pg~k%40~.js"',
            'x="_next/";s="/_next/static/alt~k%3~/_buildManifest.js"',
            'import Vite; x="/static/assets/v~k%30~.js"; y=~q~../assets/w~k%20~.js~q~; z="./assets/w~k%20~.css"',
            '__webpack_require__.p = "/static/js/"; u=({~k%50~:"main~k%9~",60: "vendor.js","async-~k%4~":"page~k%4~",'
            '61:"img.png",60:"vendor~k%9~.js"}[e]||e)+".chunk.js"; v=({70:"late"} [chunkId])',
            '__webpack_require__.p=~q~https://cdn~k%4~.example.net/js/~q~; h={~k%50~:"~h10~",63:"~g8~",64:"abc"}',
            'webpackJsonp; u=({1:"~h8~",2:"~g8~"}[t])+".js"',
            '__webpack_require__.p="/num~k%6~/"; none({})',
            "plain(~k~)",
        ))),
    ),
))
CAPTURE = Derived("orders", (
    keyed("o_orderkey"),
    (
        *keep("k"),
        ("body", pick("k % 3", (
            'self.__BUILD_MANIFEST={"/":["static/chunks/x~k%12~.js","/css/a.css","https://z.example.net/q~k%3~.js","/c~k%7~.js"]}',
            '{"a":{"file":"assets/f~k%12~.js","imports":["assets/i~k%7~.js","style.css"]},"b":{"file":"/s~k%5~.css"},'
            '"c":{"file":"assets/f~k%12~.js"},"d":{"imports":["_c~k%9~.js"]}}',
            "{broken ~k~",
        ))),
        ("url", "CASE k % 8 "
                "WHEN 0 THEN " + pick("cast(floor(k / 8) as bigint) % 4", (
                    "https://app~k%12~.example.com/_next/static/bld~k%12~/_buildManifest.js",
                    "https://app~k%12~.example.com/_next/static/chunks/main.js",
                    "https://app~k%12~.example.com/_next/static/chunks/framework.js",
                    "https://app~k%12~.example.com/_next/static/chunks/pages/_app.js"))
                + " WHEN 1 THEN " + text("https://app~k%12~.example.com/_next/static/alt~k%3~/_buildManifest.js")
                + " WHEN 2 THEN " + pick("cast(floor(k / 8) as bigint) % 3", (
                    "https://app~k%12~.example.com/.vite/manifest.json",
                    "https://app~k%12~.example.com/manifest.json",
                    "https://app~k%12~.example.com/assets/manifest.json"))
                + " WHEN 4 THEN " + pick("cast(floor(k / 8) as bigint) % 4", (
                    "https://cdn~k%4~.example.net/js/~k%50~.~h10~.chunk.js",
                    "https://cdn~k%4~.example.net/js/~h10~.chunk.js",
                    "https://cdn~k%4~.example.net/js/other~k~.js",
                    "https://cdn~k%4~.example.net/js/chunk.63.js"))
                + " WHEN 5 THEN " + text("https://app~k%12~.example.com/~h8~.chunk.js")
                + " WHEN 6 THEN concat('https://app', cast(k % 12 as string), '.example.com/num', cast(k % 6 as string), '/', "
                  "cast(CASE WHEN k % 12 = 2 THEN floor(k / 24) % 6 + CASE WHEN k % 5 = 0 THEN 12 ELSE 0 END "
                  "ELSE floor(k / 24) % 6 + CASE WHEN k % 5 = 0 THEN 22 ELSE 0 END END as bigint), "
                  "CASE WHEN k % 7 = 0 THEN '.js' ELSE '.chunk.js' END)"
                + " WHEN 7 THEN concat('https://app', cast(k % 12 as string), '.example.com/chunk.', "
                  "cast(cast(floor(k / 24) as bigint) % 9 as string), '.js') "
                + "ELSE concat('https://cdn.example.net/o', cast(k as string), '.js') END"),
    ),
    (
        ("response_id", "k"), ("url", "url"), ("content", "body"),
        ("status_code", "CASE WHEN k % 13 = 5 THEN 404 ELSE 200 END"),
        ("error", "CASE WHEN k % 29 = 3 THEN 'Timeout' END"),
        ("captured_at", "MICROS(1704067200000000 + k * 1000000)"),
    ),
))

# Scripts with source maps announced in every way, and the captured maps.
_MAP = ('{"version":3,"file":"a~k~.js","sourceRoot":"~root~","sources":["webpack:///./src/~k%9~/../app~k~.ts",'
        '"../lib/./b~k%5~.js","https://src~k%4~.example.com/raw/c~k%40~.js","./d//e.js"],'
        '"sourcesContent":["eval(x~k~)",null,null],"mappings":"AAAA"}')
_MAPPED_BASE = (
    keyed("p_partkey"),
    (
        *keep("k", "h", "g"),
        ("root", "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://root.example.com/s' WHEN 2 THEN 'webpack://' ELSE '/abs/' END"),
    ),
    (
        *keep("k", "h", "g"),
        ("doc", "CASE WHEN k % 23 = 7 THEN '{broken' ELSE " + filled(f"'{_MAP}'", _MAP) + " END"),
    ),
)
MAPPED = Derived("part", (
    *_MAPPED_BASE,
    (
        *keep("k"),
        ("url", text("https://cdn~k%9~.example.com/js/app~k~.js")),
        ("b64", "replace(replace(base64(cast(doc as binary)), chr(13), ''), chr(10), '')"),
        ("doc", "doc"),
    ),
    (
        ("asset_key", "k"), ("url", "url"),
        ("content", "concat('run(', cast(k as string), ');', chr(10), " + pick("k % 7", (
            "//# sourceMappingURL=app~k~.js.map",
            "//@ sourceMappingURL = https://maps.example.com/~k~.map  ",
            "/*# x */ //# sourcemappingurl=/maps/~k~.map */ tail()",
            "//# sourceMappingURL=data:application/json;base64,~b64~",
            "//# sourceMappingURL=data:application/json,~doc~",
            "no map here",
            "//# sourceMappingURL=../first~k~.map~nl~//# sourceMappingURL=second.map",
        )) + ")"),
    ),
))
MAP_CAPTURE = Derived("part", (
    *_MAPPED_BASE,
    (
        ("response_id", "k"),
        ("url", pick("k % 7", (
            "https://cdn~k%9~.example.com/js/app~k~.js.map",
            "https://maps.example.com/~k~.map",
            "https://cdn~k%9~.example.com/maps/~k~.map",
            "https://src~k%4~.example.com/raw/c~k%40~.js",
            "https://unrelated.example.com/~k~",
            "https://cdn~k%9~.example.com/js/app~k~.map",
            "https://cdn~k%9~.example.com/first~k~.map",
        ))),
        ("content", "CASE WHEN k % 7 = 3 THEN concat('fetched(', cast(k as string), ')') ELSE doc END"),
        ("status_code", "CASE WHEN k % 31 = 5 THEN 404 ELSE 200 END"),
        ("error", "CASE WHEN k % 37 = 3 THEN 'Timeout' END"),
        ("captured_at", "MICROS(1704067200000000 + k * 1000000)"),
    ),
))
