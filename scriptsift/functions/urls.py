"""URL columns after RFC 3986, tolerant of any input (never fails a row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind
from .text import strip

# RFC 3986 appendix B: scheme, authority, path, query, fragment.
_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_SCHEME, _NETLOC, _PATH, _QUERY, _FRAGMENT = range(5)
# A noncharacter between the parts lets one pass of the expression yield all five.
_GAP = "\ufdd3"

# Schemes whose references may be relative to a base of the same scheme.
HIERARCHICAL = ("", "http", "https", "ftp", "file", "ws", "wss", "sftp", "svn", "svn+ssh", "rtsp", "gopher")

# Paths that need work: dot segments anywhere, or empty segments.
_DOTS = r"(?:\A|/)\.{1,2}(?:/|\z)|//"


def url_parts(url: Column) -> Column:
    """Array of the five components; absent ones are empty strings."""
    clean = F.replace(url, F.lit(_GAP), F.lit(""))
    return F.split(F.regexp_replace(clean, _PARTS, _GAP.join(f"${i}" for i in range(1, 6))), _GAP, -1)


def _push_segment(stack: Column, seg: Column) -> Column:
    return (
        F.when(seg == "..", F.regexp_replace(stack, "/[^/]*$", ""))
        .when(seg == ".", stack)
        .otherwise(F.concat(stack, F.lit("/"), seg))
    )


def remove_dot_segments(path: Column, merged: Column) -> Column:
    """Collapse ``.`` and ``..``; a path merged with its base loses empty inner
    segments too."""
    # The stack is a string whose every entry carries a leading slash, so a pop
    # is one suffix removal and an empty stack absorbs surplus "..".
    def fold(segs):
        kept = F.when(merged, F.filter(
            segs, lambda x, i: (x != "") | (i == 0) | (i == F.size(segs) - 1))).otherwise(segs)
        folded = F.aggregate(kept, F.lit(""), _push_segment)
        closed = F.when(F.element_at(segs, -1).isin(".", ".."), F.concat(folded, F.lit("/"))).otherwise(folded)
        return F.coalesce(F.nullif(F.substring(closed, 2, 1 << 30), F.lit("")), F.lit("/"))

    return bind(F.split(path, "/", -1), fold)


def join_url(base: Column, ref: Column) -> Column:
    """Reference resolution of ``ref`` against ``base``."""

    def resolve(u):
        b, r = u["b"], u["r"]
        scheme, ref_scheme = F.lower(b[_SCHEME]), F.lower(r[_SCHEME])
        foreign = ((ref_scheme != "") & (ref_scheme != scheme)) | ~scheme.isin(*HIERARCHICAL)
        return F.when(u["ref"] == "", u["base"]).when((u["base"] == "") | foreign, u["ref"]).otherwise(assemble(b, r, scheme))

    def assemble(b, r, scheme):
        own_host, no_path = r[_NETLOC] != "", r[_PATH] == ""
        netloc = F.when(own_host, r[_NETLOC]).otherwise(b[_NETLOC])
        folder = F.when(b[_PATH] == "", F.lit("/")).otherwise(F.regexp_replace(b[_PATH], "[^/]*$", ""))
        relative = ~r[_PATH].startswith("/")
        merged = F.when(relative, F.concat(folder, r[_PATH])).otherwise(r[_PATH])
        path = F.when(own_host, r[_PATH]).when(no_path, b[_PATH]).otherwise(
            bind(merged, lambda p: F.when(p.rlike(_DOTS), remove_dot_segments(p, relative)).otherwise(p)))
        query = F.when(~own_host & no_path & (r[_QUERY] == ""), b[_QUERY]).otherwise(r[_QUERY])
        # Joining with nulls skipped drops the empty components.
        return F.concat_ws(
            "",
            F.when(scheme != "", F.concat(scheme, F.lit(":"))),
            F.when(netloc != "", F.concat(F.lit("//"), netloc)),
            bind(path, lambda p: F.when((netloc != "") & p.rlike(r"\A[^/]"), F.concat(F.lit("/"), p)).otherwise(p)),
            F.when(query != "", F.concat(F.lit("?"), query)),
            F.when(r[_FRAGMENT] != "", F.concat(F.lit("#"), r[_FRAGMENT])),
        )

    clean = F.translate(F.regexp_replace(ref, r"\A[\x00-\x20]+", ""), "\t\r\n", "")
    return bind(
        F.struct(base.alias("base"), ref.alias("ref"), url_parts(base).alias("b"), url_parts(clean).alias("r")),
        resolve,
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute URL for a reference found in a page or script; null when empty."""
    t = strip(ref)
    return (
        F.when(ref.isNull() | (ref == ""), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(F.lower(F.regexp_extract(base, _PARTS, 1)), F.lit(":"), t))
        .when(t.startswith("http://") | t.startswith("https://"), t)
        .otherwise(join_url(base, t))
    )


def origin(url: Column) -> Column:
    """``scheme://authority``, keeping port and user info as written."""
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    return F.concat(scheme, F.lit("://"), F.regexp_extract(url, _PARTS, 2))


def same_origin(a: Column, b: Column) -> Column:
    return origin(a) == origin(b)


def url_path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 3), ";[^/]*$", "")


def short_url(url: Column, max_len: int = 60) -> Column:
    """Listing form: host and path, the path's head elided when long."""
    path = url_path(url)
    shown = F.when(
        F.length(path) > max_len - 20, F.concat(F.lit("..."), F.right(path, F.lit(max_len - 23)))
    ).otherwise(path)
    return F.when(F.length(url) <= max_len, url).otherwise(F.concat(F.regexp_extract(url, _PARTS, 2), shown))
