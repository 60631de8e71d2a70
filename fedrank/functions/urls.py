"""URL columns.  A URL is taken apart once, into a struct that all rules read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules

_HEAD = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):/*([^/?#\s]+)"


def parse(url: Column) -> Column:
    """Struct of an absolute URL: scheme, host (lower case, without www.), domain, path, query, and whether it is valid.

    User information, port and fragment are dropped.  Where the URL is not valid the strings are empty and the path is ``/``.
    """
    url = F.coalesce(url, F.lit(""))
    authority = F.regexp_extract(url, _HEAD, 2)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    valid = (host != "") & ~host.rlike(r"[\s<>\[\]^|%\\:]")
    rest = F.regexp_replace(url, _HEAD, "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    blank = lambda c: F.when(valid, c).otherwise("")
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.struct(
        blank(F.lower(F.regexp_extract(url, _HEAD, 1))).alias("scheme"),
        blank(bare).alias("host"),
        blank(domain_of(bare)).alias("domain"),
        F.when(valid & (path != ""), F.regexp_replace(path, r"\s+$", "")).otherwise("/").alias("path"),
        blank(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)).alias("query"),
        valid.alias("valid"),
    )


def domain_of(host: Column) -> Column:
    """The last two labels of a host; no list of public suffixes is used."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    return F.when(F.size(labels) < 2, host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))


def registrable_domain(url: Column) -> Column:
    return parse(url)["domain"]


def without_params(query: Column, names: list[str] | tuple[str, ...] = tuple(rules.TRACKING)) -> Column:
    """A query string without the named parameters, wherever they occur.  The others are decoded and written anew as forms
    are: a blank as ``+``, a name without a value with ``=``, so spellings of one value agree.  What can't be decoded stays."""
    name = lambda p: form_decode(F.substring_index(p, "=", 1))
    value = lambda p: form_decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.locate("=", p) + 1)).otherwise(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(list(names)))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(name(p)), F.lit("="), F.url_encode(value(p)))), "&")


def form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def dedup_key(url: Column, parsed: Column | None = None) -> Column:
    """One key for URLs of the same page: scheme, host without www., path and query without tracking parameters, in lower
    case, without a final slash.  Port, user and fragment don't count; http and https differ.  Invalid: lower-cased as it is."""
    u = parse(url) if parsed is None else parsed
    query = without_params(u["query"])
    whole = F.concat(u["scheme"], F.lit("://"), u["host"], u["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.lower(F.regexp_replace(F.when(u["valid"], whole).otherwise(F.coalesce(url, F.lit(""))), "/$", ""))


def param(url: Column, name: str) -> Column:
    """A query parameter's value as it is written, or null."""
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(found != "", found)


def unwrap_ddg(href: Column) -> Column:
    """The target of a result link: its ``uddg`` parameter, decoded; empty for the engine's own links without one."""
    target = F.try_url_decode(F.replace(param(href, "uddg"), F.lit("+"), F.lit("%2B")))
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    host = parse(full)["host"]
    return F.when(param(href, "uddg").isNotNull(), F.coalesce(target, href)).when(host == "duckduckgo.com", "").otherwise(href)


def unwrap_bing(href: Column) -> Column:
    """The target of a tracking link, whose parameter ``u`` is two characters and URL-safe base64; others stay.  Decoded bytes
    are characters of ISO 8859-1, as in the HTML reader."""
    code = F.substr(param(href, "u"), F.lit(3))
    text = F.try_to_binary(F.rpad(F.translate(code, "-_", "+/"), (F.ceil(F.length(code) / 4) * 4).cast("int"), "="), F.lit("base64"))
    text = F.decode(text, "ISO-8859-1")
    return F.when(href.contains("bing.com/ck/a") & text.startswith("http"), text).otherwise(href)


def encode_component(text: Column) -> Column:
    """Percent-encoding of a URL component."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def search_url(base: str, query: Column, **params: str) -> Column:
    """A source's request: the base address with the query and fixed parameters, form-encoded."""
    fixed = "".join(f"&{k}={v}" for k, v in params.items())
    return F.concat(F.lit(f"{base}?q="), F.url_encode(query), F.lit(fixed))
