"""One wide row of facts per page, computed from its nodes inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Fixed value: a visible word, letters and digits of any script.
VISIBLE_WORD = r"[\p{L}\p{N}_\p{M}][\p{L}\p{N}_\p{M}’'-]*"


def _attr(n: Column, name: str) -> Column:
    return n["attrs"][name]


def _text(n: Column, name: str) -> Column:
    return F.coalesce(_attr(n, name), F.lit(""))


def _has(n: Column, name: str) -> Column:
    return F.map_contains_key(n["attrs"], F.lit(name))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _meta(name: str, value: str) -> Column:
    return F.filter("nodes", lambda n: (n["tag"] == "meta") & (F.lower(_text(n, name)) == value))


def _links(token: str) -> Column:
    return F.filter("nodes", lambda n: (n["tag"] == "link") & F.array_contains(F.split(_text(n, "rel"), r"\s+"), token))


def _tags(*names: str) -> Column:
    return F.filter("nodes", lambda n: n["tag"].isin(*names))


def _first(nodes: Column, name: str) -> Column:
    return F.get(nodes, F.lit(0))["attrs"][name]


def page_facts(parsed: DataFrame) -> DataFrame:
    """Pages with nodes and visible_text to counts, first values and samples; every page column but these two is kept."""
    src = lambda n: F.coalesce(F.nullif(_attr(n, "src"), F.lit("")), F.nullif(_attr(n, "data-src"), F.lit("")), F.lit("unknown"))
    head = F.get(_tags("head"), F.lit(0))
    blocking = F.filter("nodes", lambda n: (n["tag"] == "script") & _has(n, "src") & (n["id"] > head["id"]) & (n["id"] <= head["end"]) & (_text(n, "async") == "") & (_text(n, "defer") == "") & (_text(n, "type") != "module"))
    images = _tags("img")
    hrefs = F.transform(F.filter("nodes", lambda n: (n["tag"] == "a") & _has(n, "href")), lambda n: _strip(_text(n, "href")))
    script = lambda h: F.lower(h).startswith("javascript:")
    secure = F.lower(F.col("final_url")).startswith("https://")
    cut = lambda items: F.transform(items, lambda s: F.substring(s, 1, 60))
    titles, h1 = _tags("title"), _tags("h1")
    descriptions, canonical = _meta("name", "description"), _links("canonical")
    facts = {
        "n_nodes": F.size("nodes"),
        "max_depth": F.coalesce(F.array_max(F.transform("nodes", lambda n: n["depth"])), F.lit(0)),
        "blocking_scripts": F.transform(blocking, lambda n: F.substring(_attr(n, "src"), 1, 60)),
        "html_lang": _first(_tags("html"), "lang"),
        "n_charset": F.size(F.filter("nodes", lambda n: (n["tag"] == "meta") & (_has(n, "charset") | (F.lower(_text(n, "http-equiv")) == "content-type")))),
        "titles": F.transform(titles, lambda n: n["nosep"]),
        "n_descriptions": F.size(descriptions),
        "description": _strip(F.coalesce(_first(descriptions, "content"), F.lit(""))),
        "h1_texts": F.transform(h1, lambda n: n["text"]),
        "n_h2": F.size(_tags("h2")),
        "n_h3": F.size(_tags("h3")),
        "n_robots": F.size(_meta("name", "robots")),
        "robots": _first(_meta("name", "robots"), "content"),
        "n_canonical": F.size(canonical),
        "canonical_href": _strip(F.coalesce(_first(canonical, "href"), F.lit(""))),
        "n_viewport": F.size(_meta("name", "viewport")),
        "viewport": _first(_meta("name", "viewport"), "content"),
        "no_alt": F.transform(F.filter(images, lambda n: ~_has(n, "alt")), src),
        "n_no_size": F.size(F.filter(images, lambda n: ((_text(n, "width") == "") | (_text(n, "height") == "")) & ~F.lower(src(n)).endswith(".svg"))),
        "script_links": cut(F.filter(hrefs, script)),
        "n_empty_links": F.size(F.filter(hrefs, lambda h: h.isin("#", ""))),
        "insecure_links": F.when(secure, cut(F.filter(hrefs, lambda h: F.lower(h).startswith("http://")))).otherwise(F.array().cast("array<string>")),
        "n_words": F.size(F.regexp_extract_all("visible_text", F.lit(VISIBLE_WORD), F.lit(0))),
        "is_root": urls.is_root("final_url"),
        "n_og_title": F.size(_meta("property", "og:title")),
        "n_og_image": F.size(_meta("property", "og:image")),
        "n_structured": F.size(F.filter("nodes", lambda n: _has(n, "itemscope") | ((n["tag"] == "script") & _text(n, "type").rlike(r"(?i)application/ld\+json")))),
        "alternates": F.transform(
            F.filter(_links("alternate"), lambda n: (_text(n, "hreflang") != "") & (_text(n, "href") != "") & ~_text(n, "href").rlike("^https?://")),
            lambda n: F.struct(_attr(n, "hreflang").alias("lang"), _attr(n, "href").alias("href")),
        ),
    }
    rows = parsed.select(*(c for c in parsed.columns if c not in ("nodes", "visible_text")), *(c.alias(n) for n, c in facts.items()))
    return rows.withColumn("title", F.get("titles", F.lit(0)))
