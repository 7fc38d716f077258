"""URL expressions: normalization, site identity, crawl eligibility and crawl priority, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a binary or asset path, and the words that raise or lower a URL's crawl priority.
BLOCKED_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "tiff", "pdf", "zip", "tar", "gz", "rar", "7z", "exe", "dmg",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "mp4", "mp3", "webm", "avi", "mov", "wav", "ogg",
    "css", "js", "mjs", "xml", "json", "woff", "woff2", "ttf", "eot",
)
CONTACT_WORDS = ("contact", "about", "location", "store", "reach-us", "get-in-touch")
POLICY_WORDS = ("privacy", "terms", "legal", "faq", "help", "support")
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
#: Scheme, authority, path, query and fragment of RFC 3986, appendix B.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

#: Absolute URLs that are their own normal form, the most frequent kind: a lower-cased name without port, a path of printable ASCII without query.
CANONICAL = r"^https?://[a-z0-9._-]+/(?!/)(?!.*//)[!-~&&[^?#;]]*\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: nested use of a column otherwise copies its whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(url, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' where absent."""
    return F.regexp_extract(_col(url), "(?s)" + PARTS, i)


def has_authority(url) -> Column:
    return _col(url).rlike("^(?:[^:/?#]+:)?//")


def host(url) -> Column:
    """Lower-cased host without user, brackets and port."""
    authority = F.regexp_replace(part(url, 2), "^.*@", "")
    bracketed = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(authority.startswith("["), bracketed).otherwise(F.regexp_replace(authority, ":.*$", "")))


def port(url) -> Column:
    """The port's digits, '' where there is none."""
    return F.regexp_extract(part(url, 2), r":(\d*)$", 1)


def path(url) -> Column:
    return part(url, 3)


def http_scheme(url) -> Column:
    return F.lower(part(url, 1)).isin("http", "https")


def remove_dots(path_) -> Column:
    """Dot segments of a path resolved: '.' goes, '..' takes its predecessor along."""
    segments = F.split(path_, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    return F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(url, base) -> Column:
    """A reference resolved against a base with a scheme and an authority (RFC 3986, 5.2)."""
    url, base = _col(url), _col(base)
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    query = F.when(url.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(url, 4))).otherwise(F.lit(""))
    own = part(url, 3)
    folder = F.concat(F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", ""), own)
    base_query = F.when(base.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(base, 4))).otherwise(F.lit(""))
    return (
        F.when(part(url, 1) != "", url)
        .when(url.startswith("//"), F.concat(part(base, 1), F.lit(":"), url))
        .when(own == "", F.concat(root, path(base), F.when(url.rlike(r"^\?"), query).otherwise(base_query)))
        .otherwise(F.concat(root, remove_dots(F.when(own.startswith("/"), own).otherwise(folder)), query))
    )


def with_scheme(url) -> Column:
    """Prefix https:// where no scheme:// leads."""
    url = _col(url)
    return F.when(url.rlike(SCHEME), url).otherwise(F.concat(F.lit("https://"), url))


def normalize_url(url, base=None, strict_compat: bool = False) -> Column:
    """A canonical http(s) URL without fragment, default port and repeated slashes; '' where none can be made.

    Relative references are resolved against `base` by RFC 3986. With strict_compat, https:// is put before anything
    without scheme:// even if a base is given, as the original command does: only absolute references and, on https
    pages, root-relative ones then keep their meaning.
    """
    url = _col(url)
    trimmed = F.trim(F.regexp_replace(url, r"^\s+|\s+$", ""))
    if base is None:
        full = let(trimmed, lambda t: F.when(t != "", with_scheme(t)))
    elif strict_compat:
        full = let(F.when(trimmed != "", with_scheme(trimmed)), lambda f: _rooted(f, _col(base)))
    else:
        full = let(trimmed, lambda t: F.when(t != "", resolve(t, base)))
    return F.when(url.rlike(CANONICAL), url).otherwise(let(full, _canonical))


def _rooted(full: Column, base: Column) -> Column:
    rooted = full.rlike("^https:///") & (F.lower(part(base, 1)) == "https")
    return F.when(rooted, F.concat(F.lit("https://"), part(base, 2), F.substring(full, 9, 1 << 30))).otherwise(full)


def _canonical(full: Column) -> Column:
    scheme, name, number = F.lower(part(full, 1)), host(full), port(full)
    default = ((scheme == "https") & (number == "443")) | ((scheme == "http") & (number == "80"))
    netloc = F.when((number == "") | default, name).otherwise(F.concat(name, F.lit(":"), F.regexp_replace(number, "^0+(?=.)", "")))
    clean = F.regexp_replace(F.when(path(full) == "", F.lit("/")).otherwise(path(full)), "/+", "/")
    clean = F.regexp_replace(clean, r";[^/]*$", "")
    query = F.when(part(full, 4) != "", F.concat(F.lit("?"), part(full, 4))).otherwise(F.lit(""))
    server = F.regexp_replace(part(full, 2), "^.*@", "")
    bad = ~scheme.isin("http", "https") | (name == "") | ~server.rlike(r"^(\[[^\]]*\]|[^:\[\]]*)(:\d{0,5})?$") | (F.coalesce(F.try_to_number(number, F.lit("99999")), F.lit(0)) > 65535)
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("")).otherwise(F.concat(scheme, F.lit("://"), netloc, clean, query))


def same_site(url, root) -> Column:
    """Whether an http(s) URL has the root's host, one leading www. aside."""
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    return F.coalesce((_col(url) != "") & (_col(root) != "") & http_scheme(url) & (bare(url) == bare(root)), F.lit(False))


def is_crawlable_link(url) -> Column:
    """Whether an http(s) URL's path doesn't end like a binary or an asset."""
    blocked = F.lower(path(url)).rlike(r"\.(" + "|".join(BLOCKED_EXTENSIONS) + ")$")
    return F.coalesce((_col(url) != "") & http_scheme(url) & ~blocked, F.lit(False))


def is_root(url) -> Column:
    return path(url).isin("", "/")


def url_priority_score(url) -> Column:
    """10, plus 50 for contact-like, else 30 for policy-like, else 40 for root URLs; words anywhere in the URL count."""
    low = F.lower(_col(url))
    return (
        F.when(low.rlike("|".join(CONTACT_WORDS)), F.lit(60))
        .when(low.rlike("|".join(POLICY_WORDS)), F.lit(40))
        .when(is_root(low), F.lit(50))
        .otherwise(F.lit(10))
    )


def brand_hint(url) -> Column:
    """The host's first label, capitalized."""
    label = F.split(host(url), r"\.")[0]
    return F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1 << 30)))


def unquote(text: str | Column) -> Column:
    """Percent-escapes as the UTF-8 text that they stand for; what is no escape stays, and bytes that are no text are replaced."""
    kept = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(kept)


def quote(text: str | Column) -> Column:
    """Everything but letters, digits, `_.-~` and the slash percent-encoded."""
    form = F.url_encode(text)
    for plain, coded in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = F.replace(form, F.lit(plain), F.lit(coded))
    return form


def rejoined(text: Column) -> Column:
    """A reference without the marks of empty parameters, an empty query and an empty fragment."""
    for empty in (r"^([^?#]*/)?([^;/?#]*);(?=[?#]|$)", r"^([^?#]*)()\?(?=#|$)", r"^([^#]*)()#$"):
        text = F.regexp_replace(text, empty, "$1$2")
    return text


def local_part(url: Column) -> Column:
    """A URL from its path on; a path of two leading slashes is told from a host by two more."""
    rest = rejoined(F.regexp_replace(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""))
    return F.when(rest.startswith("//"), F.concat(F.lit("//"), rest)).otherwise(rest)
