"""The on-page rules as data: metric, severity, when it fires, what it shows and what to do about it.

Fixed values: metric names, severities, limits, evidence and advice, as users of the audit know them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import listed, title_case

SEVERITIES = ("critical", "high", "medium", "low")
#: Shown names that aren't the metric's words in title case.
LABELS = {
    "title_missing": "Missing Page Title",
    "title_too_long": "Title Too Long (>60 Chars)",
    "title_too_short": "Title Too Short (<10 Chars)",
    "meta_description_missing": "Missing Meta Description",
    "meta_description_too_long": "Meta Description Too Long (>160 Chars)",
    "meta_description_too_short": "Meta Description Too Short (<50 Chars)",
    "h1_missing": "Missing H1 Primary Heading",
    "heading_hierarchy_skip": "Skipped Heading Level Hierarchy",
    "image_dimensions_missing": "Missing Image Dimensions (CLS Risk)",
    "robots_noindex": "Noindex Directive Present",
    "canonical_missing": "Missing Canonical Tag",
    "structured_data_missing": "Missing Structured Data (Schema.org)",
    "click_depth_high": "Deep Page Architecture (Click Depth > 3)",
    "redirect_chain": "Multi-Hop Redirect Chain",
    "orphan_page_in_sitemap": "Orphan Page in Sitemap",
    "llms_txt_missing": "Missing /llms.txt AI File",
    "ai_crawler_blocked": "Robots.txt Blocks AI Crawlers",
    "excessive_dom_size": "Excessive DOM Size",
    "render_blocking_script": "Render-Blocking Script in <head>",
}


def label(metric: Column) -> Column:
    """The shown name of a metric."""
    named = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(named[metric], title_case(metric))


@dataclass(frozen=True)
class Rule:
    metric: str
    severity: str
    when: Column
    evidence: Column
    fix: str
    page: str = "final_url"


def say(template: str, *values) -> Column:
    """A template's {} filled with columns, in order."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value.cast("string") if isinstance(value, Column) else F.col(value).cast("string"), F.lit(part)]
    return F.concat(*(F.coalesce(c, F.lit("None")) for c in out))


def before_parsing() -> list[Rule]:
    """Rules on what the crawl recorded; the first three also hold for failed pages."""
    c = F.col
    hops = F.array_join(F.transform("redirect_chain", lambda h: F.concat(h["status"].cast("string"), F.lit(" "), h["url"])), " -> ")
    return [
        Rule("click_depth_high", "low", c("depth") > 3, say("Page is at click depth {} from homepage (recommended max is 3).", "depth"), "Improve internal linking hierarchy so important pages are accessible within 3 clicks of the root."),
        Rule("redirect_chain", "medium", F.size("redirect_chain") > 1, say("URL required {} redirect hops: {}.", F.size("redirect_chain"), hops), "Update internal links to point directly to the destination URL to preserve crawl budget and link equity.", "url"),
        Rule("orphan_page_in_sitemap", "medium", c("in_sitemap") & (c("depth") > 0) & (F.size("referrers") == 0), F.lit("URL was discovered in sitemap.xml but has zero internal links pointing to it from crawled pages."), "Add internal contextual links to this page so users and search bots can discover it naturally."),
    ]


def failed() -> Column:
    return (F.coalesce(F.col("html_size"), F.lit(0)) == 0) | (F.col("status") >= 400) | (F.col("status") == 0)


def http_error() -> list[Rule]:
    """A failed page's own rule, once per severity."""
    via = F.when(F.size("referrers") > 0, F.concat(F.lit(" Discovered via link on "), F.get("referrers", F.lit(0)), F.lit("."))).otherwise(F.lit(""))
    shown = F.when(F.col("status") == 0, say("Connection failed or timed out: {}.{}", F.coalesce(F.nullif("error", F.lit("")), F.lit("network error")), via)).otherwise(say("HTTP response status is {}.{}", "status", via))
    grave = (F.col("status") >= 500) | (F.col("status") == 0)
    fix = "Ensure the page resolves successfully (HTTP 200) or update/remove internal links pointing to it."
    return [Rule("http_error", "critical", failed() & grave, shown, fix, "url"), Rule("http_error", "high", failed() & ~grave, shown, fix, "url")]


def on_page() -> list[Rule]:
    """Rules on a page that was served, in the order in which findings are listed."""
    c, n = F.col, F.char_length
    x_robots = F.coalesce(c("headers")["x-robots-tag"], F.lit(""))
    one_title = F.coalesce(c("title"), F.lit(""))
    titled, described = F.size("titles") > 0, c("n_descriptions") > 0
    robots, viewport = F.lower(F.coalesce("robots", F.lit(""))), F.lower(F.coalesce("viewport", F.lit("")))
    one_link = c("n_canonical") == 1
    return [
        Rule("slow_server_response", "low", c("response_time") > 2.5, say("Server response time was {}s, exceeding recommended 2.5s threshold.", F.format_string("%.2f", "response_time")), "Optimize server-side response times, implement caching, or use a CDN to reduce time to first byte."),
        Rule("x_robots_noindex", "high", F.lower(x_robots).contains("noindex"), say('HTTP response header X-Robots-Tag is "{}".', x_robots), "Remove the noindex directive from the X-Robots-Tag HTTP header if this page should be indexed."),
        Rule("excessive_dom_size", "low", c("n_nodes") > 1500, say("Document contains {} DOM elements (recommended maximum is 1,500).", "n_nodes"), "Simplify DOM structure and paginate long lists to improve Interaction to Next Paint (INP)."),
        Rule("render_blocking_script", "low", F.size("blocking_scripts") > 0, say("Found {} parser-blocking script(s) in <head>: {}.", F.size("blocking_scripts"), listed(F.slice("blocking_scripts", 1, 2))), "Add 'defer' or 'async' attribute to non-critical scripts in <head> to improve First Contentful Paint."),
        Rule("html_lang_missing", "low", F.coalesce("html_lang", F.lit("")) == "", F.lit("The root <html> element is missing a 'lang' attribute."), 'Add a valid BCP-47 language tag to the root element, e.g., <html lang="en">.'),
        Rule("charset_missing", "low", c("n_charset") == 0, F.lit('No <meta charset="..."> or http-equiv Content-Type tag was found in <head>.'), 'Specify character encoding early in the document <head>, e.g., <meta charset="utf-8">.'),
        Rule("title_missing", "high", ~titled, F.lit("No <title> tag found in the document."), "Add a unique, descriptive <title> element inside the <head> section."),
        Rule("multiple_titles", "medium", F.size("titles") > 1, say("Found {} <title> tags: {}.", F.size("titles"), listed(c("titles"))), "Keep only a single, authoritative <title> element per page."),
        Rule("title_empty", "high", titled & (one_title == ""), F.lit("The <title> element exists but is empty or contains only whitespace."), "Populate the <title> tag with a meaningful description of the page's topic."),
        Rule("title_too_short", "low", (n(one_title) > 0) & (n(one_title) < 15), say('Title length is only {} characters: "{}".', n(one_title), one_title), "Expand the title to between 30 and 60 characters with target keywords and brand identity."),
        Rule("title_too_long", "low", n(one_title) > 60, say('Title length is {} characters (exceeds 60): "{}".', n(one_title), one_title), "Shorten title to under 60 characters to avoid truncation in search engine result pages."),
        Rule("meta_description_missing", "medium", ~described, F.lit('No <meta name="description"> tag found on the page.'), "Add a compelling, unique meta description between 50 and 160 characters summarizing the page."),
        Rule("multiple_meta_descriptions", "medium", c("n_descriptions") > 1, say("Found {} meta description tags.", "n_descriptions"), "Consolidate multiple meta description tags into a single authoritative tag."),
        Rule("meta_description_empty", "medium", described & (c("description") == ""), F.lit('The <meta name="description"> tag exists but its content attribute is empty.'), "Provide a descriptive summary in the content attribute of the meta description."),
        Rule("meta_description_too_short", "low", described & (n("description") > 0) & (n("description") < 50), say('Meta description is only {} characters: "{}".', n("description"), "description"), "Expand the meta description to 50-160 characters to provide a rich summary for search snippets."),
        Rule("meta_description_too_long", "low", described & (n("description") > 160), say("Meta description is {} characters, exceeding the 160 character limit.", n("description")), "Trim meta description to under 160 characters to prevent snippet truncation on search results."),
        Rule("h1_missing", "medium", F.size("h1_texts") == 0, F.lit("No <h1> heading tag was found in the page markup."), "Add exactly one <h1> element to communicate the primary topic of the page."),
        Rule("multiple_h1", "low", F.size("h1_texts") > 1, say("Found {} <h1> elements: {}.", F.size("h1_texts"), listed(F.slice("h1_texts", 1, 4))), "Use a single primary <h1> element for the main title, structuring subtopics with <h2> and <h3>."),
        Rule("empty_h1", "medium", (F.size("h1_texts") == 1) & (F.get("h1_texts", F.lit(0)) == ""), F.lit("The <h1> element contains no visible text."), "Add descriptive heading text inside the <h1> tag."),
        Rule("heading_hierarchy_skip", "low", (c("n_h3") > 0) & (c("n_h2") == 0), say("Document contains {} <h3> elements but no <h2> elements.", "n_h3"), "Maintain a logical heading hierarchy by nesting <h3> headings under <h2> sections."),
        Rule("robots_noindex", "high", robots.rlike(r"(?U)\bnoindex\b"), say('<meta name="robots" content="{}"> contains "noindex".', "robots"), "Remove 'noindex' if this page is intended to be indexed and ranked by search engines."),
        Rule("robots_nofollow", "medium", robots.rlike(r"(?U)\bnofollow\b"), say('<meta name="robots" content="{}"> contains "nofollow".', "robots"), "Remove 'nofollow' if search crawlers should discover and pass link equity through internal links."),
        Rule("canonical_missing", "medium", c("n_canonical") == 0, F.lit('No <link rel="canonical"> tag found in the document <head>.'), "Add an explicit canonical link pointing to the preferred authoritative URL."),
        Rule("multiple_canonicals", "high", c("n_canonical") > 1, say("Found {} conflicting canonical link tags.", "n_canonical"), "Specify only one canonical link element per page to avoid indexing ambiguity."),
        Rule("canonical_empty", "medium", one_link & (c("canonical_href") == ""), F.lit('The <link rel="canonical"> tag has an empty href attribute.'), "Specify the absolute target URL in the canonical tag's href attribute."),
        Rule("canonical_relative", "low", one_link & (c("canonical_href") != "") & ~c("canonical_href").rlike("^https?://"), say('Canonical href is a relative path "{}" instead of an absolute URL.', "canonical_href"), "Use full absolute URLs (including https:// and domain) in canonical links."),
        Rule("viewport_missing", "high", c("n_viewport") == 0, F.lit('No <meta name="viewport"> tag found.'), 'Add <meta name="viewport" content="width=device-width, initial-scale=1.0"> for mobile responsiveness.'),
        Rule("viewport_restrictive", "low", viewport.contains("user-scalable=no") | viewport.contains("maximum-scale=1"), say('Viewport disables zoom: content="{}".', "viewport"), "Avoid restricting user zoom (user-scalable=no) to ensure accessibility standards are met."),
        Rule("image_alt_missing", "medium", F.size("no_alt") > 0, say("{} image(s) completely lack an 'alt' attribute. Sample src: {}.", F.size("no_alt"), listed(F.slice("no_alt", 1, 2))), "Add descriptive alt text to images for search engine image indexing and screen reader accessibility."),
        Rule("image_dimensions_missing", "low", c("n_no_size") > 3, say("{} image(s) lack explicit width/height attributes (Cumulative Layout Shift risk).", "n_no_size"), "Add width and height attributes to <img> elements to reserve layout space and prevent layout shifts."),
        Rule("javascript_link", "low", F.size("script_links") > 0, say("Found {} navigation link(s) using 'javascript:' protocol: {}.", F.size("script_links"), listed(F.slice("script_links", 1, 2))), "Replace javascript: pseudo-links with standard crawlable URLs or use button elements."),
        Rule("empty_href_links", "low", c("n_empty_links") > 3, say('Found {} anchor elements with empty href or href="#".', "n_empty_links"), "Use valid target URLs for navigation links or convert to buttons if triggering actions."),
        Rule("mixed_content_link", "low", F.size("insecure_links") > 0, say("HTTPS page contains {} insecure HTTP link(s): {}.", F.size("insecure_links"), listed(F.slice("insecure_links", 1, 2))), "Upgrade insecure http:// URLs to https:// to maintain end-to-end transport security."),
        Rule("thin_content_signal", "low", (c("n_words") < 120) & ~c("is_root"), say("Page contains approximately {} visible words, which may signal thin content to search engines.", "n_words"), "Expand the page copy with substantive, original content that satisfies target search intent."),
        Rule("open_graph_title_missing", "low", c("n_og_title") == 0, F.lit('No Open Graph <meta property="og:title"> found.'), "Add an og:title tag to optimize how content appears when shared across social networks."),
        Rule("open_graph_image_missing", "low", c("n_og_image") == 0, F.lit('No Open Graph <meta property="og:image"> found.'), "Add an og:image tag with an appropriate preview image (1200x630px recommended)."),
        Rule("structured_data_missing", "low", (c("n_structured") == 0) & c("is_root"), F.lit("Homepage lacks Schema.org structured data (neither JSON-LD nor Microdata detected)."), "Implement Schema.org JSON-LD structured data (e.g. Organization, WebSite) for rich snippet eligibility."),
    ]


ALTERNATE_FIX = "Ensure all hreflang alternate links use fully-qualified absolute URLs."
TITLE_FIX = "Provide each page with a distinctive, descriptive title to prevent internal keyword cannibalization."
DESCRIPTION_FIX = "Write unique meta descriptions tailored to the specific content and purpose of each page."
LLMS_FIX = "Create an /llms.txt file to help AI search engines (Perplexity, SearchGPT, Gemini) index site knowledge."
BOTS_FIX = "Review robots.txt rules if visibility in AI answer engines (SearchGPT, Claude, Gemini) is desired."
BOTS = ("GPTBot", "ClaudeBot", "PerplexityBot", "Google-Extended", "CCBot")
