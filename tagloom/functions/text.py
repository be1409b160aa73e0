"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The range of Chinese letters, and the pattern of a unit.
CJK = "一-龥"
UNIT = r"([0-9A-Za-z]+|[^0-9A-Za-z])"
WORD = r"\p{L}+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def units(text: Column | str) -> Column:
    """Runs of ASCII letters and digits, and every other character by itself."""
    return F.regexp_extract_all(_c(text), F.lit(UNIT), F.lit(1))


def words(text: Column | str) -> Column:
    """Runs of letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({WORD})"), F.lit(1))


def plain_tokens(text: Column | str) -> Column:
    """Units of the lower-cased text with runs of spaces collapsed; blank ones are dropped."""
    return F.filter(units(F.lower(F.regexp_replace(_c(text), " +", " "))), lambda t: ~is_blank(t))


def is_blank(text: Column | str) -> Column:
    """True for texts of white space only."""
    return _c(text).rlike(r"(?U)^\s*$")


def strip(text: Column | str) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def is_cjk(text: Column | str) -> Column:
    """One Chinese letter or more and nothing else, but for a newline at the end."""
    return _c(text).rlike(f"^[{CJK}]+\\n?$")


def first_group(text: Column | str, pattern: str) -> Column:
    """First group of the first match over several lines, '' without one."""
    return F.coalesce(F.regexp_extract(_c(text), f"(?sm){pattern}", 1), F.lit(""))


def hrefs(html: Column | str) -> Column:
    """Targets of links as written."""
    return F.regexp_extract_all(_c(html), F.lit(r'href="?([a-zA-Z0-9\-_:/.%]+)'), F.lit(1))


def absolute(url: Column | str, href: Column | str) -> Column:
    """The target resolved against the page's address: absolute, host-relative, or relative to the page's folder."""
    url, href = _c(url), _c(href)
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def anchors(html: Column | str) -> Column:
    """Texts of links."""
    return F.regexp_extract_all(_c(html), F.lit(r"<a.+?>(.+?)</a>"), F.lit(1))


def charset(html: Column | str) -> Column:
    """The declared character set within the first 3000 characters, utf-8 without one."""
    found = F.regexp_extract(F.substring(_c(html), 1, 3000), r'charset="?([-a-zA-Z0-9]+)', 1)
    return F.when(found == "", "utf-8").otherwise(found)


def join_chunk(tokens: Column | str) -> Column:
    """Tokens as one surface: parts are set apart by spaces unless there is a Chinese letter; hyphens go either way."""
    joined = F.array_join(_c(tokens), "-")
    return F.replace(joined, F.lit("-"), F.when(joined.rlike(f"[{CJK}]"), F.lit("")).otherwise(F.lit(" ")))


def days_since(reference: Column, *stamps: Column | str, missing: float = 1e9) -> Column:
    """Days from the latest of some epoch seconds to the reference, 0 at least; a missing stamp counts as ``missing``."""
    known = [F.coalesce(_c(s).try_cast("double"), F.lit(missing)) for s in stamps]
    latest = F.greatest(*known) if len(known) > 1 else known[0]
    return F.greatest((reference - latest) / F.lit(86400.0), F.lit(0.0))


def escape_html(text: Column | str) -> Column:
    """The five characters with a meaning in HTML as entities, the ampersand first."""
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normal_query(text: Column | str) -> Column:
    """Lower case without ideographic full stops at either end."""
    return F.regexp_replace(F.lower(_c(text)), "^。+|。+$", "")
