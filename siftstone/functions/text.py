"""Text as Column expressions: cleaning, names, keys, display forms, the markup of documentation pages.

All of it stays in generated code.  Java's ``\\w`` and ``\\s`` are ASCII unless (?U) is set, and ``$`` under (?m) breaks at more than
line feeds unless (?d) is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of readable files.  Fixed values.
SUFFIXES = (".pdf", ".md", ".markdown", ".txt", ".rst", ".html", ".htm", ".docx")

#: What marks a retriable error, in lower case.  Fixed values.
RETRIABLE = ("rate", "429", "quota", "resource_exhausted", "timeout", "503", "unavailable")
#: What marks the end of a quota.  Fixed values.
QUOTA = ("quota", "429")

PASSAGE_SEPARATOR = "\n\n---\n\n"


def strip(text: Column) -> Column:
    """Without white space, of any kind in Unicode, at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def dehyphenate(text: Column) -> Column:
    """Joins words that a line break split after a hyphen."""
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t ]+", " ")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def clean_text(text: Column) -> Column:
    """Newlines, broken words, spaces, blank lines, ends, in this order."""
    for step in (normalise_newlines, dehyphenate, collapse_spaces, collapse_blank_lines, strip):
        text = step(text)
    return text


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot, in lower case; empty if there is none or the name only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def title_from_path(path: Column) -> Column:
    return strip(F.regexp_replace(stem(path), "[_-]", " "))


def relative_path(uri: Column, root: str) -> Column:
    """``uri`` (percent-encoded, with or without scheme) below ``root``."""
    plain = F.url_decode(F.replace(F.regexp_replace(uri, r"^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1 << 30)).otherwise(plain)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def header(title: Column, source: Column, page: Column) -> Column:
    """``[title - p.N]``, or ``[title]`` without a page; an empty title gives way to the source, page 0 is none."""
    name = F.coalesce(blank_to_null(title), source)
    return F.when(page != 0, F.concat(F.lit("["), name, F.lit(" - p."), page.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), name, F.lit("]")))


def with_header(head: Column, text: Column, enabled: bool = True) -> Column:
    return F.concat(head, F.lit("\n"), text) if enabled else text


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.lit(":"), index.cast("string"), F.lit(":"), F.substring(text, 1, 200))), 1, 16)


def content_key(text: Column) -> Column:
    return F.sha1(text)


def model_slug(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))


def snippet(text: Column, size: int = 300) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def location(source: Column, page: Column) -> Column:
    name = F.coalesce(source, F.lit("unknown"))
    return F.when(page != 0, F.concat(name, F.lit(", page "), page.cast("string"))).otherwise(name)


def numbered_passage(n: Column, source: Column, page: Column, content: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ("), location(source, page), F.lit(")\n"), content)


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def history_line(role: Column, content: Column) -> Column:
    return F.concat(capitalise(F.coalesce(role, F.lit("user"))), F.lit(": "), F.coalesce(content, F.lit("")))


#: How providers word the seconds to wait.  Fixed values.
RETRY_HINTS = (r"(?i)retry in ([0-9.]+)s", r"(?i)'retryDelay': '([0-9]+)s'")


def retry_hint(message: Column) -> Column:
    """Seconds that an error message asks to wait, or null."""
    found = F.coalesce(*(blank_to_null(F.regexp_extract(message, pattern, 1)) for pattern in RETRY_HINTS))
    return found.try_cast("double")


def is_retriable(message: Column) -> Column:
    return F.exists(F.array(*map(F.lit, RETRIABLE)), lambda t: F.contains(F.lower(message), t))


def cited_numbers(text: Column) -> Column:
    """The numbers of all ``[n]``, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))


def already_cited(text: Column) -> Column:
    return text.rlike(r"\[\d+\]")


#: A run of other than white space, spelt out as the JVM's Unicode classes have it, for Python's engine.
TOKEN = "[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def tokens(text: Column) -> Column:
    """Runs of other than white space, case kept."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def fixed_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before, as array<string>; an empty text has one empty window."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))


# --- documentation pages ---------------------------------------------------------------------------------------

# The patterns of directives, fences and anchors below are fixed values: they are the markup's syntax.

#: An include directive on a line of its own: target, then modifiers like hl[2] or title["a.py"].
INCLUDE = r"(?mdU)^\{\*\s*(\S+?)\s*((?:\w+\[[^\]]*\]\s*)*)\*\}\s*$"


def include_target(directive: Column) -> Column:
    return F.regexp_extract(directive, INCLUDE, 1)


def include_path(target: Column) -> Column:
    return F.regexp_replace(strip(target), r"^(\.\./)+", "")


def include_caption(directive: Column) -> Column:
    title = F.regexp_extract(F.regexp_extract(directive, INCLUDE, 2), r'title\["?([^"\]]+)"?\]', 1)
    return F.coalesce(blank_to_null(title), file_name(include_path(include_target(directive))))


def code_language(path: Column) -> Column:
    return F.when(suffix(path) == ".py", "python").otherwise(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def code_block(caption: Column, language: Column, code: Column) -> Column:
    return F.concat(F.lit("Example (`"), caption, F.lit("`):\n\n```"), language, F.lit("\n"), strip(code), F.lit("\n```"))


def flatten_admonitions(text: Column) -> Column:
    """``/// kind | title`` fences as bold labels, their closing fences removed.

    Openers are split off one by one, so each kind can be capitalised in the JVM; openers go before closers, and an
    opener's white space may run over a line end, which lets a closer before a one-word line pass for an opener.
    """
    opener = r"(?mdU)^/{3,}\s+(\w+)(?:\s*\|\s*(.*))?$"
    pieces = F.split(F.regexp_replace(text, opener, "\u0001$1\u0002$2\u0003"), "\u0001")

    def label(piece: Column) -> Column:
        kind, rest = F.substring_index(piece, "\u0002", 1), F.substring_index(piece, "\u0002", -1)
        title = strip(F.substring_index(rest, "\u0003", 1))
        after = F.substr(rest, F.locate("\u0003", rest) + 1)
        return F.concat(F.lit("**"), capitalise(kind), F.lit(":"), F.when(title == "", "").otherwise(F.concat(F.lit(" "), title)), F.lit("**"), after)

    flat = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(label(p))), "")
    return F.regexp_replace(flat, r"(?mdU)^/{3,}\s*$", "")


def strip_anchors(text: Column) -> Column:
    return F.regexp_replace(text, r"(?mdU)\s*\{\s*#[\w-]+\s*\}\s*$", "")


def finish_page(text: Column) -> Column:
    return F.concat(strip(collapse_blank_lines(text)), F.lit("\n"))


# --- HTML -------------------------------------------------------------------------------------------------------

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Visible text of simple markup: skipped subtrees, comments and tags become line breaks, common entities their characters."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|head)\b[^>]*>.*?</\1\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", "\n")
    for name, character in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(character))
    return clean_text(F.regexp_replace(out, r"[ \t]*\n[ \t\n]*", "\n"))


def html_title(html: Column, fallback: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")
    for name, character in _ENTITIES:
        found = F.replace(found, F.lit(name), F.lit(character))
    return F.coalesce(blank_to_null(strip(found)), fallback)
