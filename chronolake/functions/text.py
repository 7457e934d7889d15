"""String functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"


def bigrams(text: Column) -> Column:
    """The distinct two-character strings of a text's letters and digits, case kept; under two: none.

    A look-ahead takes the two characters from each place and one is passed, so one scan of the
    text by the pattern engine gives them all.
    """
    found = F.regexp_extract_all(F.regexp_replace(text, NOT_ALNUM, ""), F.lit("(?s)(?=(..))."), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 under a key of at most 64 bytes."""
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def entropy(text: Column) -> Column:
    """Shannon bits a character; empty: 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(text) > 0, F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def entropy_penalty(text: Column) -> Column:
    """exp(-((h - 4) / 1.5)^2 / 2)."""
    z = (entropy(text) - 4.0) / 1.5
    return F.exp(-0.5 * z * z)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def index_text(process: Column, title: Column, body: Column) -> Column:
    """process | title | first 200 characters of body, blanks left out."""
    return F.concat_ws(" | ", blank_to_null(process), blank_to_null(title), blank_to_null(F.substring(body, 1, 200)))


def rerank_document(process: Column, title: Column, body: Column) -> Column:
    """process | title | first 600 characters of body as they are; all empty: (empty)."""
    d = F.concat_ws(" | ", F.nullif(process, F.lit("")), F.nullif(title, F.lit("")), F.nullif(F.substring(body, 1, 600), F.lit("")))
    return F.when(d == "", "(empty)").otherwise(d)


def clean_snippet(text: Column, max_tokens: int = 24, max_chars: int = 200) -> Column:
    """The first tokens of over one character that are not all digits and signs."""
    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    kept = F.filter(tokens, lambda w: (F.length(w) > 1) & w.rlike(r"\p{L}"))
    return F.substring(F.array_join(F.slice(kept, 1, max_tokens), " "), 1, max_chars)


def informative(text: Column, least: int = 8) -> Column:
    """At least 8 characters after white space collapses, 4 letters or digits, 4 distinct characters."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return (F.length(t) >= least) & (F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) >= 4) & (F.size(F.array_distinct(F.split(t, ""))) >= 4)


def fingerprint(text: Column, version: str = "v1") -> Column:
    """Versioned SHA-256 of an index text."""
    return F.sha2(F.concat(F.lit(version + "\0"), text), 256)


def process_from_path(path: Column) -> Column:
    """Lower-cased file name of a path with either kind of slash."""
    return F.lower(F.element_at(F.split(path, r"[\\/]"), -1))


def process_label(process: Column, known: dict[str, str] | None = None) -> Column:
    """A known label, or the name without .exe: up to three characters in upper case, else each word with a capital."""
    name = F.regexp_replace(F.trim(process), r"(?i)\.exe$", "")
    words = F.transform(F.split(F.regexp_replace(name, r"[_-]+", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    plain = F.when(F.length(name) <= 3, F.upper(name)).otherwise(F.array_join(words, " "))
    out = plain
    for k, v in (known or {}).items():
        out = F.when(F.lower(name) == k, F.lit(v)).otherwise(out)
    return out


def host(url: Column) -> Column:
    """Lower-cased host without a leading www., m. or app."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), r"^(www|m|app)\.", "")


def site_name(url: Column, known: dict[str, str] | None = None) -> Column:
    """A known site's name by host or by its last two labels, else the first label in title case."""
    h = host(url)
    labels = F.split(h, r"\.")
    last_two = F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(h)
    out = F.initcap(labels[0])
    for k, v in (known or {}).items():
        out = F.when((h == k) | (last_two == k), F.lit(v)).otherwise(out)
    return F.nullif(out, F.lit(""))


def url_entity(url: Column, noisy: tuple[str, ...] = ("search", "home", "index", "en", "fr", "de", "es")) -> Column:
    """The first path segment of 2 to 48 characters that is neither noisy nor a long hexadecimal id."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    fit = F.filter(F.split(path, "/"), lambda s: F.length(s).between(2, 48) & ~F.lower(s).isin(*noisy) & ~s.rlike("^[0-9a-fA-F]{16,}$"))
    return F.when(F.size(fit) > 0, F.element_at(fit, 1))


def urls_in(text: Column) -> Column:
    """Distinct URLs of a text in order; a bare www. gets https://."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)((?:https?://|www\.)[^\s\"'<>]+)"), F.lit(1))
    whole = F.transform(found, lambda u: F.when(F.lower(u).startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u))
    return F.array_distinct(whole)


def human_bytes(n: Column) -> Column:
    """Bytes in the unit that leaves under 1024: B without, others with two decimals."""
    out = F.format_string("%.2f TB", F.bround(n / float(1 << 40), 2))
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        out = F.when(F.abs(n) < size * 1024, F.format_string(f"%.2f {unit}", F.bround(n / float(size), 2))).otherwise(out)
    return F.when(F.abs(n) < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def lenient_int(text: Column) -> Column:
    """An integer from decimal text with commas, 0x hexadecimal, or a decimal fraction cut off; else null."""
    t = F.regexp_replace(F.trim(text), ",", "")
    hexed = F.conv(F.regexp_replace(t, "(?i)^0x", ""), 16, 10).cast("long")
    number = F.coalesce(t.try_cast("long"), t.try_cast("double").cast("long"))
    return F.when(t.rlike("(?i)^0x[0-9a-f]+$"), hexed).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number)


def float_list(text: Column, default: tuple[float, ...] = (1.0, 1.5, 2.0)) -> Column:
    """Numbers between commas, blanks skipped; none: the default."""
    parts = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(*[F.lit(x) for x in default]))


def link_set_key(links: Column) -> Column:
    """JSON of (url, text) pairs in sorted order, the same for any order of links."""
    return F.to_json(F.transform(F.array_sort(F.transform(links, lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text")))), lambda x: F.array(x["url"], x["text"])))


def path_category(path: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The name of the first rule whose part the lower-cased path contains."""
    p, out = F.lower(path), F.lit(default)
    for part, name in reversed(rules):
        out = F.when(p.contains(part), F.lit(name)).otherwise(out)
    return out


#: The code-point ranges of CJK ideographs.
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"


def is_cjk(char: Column) -> Column:
    """Whether a character is a CJK ideograph."""
    return char.rlike(f"^{CJK}$")


def percent_decoded(url: Column) -> Column:
    """UTF-8 text of a percent-encoded URL: a plus and a stray percent sign stay, broken bytes become U+FFFD."""
    safe = F.replace(F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(safe)


def title_score(text: Column) -> Column:
    """How title-like a text is: length, entropy and share of letters; URLs and single characters: 0.

    The entropy of a text of under 16 characters is scaled to what such a text can have at most.
    """
    t = F.trim(text)
    n = F.length(t).cast("double")
    h = entropy(t)
    z = (F.when(n < 16, h / F.log2(n) * 4.0).otherwise(h) - 4.0) / 1.5
    letters = F.regexp_count(t, F.lit(r"\p{L}")) / n
    score = F.log(n + 1.0) * F.exp(-0.5 * z * z) * letters / F.log(n + math.e)
    return F.when((n <= 1) | t.rlike("^https?://"), 0.0).otherwise(score)


#: Fixed values of the title rule: names that end a window title, names that are no subject of one, and editors.
TITLE_ENDS = ("Google Chrome", "Microsoft Edge", "Mozilla Firefox", "Brave", "Chromium", "Visual Studio Code")
NO_SUBJECT = ("Google Chrome", "Microsoft Edge", "Mozilla Firefox")
EDITOR_PROCESSES = ("Code", "Cursor")
EDITOR_NAMES = ("Visual Studio Code", "Code", "Cursor")


def without_title_ends(title: Column, app: Column, site: Column) -> Column:
    """A title, its blanks single, without the names of the app, the site and known programs that follow a dash, bar or dot at its end."""
    clean = F.trim(F.regexp_replace(title, r"\s+", " "))
    for name in (app, site, *map(F.lit, TITLE_ENDS)):
        # A name that isn't there is a pattern that fits nowhere.
        end = F.when(F.coalesce(name, F.lit("")) == "", F.lit(r"[^\s\S]")).otherwise(F.concat(F.lit(r"(?i)\s+[-|·]\s+\Q"), name, F.lit(r"\E$")))
        clean = F.trim(F.regexp_replace(clean, end, F.lit("")))
    return clean


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands in the result."""
    return F.transform(F.array(value), use)[0]


def title_entity(title: Column, process: Column, site: Column) -> Column:
    """What a title is about: a repository, an editor's project, the last part, or the title cut to 64 characters.

    Names of the program and the site at the end of the title go first.
    """
    app = process_label(process)
    return bound(without_title_ends(title, app, site), lambda clean: _entity_of(clean, app))


def _entity_of(clean: Column, app: Column) -> Column:
    named = lambda p, names: F.lower(p).isin([x.lower() for x in names])
    repo = F.regexp_extract(clean, r"(?:^|[\s:/·])[A-Za-z0-9_.-]+/([A-Za-z0-9_.-]+)", 1)
    parts = F.filter(F.transform(F.split(clean, r"\s+[-|]\s+"), lambda p: F.trim(p)), lambda p: (p != "") & ~named(p, EDITOR_NAMES))
    pieces = F.filter(F.transform(F.split(clean, r"\s+[-|·]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    last = F.try_element_at(pieces, F.lit(-1))
    fits = (F.size(pieces) > 1) & F.length(last).between(2, 48) & ~named(last, NO_SUBJECT)
    short = F.when(F.length(clean) > 64, F.concat(F.substring(clean, 1, 61), F.lit("..."))).otherwise(clean)
    editor = F.coalesce(named(app, EDITOR_PROCESSES), F.lit(False))
    return F.when(repo != "", repo).when(editor & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-1))).when(fits, last).otherwise(short)


def anchor_hash(text: Column) -> Column:
    """SHA-256 of an anchor's text: equal hashes reuse its scores."""
    return F.sha2(text, 256)
