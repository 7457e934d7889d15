"""Sites, entities and titles of what someone was doing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, process_label, title_entity

# Fixed values of the rules: names of sites and programs, path segments that say nothing, labels that are none, and browsers.
SITES = {
    "github.com": "GitHub", "gitlab.com": "GitLab", "bitbucket.org": "Bitbucket", "stackoverflow.com": "Stack Overflow", "stackexchange.com": "Stack Exchange", "developer.mozilla.org": "MDN",
    "docs.rs": "Docs.rs", "npmjs.com": "npm", "pypi.org": "PyPI", "notion.so": "Notion", "figma.com": "Figma", "youtube.com": "YouTube", "youtu.be": "YouTube", "bilibili.com": "Bilibili",
    "zhihu.com": "Zhihu", "weibo.com": "Weibo", "x.com": "X", "twitter.com": "X",
}
PROGRAMS = {"code": "Code", "cursor": "Cursor", "chrome": "Chrome", "msedge": "Edge", "firefox": "Firefox", "wechat": "WeChat", "weixin": "WeChat", "qq": "QQ"}
NOISY = ("app", "dashboard", "explore", "feed", "home", "login", "notifications", "pulls", "search", "settings", "signin", "signup", "users")
WEAK = ("chrome", "edge", "firefox", "browser-extension", "code", "cursor")
BROWSERS = "(?i)(chrome|msedge|edge|firefox|brave|chromium|browser|qqbrowser|360se)"
REPOSITORIES = ("github.com", "gitlab.com", "bitbucket.org")

URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"


def compact(text: Column) -> Column:
    """Blanks single, none at the ends; null: empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def host(url: Column) -> Column:
    """Lower-cased host without a leading www., m. or app.; the scheme may be missing. Null: empty."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)), r"^(www|m|app)\.", "")


def titled(token: Column) -> Column:
    """A token of up to three characters in upper case, else each word with a capital."""
    clean = F.regexp_replace(compact(token), "[-_]+", " ")
    words = F.transform(F.split(clean, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.when(F.length(clean) <= 3, F.upper(clean)).otherwise(F.array_join(words, " "))


def site(url: Column) -> Column:
    """A known site's name by its host or the last two labels of it, else the first label as a title; none: empty."""
    names = F.create_map(*[F.lit(x) for kv in SITES.items() for x in kv])
    known = lambda h: F.coalesce(F.try_element_at(names, h), F.try_element_at(names, F.substring_index(h, ".", -2)))
    return bound(host(url), lambda h: F.when(h == "", "").otherwise(F.coalesce(known(h), titled(F.substring_index(h, ".", 1)))))


def entity(url: Column) -> Column:
    """What a URL is about: by the rules of known hosts and their true subdomains, else the first telling path segment; none: empty."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)
    segments = F.filter(F.transform(F.split(path, "/"), lambda s: F.coalesce(F.try_url_decode(s), s)), lambda s: s != "")
    return bound(F.struct(host(url).alias("h"), segments.alias("seg")), lambda u: _entity_of(u["h"], u["seg"]))


def _entity_of(h: Column, seg: Column) -> Column:
    on = lambda *domains: _any([(h == d) | h.endswith(f".{d}") for d in domains])
    at = lambda k: F.get(seg, F.lit(k))
    telling = F.filter(seg, lambda s: ~F.lower(s).isin(*NOISY) & s.rlike(r"[\p{L}\p{N}]") & F.length(s).between(2, 48) & ~s.rlike("^[0-9a-fA-F]{16,}$"))
    return (
        F.when(F.size(seg) == 0, "")
        .when(on(*REPOSITORIES), F.coalesce(at(1), at(0)))
        .when(on("npmjs.com") & (at(0) == "package") & at(1).isNotNull(), at(1))
        .when(on("pypi.org") & (at(0) == "project") & at(1).isNotNull(), at(1))
        .when(on("docs.rs"), at(0))
        .otherwise(compact(F.get(telling, F.lit(0))))
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def label(process: Column) -> Column:
    """A known program's name, else that of the file; null: empty."""
    return F.coalesce(process_label(compact(process), PROGRAMS), F.lit(""))


def activities(current: DataFrame, related: DataFrame) -> DataFrame:
    """(key, title, site, host, process, entity): a title for each current record and the records related to it.

    ``current``: key, process_name, window_title, page_url, and what is known
    of the group: dominant_process and task_label. ``related``: key, place,
    process_name, window_title, page_url. Where the current record does not
    tell, the most frequent value of all records does, the first of equals.
    """
    from ..operators.relations import first_wins_mode

    said = lambda c: F.nullif(compact(F.col(c)), F.lit(""))
    names = ["process_name", "window_title", "page_url"]
    every = current.select("key", F.lit(0).cast("long").alias("place"), *names).unionByName(related.select("key", (F.col("place") + 1).cast("long").alias("place"), *names))
    every = every.filter(F.coalesce(*map(said, names)).isNotNull())
    every = every.withColumns({"host": host(F.col("page_url")), "site": site(F.col("page_url")), "url_entity": entity(F.col("page_url"))})

    def mode(rows: DataFrame, value: str, name: str) -> DataFrame:
        return first_wins_mode(rows, "key", value, "place").select("key", F.col(value).alias(name))

    cur = current.withColumns({"_host": host(F.col("page_url")), "_site": site(F.col("page_url")), "_url": entity(F.col("page_url"))})
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    g = cur.join(mode(every, "host", "_mode_host"), "key", "left").withColumn("host", F.coalesce(full("_host"), "_mode_host", F.lit("")))
    there = every.join(g.select("key", F.col("host").alias("_dominant")), "key")
    g = g.join(mode(there.filter("host = _dominant"), "site", "_mode_site"), "key", "left").withColumn("site", F.coalesce(full("_site"), "_mode_site", F.lit("")))
    g = g.join(mode(there.filter("_dominant = '' or host = _dominant"), "url_entity", "_mode_url"), "key", "left")
    g = g.join(mode(every, "process_name", "_mode_process"), "key", "left")
    title = lambda t, p: title_entity(t, F.coalesce(p, F.lit("")), F.col("_site_name"))
    of_titles = every.join(g.select("key", F.col("site").alias("_site_name")), "key").withColumn("t", title(F.col("window_title"), F.col("process_name")))
    g = g.join(mode(of_titles, "t", "_mode_title"), "key", "left").withColumn("_site_name", F.col("site"))
    own = F.nullif(F.coalesce(title(F.col("window_title"), F.col("process_name")), F.lit("")), F.lit(""))
    g = g.withColumn("entity", compact(F.coalesce(full("_url"), "_mode_url", own, "_mode_title")))
    g = g.withColumn("process", label(F.coalesce(full("dominant_process"), "_mode_process")))
    browser = F.coalesce(full("dominant_process"), full("process_name"), F.lit("")).rlike(BROWSERS)
    differs = lambda c: (F.col("entity") != "") & (F.lower("entity") != F.lower(c))
    task = compact(F.col("task_label"))
    weak = (task == "") | ((F.col("process") != "") & (F.lower(task) == F.lower("process"))) | F.lower(task).isin(*WEAK)
    named = F.concat(F.col("site"), F.lit(" - "), F.col("entity"))
    out = (
        F.when((F.col("site") != "") & (browser | (F.coalesce("page_url", F.lit("")) != "")), F.when(differs("site"), named).otherwise(F.col("site")))
        .when((F.col("process") != "") & differs("process"), F.concat(F.col("process"), F.lit(" - "), F.col("entity")))
        .when(~weak, F.col("task_label"))
        .otherwise(F.coalesce(full("process"), full("entity"), F.col("task_label"), F.lit("")))
    )
    return g.select("key", compact(out).alias("title"), "site", "host", "process", "entity")
