"""Sites, URL entities and activity titles by their rules."""

import pytest
from pyspark.sql import functions as F

from chronolake.functions import activity


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("url", "site", "entity"), [
    ("https://github.com/example/paper/pulls", "GitHub", "paper"),
    ("https://gist.github.com/one", "GitHub", "one"),
    ("https://evilgithub.com/example/paper/pulls", "Evilgithub", "example"),
    ("https://evilnpmjs.com/package/react", "Evilnpmjs", "package"),
    ("https://www.npmjs.com/package/react", "npm", "react"),
    ("https://pypi.org/project/requests/", "PyPI", "requests"),
    ("https://pypi.org/search?q=1", "PyPI", ""),
    ("docs.rs/serde/1.0", "Docs.rs", "serde"),
    ("https://developer.mozilla.org/en-US/docs", "MDN", "en-US"),
    ("https://m.bbc.co.uk:80/login/%E4%BD%A0%E5%A5%BD+x/0123456789abcdef", "BBC", "你好 x"),
    ("https://a-b_c.example.org/%zz/x", "A B C", "%zz"),
    ("https://user@x.com/", "X", ""),
    ("", "", ""),
    (None, "", ""),
])
def test_sites_and_entities(spark, url, site, entity):
    assert one(spark, activity.site, url) == site and one(spark, activity.entity, url) == entity


CURRENT = "key long, process_name string, window_title string, page_url string, dominant_process string, task_label string"
RELATED = "key long, place long, process_name string, window_title string, page_url string"


def titles(spark, current, related=()):
    out = activity.activities(spark.createDataFrame(current, CURRENT), spark.createDataFrame(list(related), RELATED))
    return {r["key"]: (r["title"], r["site"], r["process"], r["entity"]) for r in out.collect()}


def test_titles(spark):
    got = titles(spark, [
        (1, "chrome.exe", "Pull requests · example/paper - GitHub", "https://github.com/example/paper/pulls", "chrome.exe", None),
        (2, "Code.exe", "Card.jsx - paper - Visual Studio Code", None, "Code.exe", "x"),
        (3, "notes.exe", None, None, "notes.exe", "My task"),
        (4, "chrome.exe", None, None, None, "Chrome"),
        (5, None, None, None, None, None),
        (6, "chrome.exe", "New tab", None, None, None),
        (7, "chrome.exe", None, "https://figma.com/", None, None),
        (8, "word.exe", "Word", None, None, " Report  one "),
    ], [
        (6, 0, "chrome.exe", "t", "https://gitlab.com/a/one"), (6, 1, "code.exe", "t", "https://gitlab.com/a/two"), (6, 2, "code.exe", "t", "https://gitlab.com/b/two"), (6, 3, "code.exe", "t", "https://x.com/zz"),
        (8, 0, None, None, None),
    ])
    assert got == {
        1: ("GitHub - paper", "GitHub", "Chrome", "paper"),
        2: ("Code - paper", "", "Code", "paper"),
        3: ("My task", "", "Notes", ""),
        4: ("Chrome", "", "Chrome", ""),
        5: ("", "", "", ""),
        6: ("GitLab - two", "GitLab", "Code", "two"),
        7: ("Figma", "Figma", "Chrome", ""),
        8: ("Report one", "", "Word", "Word"),
    }


def plain_title(rows, current):
    """The title of one group by the rule, on values that the column functions gave."""

    def mode(values):
        values = [x for x in values if x]
        return max(values, key=lambda x: (values.count(x), -values.index(x)), default="")

    host = current["host"] or mode(r["host"] for r in rows)
    site = current["site"] or mode(r["site"] for r in rows if r["host"] == host)
    entity = current["url_entity"] or mode(r["url_entity"] for r in rows if not host or r["host"] == host)
    return host, site, entity


def test_hosts_and_entities_of_groups_equal_the_loop(spark):
    import random

    rng = random.Random(7)
    urls = [None, "https://github.com/a/b", "https://github.com/c/d", "https://x.com/q/zz", "https://x.com/", "https://foo.org/one/two", "bad"]
    current, related = [], []
    for k in range(30):
        current.append((k, "chrome.exe", None, rng.choice(urls), None, None))
        related += [(k, p, "chrome.exe", None, rng.choice(urls)) for p in range(rng.randrange(6))]
    got = {r["key"]: (r["host"], r["site"], r["entity"]) for r in activity.activities(spark.createDataFrame(current, CURRENT), spark.createDataFrame(related, RELATED)).collect()}
    parts = {u: r.asDict() for u, r in ((u, spark.createDataFrame([(u,)], "x string").select(activity.host(F.col("x")).alias("host"), activity.site(F.col("x")).alias("site"), activity.entity(F.col("x")).alias("url_entity")).first()) for u in urls)}
    for k, _, _, url, _, _ in current:
        rows = [parts[url]] + [parts[r[4]] for r in related if r[0] == k]
        assert got[k] == plain_title(rows, parts[url]), k
