"""Tables of odd rows: nulls, copies, repeated ids, long texts, clashing names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = [f"w{i}" for i in range(300)] + ["été", "ñandú", "漢字", "Über"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    rng = random.Random(5)
    passage, other = prose(rng, 60), prose(rng, 25)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    texts += [texts[0]] * 4 + [texts[1] + " tail"] + [passage + " " + prose(rng, 10), prose(rng, 12) + "\n" + passage, passage + " " + passage]
    texts += [other + " x", "y " + other, other, "z " * 70, "z " * 40, "", None, " \t\n", "a", "ab cd", "... 12 !!"]
    texts += [prose(rng, 30_000), prose(rng, 40) + " " + "q" * 50_000]
    texts += [texts[2].upper(), "same words here and there", "same words here and there"]
    ids = list(range(len(texts)))
    ids[7] = 6  # a repeated id with another text
    ids[-1] = ids[-2]  # a repeated row
    ids[9] = None
    n = len(texts)
    lang = [["en", "fr", None][i % 3] for i in range(n)]
    source = [["s1", "s10", "s2", None, "hot", "hot", "hot"][i % 7] for i in range(n)]
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "text": pa.array(texts, pa.string()),
            "lang": pa.array(lang, pa.string()),
            "source": pa.array(source, pa.string()),
            "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
            **{c: pa.array([i for i in range(n)], pa.int64()) for c in ("size", "node", "chunk", "fp", "part", "target", "times", "taken", "score", "id", "anchor", "shard", "slot", "ids", "_part", "_tie")},
        }
    )


def pages():
    long = "<p>" + "long page é " * 4000 + "</p>"
    html = ["<p>a</p>", None, "", long, long, "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, "x" * 1000, "x" * 1000, "\r\n\r\n" * 300, "a\r\n0\r\n\r\n" * 300, None]
    ids = [3, 1, 2, 10, 4, 5, 6, 7, 8, 9, 9, 11, 12, None]
    urls = [None, "http://a/\r\nb", ""] + [f"http://h/{i}" for i in range(11)]
    return pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(html, pa.string()), "digest": pa.array(range(14)), "payload": pa.array(range(14))})


def embeddings():
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    near = [[x + rng.gauss(0, 0.03) for x in base[i % 4]] for i in range(30)]
    rows = base + near + [base[0]] * 5 + [[2 * x for x in base[1]]]
    rows += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0], []]
    ids = list(range(len(rows)))
    ids[-3] = ids[-4]
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows)), "node": pa.array(ids, pa.int64()), "n": pa.array(ids, pa.int64())})


def labels(n):
    return pa.table({"doc_id": pa.array([0, 1, 1, None, 3], pa.int64())[:n], "quality": pa.array([1, 0, 1, 1, None], pa.int64())[:n], "toxic": pa.array([0] * 5, pa.int64())[:n]})


def put(folder, empty):
    for name, t in (("documents", documents()), ("pages", pages()), ("embeddings", embeddings()), ("labels", labels(5))):
        pq.write_table(t.slice(0, 0) if empty else t, folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    return put(tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return put(tmp_path_factory.mktemp("empty"), True)


@pytest.fixture(scope="session")
def docs(odd):
    return pq.read_table(f"{odd}/documents.parquet").select(["doc_id", "text", "lang", "source"]).to_pylist()
