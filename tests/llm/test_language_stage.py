"""The language stage rejects by its own decoding."""

import base64
import random

import corpus_pipeline

WORDS = {"en": "the of and to in that was he for it with as his on be".split(), "fr": "le de un être et à il avoir ne je son que se qui ce".split()}


def test_unlearned_texts_go_and_clean_short_ones_stay(spark):
    rng = random.Random(4)
    rows = []
    for lang, words in WORDS.items():
        rows += [(lang, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 8, 40, 150, 400))))) for _ in range(1200)]
    mixed = [" ".join(rng.choice(WORDS[lang]) for lang in ("en", "fr") for _ in range(100)) for _ in range(20)]
    junk = [base64.b64encode(rng.randbytes(600)).decode() for _ in range(20)]
    junk += ["".join(rng.choice("абвгдежзийклмнопрстуфхцчшщ ") for _ in range(400)) for _ in range(20)]
    rows += [(None, t) for t in [*mixed, *junk]]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    stay = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    clean = range(2400 + len(mixed))
    assert set(clean) <= stay
    assert not stay & set(range(2400 + len(mixed), len(rows)))
