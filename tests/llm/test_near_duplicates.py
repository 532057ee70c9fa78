"""The near_duplicates stage where doc_id is null, repeats, or names rows of several groups."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _text(name, n=60, changed=""):
    return " ".join([f"{name}{i}" for i in range(n)] + [changed]).strip()


def test_one_row_of_each_group(spark):
    texts = [
        (None, _text("a")),
        (None, _text("b")),  # unlike the others of no id
        (None, _text("b", changed="x")),
        (None, _text("c")),
        (1, _text("c", changed="x")),  # has an id, so it stays for the group
        (2, _text("d")),
        (2, _text("e")),  # another text under one id
        (3, _text("f")),
        (4, _text("a0b")),
        (4, _text("f", changed="x")),  # copy of another group's
        (5, _text("g")),
        (5, _text("g")),
        (6, _text("h", changed="y")),
        (6, _text("h", changed="x")),  # the lesser text of one id
        (7, None),
        (7, None),
        (7, " \n"),
        (None, ""),
        (None, "\x0b\x0c"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in texts], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in cp.near_duplicates(spark, docs, "").collect()), key=repr)
    gone = [2, 3, 9, 11, 12, 15]
    want = [x for i, x in enumerate(texts) if i not in gone]
    want = sorted(((d, t, None if t is None else len(t)) for d, t in want), key=repr)
    assert got == want
