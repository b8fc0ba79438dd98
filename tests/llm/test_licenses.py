"""op6 on whole notices, wrapped and changed a little, and on the same words in another order."""

import textwrap

from strataspark.llm import op6_license as op6

MIT, BSD = (t for t, label in op6.TEMPLATES.items() if label in ("mit", "bsd") and len(t) > 200)


def labels(spark, texts):
    got = op6.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [(r.labels, round(r.score, 2)) for r in got.orderBy("doc_id").collect()]


def test_whole_notices_in_comments(spark):
    wrap = lambda t, n, sign: "\n".join(sign + x for x in textwrap.wrap(t, n))
    isc = next(t for t, label in op6.TEMPLATES.items() if label == "isc")
    got = labels(spark, ["int x;\n" + wrap(MIT, 60, " * ") + "\n" + "code(); " * 3000, wrap(BSD, 30, "# "), wrap(isc, 45, "// ").upper(), "word\n" * 2000 + wrap(MIT, 70, "") + "\n" + wrap(BSD, 70, "")])
    assert got == [("mit", 1.0), ("bsd", 1.0), ("isc", 1.0), ("bsd,mit", 1.0)]


def test_order_matters(spark):
    got = labels(spark, ["the under licensed apache version 0 2 license is not ours", "licensed under the apache license version 2 0", " ".join(reversed(MIT.split()))])
    assert got == [("", 0.0), ("apache", 1.0), ("", 0.0)]


def test_a_few_changed_words(spark):
    words = op6.words_of(MIT)
    few, many = list(words), list(words)
    for k in range(10, len(words), 20):
        few[k] = "other"
    for k in range(10, len(words), 5):
        many[k] = "other"
    (a, score), (b, _) = labels(spark, [" ".join(few[8:]), " ".join(many[16:])])
    assert a == "mit" and 0.8 <= score < 1 and b == ""
