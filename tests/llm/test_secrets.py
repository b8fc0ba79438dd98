"""op9's ledger over several runs, and texts with very many findings."""

import time

from pyspark.sql import functions as F

from strataspark.llm import op9_secrets as op9

GITHUB = "ghp_" + "x" * 40


def spans(found):
    return {r.doc_id: r.s for r in found.select("doc_id", op9.written(F.col("spans")).alias("s")).collect()}


def test_findings_of_absent_rules_stay_in_the_ledger_and_out_of_the_result(spark):
    docs = spark.createDataFrame([(1, GITHUB), (2, f"token=abcdefghijkl {GITHUB}"), (3, GITHUB)], "doc_id long, text string")
    _, ledger = op9.scan_secrets(docs)
    found, state = op9.scan_secrets(docs, ledger, op9.BASE_RULES)
    assert spans(found) == {1: "", 2: "assign:0:18", 3: ""}
    again, _ = op9.scan_secrets(docs, state)
    assert spans(again) == {1: "github:0:44", 2: "assign:0:18,github:19:63", 3: "github:0:44"}


def test_rules_that_come_later_scan_known_blobs_and_keep_what_was_found(spark):
    docs = spark.createDataFrame([(1, f"token=abcdefghijkl {GITHUB}"), (2, "clean")], "doc_id long, text string")
    _, ledger = op9.scan_secrets(docs, rules=op9.BASE_RULES)
    assert {tuple(sorted(r.scanned)) for r in ledger.collect()} == {("access", "assign", "hex")}
    more = docs.unionByName(spark.createDataFrame([(1, f"a newer version {GITHUB}")], docs.schema))
    found, state = op9.scan_secrets(more, ledger)
    assert sorted(op9_row.s for op9_row in found.select(op9.written(F.col("spans")).alias("s")).collect()) == ["", "assign:0:18,github:19:63", "github:16:60"]
    assert state.count() == 3 and all(len(r.scanned) == len(op9.RULES) for r in state.collect())


def test_many_findings_in_one_text_take_time_in_proportion(spark):
    n = 30_000
    docs = spark.createDataFrame([(1, " ".join(["é"] + [f"{k:020x}" for k in range(n)]))], "doc_id long, text string")
    start = time.time()
    found = op9.scan_secrets(docs)[0].collect()[0].spans
    assert time.time() - start < 30
    assert [(s.start, s.end) for s in found] == [(2 + 21 * k, 22 + 21 * k) for k in range(n)]
