"""Secret scans with an incremental ledger of blobs.

A version of a text is a blob, addressed by its SHA-256. The ledger has one row per blob: which rules, in which version,
have scanned it, and the spans found. A run addresses all texts, scans only blobs that the ledger lacks in some rule's present version, by just
those rules, and joins the findings back to every path that holds the blob. A blob that many
paths share is read once, from its smallest path. Findings of rules that a run doesn't name stay in the ledger and out of the run's result.
The query scans into an empty ledger, stores it, and answers every path from the stored one. Everything is DataFrame functions.

Spans come from the gaps between matches: a text split by a pattern, with the matches extracted, gives
each match's place by a running sum of lengths: inside blocks of RUN matches, then over blocks, so that many matches in one text don't cost
their square.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.checkpoints import stored

from .common import NULL_ID, cut, read, skew_join, text_of

LEDGER = "blob binary, scanned map<string,int>, spans array<struct<start:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """pattern's matches whose group has at least fewest characters. hints: one of them stands in lower case in every text that matches."""

    kind: str
    pattern: str
    group: int = 0
    fewest: int = 0
    hints: tuple[str, ...] = ()
    version: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}"),
)
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", hints=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyj",)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("-----begin",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
)
_SPANS = "array<struct<start:int,end:int,kind:string>>"
RUN = 128
#: Up to so many blobs to scan (some 60 bytes each, without their texts) are broadcast to the texts; others are shuffled with them.
MAX_DUE = 100_000


#: Spans of the matches in m: w, their texts, h, the texts of their groups, g, the gaps between them. Arrays of one element bind what is used
#: more than once to a name. blocks has for each RUN matches their places from the block's start, and where it ends.
PLACED = f"""
transform(array(transform(array({{m}}), m -> zip_with(zip_with(m.w, m.h, (w, h) -> struct(length(w) AS n, length(h) AS h)), slice(m.g, 1, size(m.w)), (x, g) -> struct(length(g) AS gap, x.n AS n, x.h AS h)))[0]), items ->
  transform(array(transform(sequence(0, greatest(size(items) - 1, 0), {RUN}), k -> aggregate(slice(items, k + 1, {RUN}),
      struct(0 AS at, cast(array() AS array<struct<start: int, end: int, h: int>>) AS out),
      (acc, x) -> struct(acc.at + x.gap + x.n AS at, array_append(acc.out, struct(acc.at + x.gap AS start, acc.at + x.gap + x.n AS end, x.h AS h)) AS out)))), blocks ->
    flatten(zip_with(blocks,
      aggregate(blocks, struct(0 AS at, cast(array() AS array<int>) AS out), (acc, b) -> struct(acc.at + b.at AS at, array_append(acc.out, acc.at) AS out), acc -> acc.out),
      (b, at) -> transform(filter(b.out, x -> x.h >= {{fewest}}), x -> struct(x.start + at AS start, x.end + at AS end, '{{kind}}' AS kind))))
  )[0])[0]"""


def matches(text: Column, low: Column, rule: Rule) -> Column:
    """The rule's matches, leftmost and non-overlapping, their groups and the gaps between; null if there are none."""
    may = text.rlike(rule.pattern)
    if rule.hints:
        hinted = F.lit(False)
        for h in rule.hints:
            hinted |= F.contains(low, F.lit(h))
        may = hinted & may
    whole, held = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    return F.when(may, F.struct(whole.alias("w"), held.alias("h"), F.split(text, rule.pattern, -1).alias("g")))


def rule_spans(m: str, rule: Rule) -> Column:
    """Spans of the matches in column m, in code points, end exclusive."""
    return F.coalesce(F.expr(PLACED.format(m=m, fewest=rule.fewest, kind=rule.kind)).cast(_SPANS), F.array().cast(_SPANS))


def _of(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def _fresh(scanned: Column, rule: Rule) -> Column:
    """The ledger has the rule's present version."""
    return F.coalesce(F.element_at(scanned, rule.kind) == rule.version, F.lit(False))


def _sorted(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """By start, then in the order of rules; kinds without a rule first."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans) for every row of docs, spans by start, then in the order of rules; and the ledger's new state.

    Null texts are the empty blob. Repeated rows and rows that share a doc_id (a document's versions) are paths of their own. A null doc_id is kept. An
    empty table gives no rows and leaves the ledger as it is. Columns other than doc_id and text aren't read. What the ledger
    holds of rules that aren't among rules stays there, and isn't returned."""
    spark = docs.sparkSession
    kinds = [r.kind for r in rules]
    df = docs.select("doc_id", text_of(docs).alias("text"))
    blob = F.unhex(F.sha2("text", 256))
    paths = cut(df.select("doc_id", blob.alias("blob")))
    heads = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("_id"), F.count("*").alias("_n"))
    if ledger is None:
        known = heads.select("*", F.lit(None).cast("map<string,int>").alias("scanned"), F.lit(None).cast(_SPANS).alias("spans"))
    else:
        known = cut(heads.join(ledger.select("blob", "scanned", "spans"), "blob", "left"))
    missing = F.lit(False)
    for r in rules:
        missing |= ~_fresh(F.col("scanned"), r)
    due = known.where(missing)
    few = ledger is not None and due.count() <= MAX_DUE
    texts = df.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), blob.alias("blob"), "text").join(F.broadcast(due) if few else due.hint("shuffle_hash"), ["blob", "_id"])
    before = F.coalesce("spans", F.array().cast(_SPANS))
    texts = texts.withColumn("_low", F.lower("text")).withColumns({f"_m{k}": F.when(~_fresh(F.col("scanned"), r), matches(F.col("text"), F.col("_low"), r)) for k, r in enumerate(rules)})
    parts = [F.when(_fresh(F.col("scanned"), r), _of(before, [r.kind])).otherwise(rule_spans(f"_m{k}", r)) for k, r in enumerate(rules)]
    others = F.filter(before, lambda s: ~s["kind"].isin(kinds))
    now = F.map_concat(F.map_filter(F.coalesce("scanned", F.create_map().cast("map<string,int>")), lambda k, _: ~k.isin(kinds)), F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)]))
    scanned = cut(texts.select("blob", now.alias("scanned"), _sorted(F.flatten(F.array(others, *parts)), rules).alias("spans")).dropDuplicates(["blob"]))
    state = scanned if ledger is None else ledger.select("blob", "scanned", "spans").join(scanned.select("blob"), "blob", "left_anti").unionByName(scanned)
    fresh = scanned.select("blob", F.col("spans").alias("_new")).where(F.size("_new") > 0)
    told = known.select("blob", "_n", F.when(missing, None).otherwise(F.col("spans")).alias("_old")).join(fresh, "blob", "left")
    told = told.select("blob", "_n", F.coalesce("_new", "_old", F.array().cast(_SPANS)).alias("spans"))  # every blob, so that frequent ones without findings are known too
    out = skew_join(paths, told, "blob", "_n", paths.count())
    return out.select("doc_id", "blob", _sorted(_of(F.col("spans"), kinds), rules).alias("spans")), state


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql(rule: Rule, order: int) -> str:
    """Spans of a rule's matches: the gaps between them and their own lengths, summed up."""
    pattern = rule.pattern.replace("'", "''").replace("(?<![0-9a-f])", "")  # a run of 16 or more is its leftmost match without it
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT, 'n': length(m[i]), 'h': length(h[i])}}), lambda x: x.h >= {rule.fewest})) AS x
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS h, string_split_regex(text, '{pattern}') AS g FROM docs)"""


_LISTED = "coalesce(string_agg(kind || ':' || x.s || ':' || (x.s + x.n), ',' ORDER BY x.s, o){where}, '')"
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({" UNION ALL ".join(_sql(r, k) for k, r in enumerate(RULES))})
SELECT docs.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256({_LISTED.format(where=" FILTER (o < 3)")}) AS base_sha256, {_LISTED.format(where=" FILTER (kind IS NOT NULL)")} AS spans
FROM docs LEFT JOIN spans ON docs.doc_id = spans.doc_id GROUP BY docs.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = scan_secrets(docs)
    found, _ = scan_secrets(docs, stored(ledger, "secret-ledger"))
    kinds = [r.kind for r in BASE_RULES]
    n = [F.size(_of(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in kinds]
    base = _of(F.col("spans"), kinds)
    return found.select("doc_id", *n, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
