"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are pairs of neighbouring words, so the order of words matters. Blocks are sets of tokens: lines and, for notices that are wrapped, runs of words
over the ends of lines. A line has a template's label if it holds at least THRESHOLD of the template's tokens, a run if so many stand within SPAN times
the template's length. Templates are sentences and whole notices.
1. The corpus is counted once for the documents that hold each of the templates' words; tokens are then ranked by their rarer word, rarest first.
2. A template of n tokens that must share need = ceil(THRESHOLD * n) of them is indexed by its n - need + 1 rarest tokens only (prefix
   filter). Documents without the rarer word of any such token, and blocks without any such token, go no further.
3. A block is the sorted ranks of its template tokens. Blocks meet templates on indexed tokens, if they have
   need tokens at all (length filter), and if what is left of both behind the match can still make need (positional filter).
4. Each pair is verified once, at its first common token, by whole sets, and in runs by the tokens' places.

The templates are a parameter of at most MAX_TOKENS tokens, which bounds what is broadcast. All steps are DataFrame functions.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, ascii_lower, read, text_of

#: A character of a word, and one that isn't, before A-Z are lower-cased. A class of ranges is searched far faster than the negated one.
IN, OUT = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences and notices of well-known licenses, and their labels.
TEMPLATES = {
    "released under the MIT license": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "licensed under the Apache license version 2 0": "apache",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache",
    "this work is licensed under the GNU general public license version 3": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl",
    "licensed under CC BY NC 4 0": "cc-by-nc",
    "licensed under a Creative Commons Attribution 4 0 International license": "cc-by",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely": "zlib",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/": "mpl",
    "all rights reserved": "reserved",
}
THRESHOLD, MAX_TOKENS, SPAN = 0.8, 100_000, 2


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(IN + "+")).cast("long")


def _phrase(words: str) -> str:
    """A pattern for the phrase's words in a row; only ASCII letters match in either case."""
    return f"(?i)(?<!{IN}){(OUT + '+').join(words.split())}(?!{IN})"


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def tokens_of(text: str) -> list[str]:
    """Different pairs of neighbouring words, joined by a blank, in order."""
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _any(phrases) -> str:
    """A pattern for any of the words, or pairs of words, by first letters, so that few are tried at each place."""
    by: dict[str, list[str]] = {}
    for t in sorted(phrases):
        by.setdefault(t[0], []).append((OUT + "+").join(map(re.escape, t[1:].split(" "))))
    return f"(?i)(?<!{IN})(?:{'|'.join(f'{re.escape(c)}(?:{"|".join(rest)})' for c, rest in by.items())})(?!{IN})"


def with_base(df: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and _base to df with _text.

    Step by step, so that no count is made twice: what may hold a phrase by a cheap look at the lower-case text; the places there; then words before the first and behind the last."""
    text, low, keys = F.col("_text"), F.lower("_text"), list(phrases)
    may = {}
    for k, p in enumerate(keys):
        seen = F.lit(True)
        for w in p.split():
            seen &= F.contains(low, F.lit(w))
        may[f"_may{k}"] = F.when(seen, low.rlike((OUT + "+").join(p.split()))).otherwise(False)
    df = df.withColumns(may).withColumns({"n_words": n_words(text)} | {f"_n{k}": F.when(F.col(f"_may{k}"), F.regexp_count(text, F.lit(_phrase(p)))).otherwise(0).cast("long") for k, p in enumerate(keys)})
    first, last, labels = [], [], []
    for k, p in enumerate(keys):
        parts, there = F.split(text, _phrase(p), -1), F.col(f"_n{k}") > 0
        first.append(F.when(there, n_words(parts[0])))
        last.append(F.when(there, F.col("n_words") - n_words(F.element_at(parts, -1)) - len(p.split())))
        labels.append(F.when(there, phrases[p]))
    total = sum((F.col(f"_n{k}") for k in range(len(keys))), F.lit(0).cast("long"))
    none = F.array().cast("array<long>")
    out = {"n_base": total, "first_word": F.array_min(F.array(*first) if keys else none), "last_word": F.array_max(F.array(*last) if keys else none), "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels).cast("array<string>"))))}
    return df.withColumns(out).drop(*may, *[f"_n{k}" for k in range(len(keys))])


def wrapped(text: Column, span: int) -> Column:
    """Texts of more than one line as overlapping runs of 2 * span words; any span words in a row stand in one of them."""
    runs = lambda ws: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1 - span, F.lit(0)), F.lit(span)), lambda k: F.array_join(F.slice(ws, k + 1, 2 * span), " "))
    once = F.array(F.regexp_extract_all(text, F.lit(IN + "+"), F.lit(0)))  # a variable of transform, so that a text is split once
    return F.when(F.contains(text, F.lit("\n")), F.flatten(F.transform(once, runs))).otherwise(F.array().cast("array<string>"))


def most_within(at: Column, ranks: Column, span: Column) -> Column:
    """The largest number of different ranks whose places lie within span words in a row."""
    own = F.array(F.filter(at, lambda x: F.array_contains(ranks, x["rank"])))
    near = lambda xs, s: F.size(F.array_distinct(F.transform(F.filter(xs, lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + span)), lambda x: x["rank"])))
    return F.array_max(F.flatten(F.transform(own, lambda xs: F.transform(xs, lambda s: near(xs, s)))))


def with_tokens(line: Column, vocabulary: list[str], rank) -> Column:
    """(own, at): the sorted ranks of a block's template tokens, and the places of each."""
    pairs = lambda ws: F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.get(ws, i - 1), F.get(ws, i)))).otherwise(F.array().cast("array<string>"))

    def ranked(ps: Column, held: Column) -> Column:
        places = F.filter(F.transform(ps, lambda p, k: F.struct(k.alias("pos"), p.alias("p"))), lambda x: F.array_contains(held, x["p"]))
        return F.struct(F.array_sort(F.transform(held, rank)).alias("own"), F.transform(places, lambda x: F.struct(x["pos"].alias("pos"), rank(x["p"]).alias("rank"))).alias("at"))

    known = F.array(*map(F.lit, vocabulary))
    words = F.array(F.regexp_extract_all(ascii_lower(line), F.lit(IN + "+"), F.lit(0)))  # arrays of one element bind what is used more than once to a name
    of_pairs = lambda ps: F.transform(F.array(F.array_intersect(ps, known)), lambda held: ranked(ps, held))[0]
    return F.transform(F.transform(words, pairs), of_pairs)[0]


def template_matches(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(_id, found, best): labels of the templates that some line or run of a document contains, and the largest containment."""
    spark = docs.sparkSession
    sets = [(k, label, tokens_of(t)) for k, (t, label) in enumerate(templates.items())]
    tokens = sorted({x for _, _, s in sets for x in s})
    if sum(len(s) for _, _, s in sets) > MAX_TOKENS:
        raise ValueError(f"templates of more than {MAX_TOKENS} tokens")
    words, vocabulary = F.regexp_extract_all(F.lower("_text"), F.lit(IN + "+"), F.lit(0)), sorted({w for x in tokens for w in x.split()})
    seen = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    counts = {r.w: r["count"] for r in seen.collect()}  # one row for each word of the templates
    rarer = {x: min((counts.get(w, 0), w) for w in x.split()) for x in tokens}
    order = {x: k for k, x in enumerate(sorted(tokens, key=lambda x: (rarer[x], x)))}
    index, prefix, spans = [], set(), [SPAN * len(words_of(t)) for t in templates]
    for k, label, s in sets:
        ranks = sorted(order[x] for x in s)
        need = ceil(threshold * len(ranks) - 1e-9)
        for p, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.append((r, k, label, p, need, ranks, spans[k]))
            prefix.add(r)
    table = spark.createDataFrame(index, "rank int, template int, label string, p int, need int, ranks array<int>, span int")
    rare = _any([x for x, r in order.items() if r in prefix])
    ranks = F.create_map(*[F.lit(y) for x, r in order.items() for y in (x, r)])
    text = lambda run: lambda x: F.struct(x.alias("line"), F.lit(run).alias("run"))
    both = F.concat(F.transform(F.split("_text", "\n"), text(False)), F.transform(wrapped(F.col("_text"), max(spans, default=1)), text(True)))
    hints = F.array(*[F.lit(w) for w in sorted({rarer[x][1] for x, r in order.items() if r in prefix})])
    lines = docs.where(F.arrays_overlap(words, hints)).where(F.col("_text").rlike(rare)).select("_id", F.explode(both).alias("_b")).select("_id", F.col("_b.line").alias("line"), F.col("_b.run").alias("run")).where(F.col("line").rlike(rare))
    blocks = lines.select("_id", "run", with_tokens(F.col("line"), tokens, lambda x: F.element_at(ranks, x)).alias("_t"))
    pairs = blocks.select("_id", F.col("_t.own").alias("own"), F.when(F.col("run"), F.col("_t.at")).alias("at")).select("*", F.posexplode("own").alias("i", "rank")).join(F.broadcast(table), "rank")
    pairs = pairs.where((F.size("own") >= F.col("need")) & (1 + F.least(F.size("ranks") - F.col("p") - 1, F.size("own") - F.col("i") - 1) >= F.col("need")))
    common = F.array_intersect("ranks", "own")
    hits = pairs.withColumn("common", common).where((F.size("common") >= F.col("need")) & (F.col("common")[0] == F.col("rank")))
    hits = hits.withColumn("held", F.when(F.col("at").isNull(), F.size("common")).otherwise(most_within(F.col("at"), F.col("ranks"), F.col("span")))).where(F.col("held") >= F.col("need"))
    return hits.groupBy("_id").agg(F.collect_set("label").alias("found"), F.max(F.col("held") / F.size("ranks")).alias("best"))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased. A base phrase stands wherever its words are consecutive. score is 1 with a
    base phrase, else the largest containment of a template that reached the threshold, else 0. Null and empty texts have no words and no
    labels. Rows that share a doc_id get each other's template labels; a null doc_id is an id like others. An empty table gives no rows."""
    df = docs.select("doc_id", text_of(docs).alias("_text")).withColumn("_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    each = with_base(df, phrases).drop("_text")
    found = template_matches(df, templates, threshold)
    out = each.join(found, "_id", "left")
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


_PHRASES = ", ".join(f"({p.split()}, '{label}')" for p, label in BASE.items())
_TEMPLATES = ", ".join(f"({tokens_of(t)}, '{label}')" for t, label in TEMPLATES.items())
ORACLE = f"""
WITH phrases AS (SELECT * FROM (VALUES {_PHRASES}) AS t(p, label)), templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(ws, label)),
docs AS (SELECT doc_id, coalesce(text, '') AS text, {_sql_words("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda k: w[k + 1] = p[1] AND w[k + 1:k + len(p)] = p)) AS pos FROM docs, phrases),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY 1),
worded AS (SELECT doc_id, {_sql_words('line')} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
lines AS (SELECT doc_id, list_distinct(list_transform(range(1, len(lw)), lambda i: lw[i] || ' ' || lw[i + 1])) AS s FROM worded),
hits AS (SELECT doc_id, label, len(list_intersect(s, ws)) / len(ws)::DOUBLE AS share FROM lines, templates),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM hits WHERE share >= {THRESHOLD} - 1e-9 GROUP BY 1)
SELECT docs.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN base ON base.doc_id = docs.doc_id LEFT JOIN found ON found.doc_id = docs.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
