"""License scans by a positional index of rare tokens, in DataFrame functions only.

Templates are notices and whole licence texts, each with a mandatory key phrase; the index holds for each
template the places of its key phrase's rarest words, which document frequencies over the whole corpus
rank. A file that holds a template's rarest word has all its rare words looked up: a posting at place p
of a word that stands at place i of the file puts the template at i - p. Where all postings of a template
put it at one place, the key phrase is compared word by word, and so are the words around it.
Everything happens within a row: nothing but the few counts of licence words is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.llm.textkit import keyed_texts

#: Base labels and their phrases.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: The method's own templates: label and notice; ``[`` and ``]`` enclose the mandatory key phrase.
TEMPLATES = [
    ("apache-2", "licensed under the [apache license version 2 0]"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www [apache org licenses license 2 0]"),
    ("mit", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the [above copyright notice and this permission notice shall be included] in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the"
        " [above copyright notice and this permission notice appear in all copies]"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " 2 [redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution",
    ),
    ("mit", "released under the [mit license]"),
    ("cc-by-nc", "licensed under [cc by nc 4 0]"),
    ("cc-by-nc", "creative commons [attribution noncommercial]"),
    ("cc-by-sa", "creative commons [attribution sharealike]"),
    ("cc-by-4", "creative commons [attribution 4 0 international]"),
    ("gpl", "this work is licensed under the [gnu general public license]"),
    ("lgpl", "under the terms of the [gnu lesser general public license]"),
    ("agpl", "under the terms of the [gnu affero general public license]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
    ("gpl-2", "under the terms of the [gnu general public license as published by the free software foundation either version 2] of the license or at your option any later version"),
    ("gpl-3", "under the terms of the [gnu general public license as published by the free software foundation either version 3] of the license or at your option any later version"),
    ("lgpl-2.1", "under the terms of the [gnu lesser general public license as published by the free software foundation either version 2 1] of the license or at your option any later version"),
    ("lgpl-3", "under the terms of the [gnu lesser general public license as published by the free software foundation either version 3] of the license or at your option any later version"),
    ("agpl-3", "under the terms of the [gnu affero general public license as published by the free software foundation either version 3] of the license or at your option any later version"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the [eclipse public license 2 0] which is available at"),
    ("bsl-1", "distributed under the [boost software license version 1 0]"),
    ("artistic-2", "licensed under the [artistic license 2 0]"),
    ("zlib", "this software is provided as is without any express or implied warranty [in no event will the authors be held liable] for any damages arising from the use of this software"),
    ("cc-by-nd", "creative commons [attribution noderivatives]"),
    ("cc-by-nc-sa", "creative commons [attribution noncommercial sharealike]"),
    ("cc0", "[cc0 1 0 universal]"),
]
#: Labels and the words of their SPDX identifiers, each a template of its own.
SPDX = {
    "mit": "mit", "apache-2": "apache 2 0", "bsd-2": "bsd 2 clause", "bsd-3": "bsd 3 clause", "isc": "isc", "mpl-2": "mpl 2 0", "gpl-2": "gpl 2 0", "gpl-3": "gpl 3 0", "lgpl-2.1": "lgpl 2 1",
    "lgpl-3": "lgpl 3 0", "agpl-3": "agpl 3 0", "epl-2": "epl 2 0", "bsl-1": "bsl 1 0", "unlicense": "unlicense", "cc0": "cc0 1 0", "cc-by-4": "cc by 4 0", "cc-by-sa": "cc by sa 4 0", "cc-by-nc": "cc by nc 4 0", "zlib": "zlib",
}
TEMPLATES += [(label, f"[spdx license identifier {words}]") for label, words in SPDX.items()]
#: Words of a key phrase that are looked up, those that fewest files hold.
RARE = 3
#: What parts words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z (A-Z in lower case) and non-ASCII characters."""
    parts = F.split(F.translate(text, UPPER, LOWER), BETWEEN)
    return F.array_remove(parts, "")


def _spelled(notice: str) -> tuple[list[str], int, list[str]]:
    """(words of a notice, place of its key phrase, words of the key phrase)."""
    before, key, _ = notice.replace("]", "[").split("[")
    return notice.replace("[", "").replace("]", "").split(), len(before.split()), key.split()


def document_frequencies(words: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows each of the wanted words stands, over the whole table; ``words`` has an array ``words``."""
    hits = words.select(F.explode(F.array_intersect("words", F.array(*(F.lit(w) for w in wanted)))).alias("word"))
    return {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places for every row.

    ``n_base``: places where a base phrase's words stand consecutively; ``first_word`` and
    ``last_word``: their smallest and largest start, null if there is none. ``labels``: base labels and
    those whose key phrase stands where a notice puts it. ``score``: the largest share of a notice's
    words that stand at their places, 1 if there is a base place, 0 without labels. ``places``: label
    and start of each notice or phrase found. Null text is empty; repeated rows and null ids stay.
    """
    phrases = [(label, phrase.split()) for label, phrase in BASE.items()]
    notices = [(label, *_spelled(notice)) for label, notice in TEMPLATES]
    # a template's postings all stand in its key phrase, which must be there word by word
    keys = [(label, ws, 0, ws) for label, ws in phrases] + [(label, key, at, ws) for label, ws, at, key in notices]
    words = keyed_texts(docs, id_col, text_col).select("doc_id", word_array(F.col("text")).alias("words"))
    df = document_frequencies(words, sorted({w for _, key, _, _ in keys for w in key}))
    # postings of each template: places in its key phrase of the words that fewest files hold, rarest first
    postings = [sorted(range(len(key)), key=lambda i: (df.get(key[i], 0), key[i], i))[:RARE] for _, key, _, _ in keys]
    array = lambda ws: F.array(*(F.lit(w) for w in sorted(ws)))
    rare = array({key[i] for (_, key, _, _), own in zip(keys, postings, strict=True) for i in own})
    rarest = array({key[own[0]] for (_, key, _, _), own in zip(keys, postings, strict=True)})

    def places_of(key: list[str], own: list[int]) -> Column:
        """Starts of a key phrase: where all its postings put it, compared word by word."""

        def put(at: int) -> Column:
            return F.transform(F.filter("hits", lambda h: h["word"] == key[at]), lambda h: h["place"] - F.lit(at))

        meet = reduce(F.array_intersect, map(put, own))
        return F.filter(meet, lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, F.lit(len(key))) == F.array(*(F.lit(w) for w in key))))

    def notices_found(starts: Column, number: int) -> Column:
        """(label, start, share of the notice's words at their places) at each start of its key phrase."""
        label, key, offset, whole = keys[number]

        def one(s: Column) -> Column:
            begin = s - F.lit(offset)
            there = F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.least(F.lit(len(whole)), F.lit(len(whole)) + begin))
            # a notice that would begin before the text is compared from the text's start
            cut = F.slice(F.array(*(F.lit(w) for w in whole)), F.greatest(-begin, F.lit(0)) + 1, F.lit(len(whole)))
            same = F.aggregate(F.arrays_zip(there.alias("x"), cut.alias("y")), F.lit(0), lambda n, z: n + F.coalesce((z["x"] == z["y"]).cast("int"), F.lit(0)))
            return F.struct(F.lit(label).alias("label"), F.greatest(begin, F.lit(0)).cast("long").alias("start"), (same / F.lit(float(len(whole)))).alias("share"))

        return F.transform(starts, one)

    n_base = len(phrases)
    hit_rows = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(rare, w), F.struct(w.alias("word"), i.alias("place")))), lambda h: h.isNotNull())
    none = F.lit(None)
    looked = words.select("doc_id", "words", F.when(F.arrays_overlap("words", rarest), hit_rows).alias("hits"))
    starts = [places_of(key, own) for (_, key, _, _), own in zip(keys, postings, strict=True)]
    found = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", *(F.when(F.col("hits").isNotNull(), s).alias(f"s{i}") for i, s in enumerate(starts)))
    base_starts = F.flatten(F.array(*(F.coalesce(f"s{i}", F.array().cast("array<int>")) for i in range(n_base))))
    own = F.flatten(F.array(*(F.coalesce(notices_found(F.col(f"s{i}"), i), F.array().cast("array<struct<label:string,start:bigint,share:double>>")) for i in range(len(keys)))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"s{i}") > 0, F.lit(keys[i][0])) for i in range(n_base))))
    told = found.select("doc_id", "n_words", base_starts.alias("base"), F.when(F.col("s0").isNotNull(), own).alias("places"), base_labels.alias("base_labels"))
    labels = F.array_union(F.col("base_labels"), F.transform(F.coalesce("places", F.array().cast("array<struct<label:string,start:bigint,share:double>>")), lambda p: p["label"]))
    return told.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.when(F.size("base") > 0, F.array_min("base")).otherwise(none).cast("long").alias("first_word"),
        F.when(F.size("base") > 0, F.array_max("base")).otherwise(none).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))).alias("score"),
        "places",
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def sql() -> str:
    """The same in DuckDB: notices are tried at every place of their key phrase."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    keys = [(label, phrase.split(), 0, phrase.split(), 1) for label, phrase in BASE.items()]
    keys += [(label, key, at, ws, 0) for label, (ws, at, key) in ((label, _spelled(notice)) for label, notice in TEMPLATES)]
    rows = ",\n    ".join(f"('{label}', {quoted(key)}, {at}, {quoted(ws)}, {base})" for label, key, at, ws, base in keys)
    return rf"""
WITH keys(label, key, place, notice, base) AS (VALUES
    {rows}
), told AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '') AS words,
    row_number() OVER () AS row
  FROM documents
), tried AS (
  SELECT row, words, label, key, place, notice, base, unnest(list_filter(range(len(words)), lambda i: words[i + 1] = key[1])) AS i
  FROM told CROSS JOIN keys WHERE list_contains(words, key[1])
), found AS (
  SELECT row, label, base, i, i - place AS start,
    len(list_filter(range(len(notice)), lambda j: i - place + j >= 0 AND words[i - place + j + 1] = notice[j + 1])) / len(notice)::DOUBLE AS share
  FROM tried WHERE list_slice(words, i + 1, i + len(key)) = key
), each AS (
  SELECT row, count(*) FILTER (base = 1) AS n_base, min(i) FILTER (base = 1) AS first_word, max(i) FILTER (base = 1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM found GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM told LEFT JOIN each ON each.row = told.row
"""
