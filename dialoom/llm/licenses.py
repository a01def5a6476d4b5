"""License scans: which license notices a text carries, with DataFrame operations only.

A text is reduced to its runs of ASCII letters and digits, lower-cased; shingles are k words in a row. Notices are
sorted into classes by length; each class looks at overlapping windows, one and a half times the class's longest
notice wide and half of it apart, so every passage of a notice's length lies whole in some window. A window's
MinHash over the notices' shingles has BANDS bands of one row: a window that holds `least` of a notice's shingles
has Jaccard similarity of least / (4 - least) with it at least, so with 0.8 and 64 bands it is missed with a
probability below 1e-8, and far less usually, as shingles of no notice are left out on both sides. Candidates are
then verified by exact containment of the notice's shingles.

The notices are a parameter of bounded size; texts are never shuffled, only the places where a shingle of some
notice stands.

Defined results: a null or empty text has no notice; repeated rows are scanned each; notices shorter than k words
are an error; an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 64

#: Common notices in their public wording.
NOTICES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^A-Za-z0-9]+", " "))), " ")


def shingle(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(words[i + j] for j in range(k)))


def starts(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def templates(spark: SparkSession, notices: dict[str, str], k: int) -> list[tuple[str, list[int], int]]:
    """name, distinct shingles, and class (the power of two at or above the number of shingle places) of each notice."""
    df = spark.createDataFrame(list(notices.items()), "name string, text string")
    words = words_of(F.col("text"))
    rows = df.select("name", words.alias("w")).select("name", F.size("w").alias("n"), F.array_distinct(F.transform(starts(F.col("w"), k), lambda i: shingle(F.col("w"), i, k))).alias("h")).collect()
    short = [r["name"] for r in rows if r["n"] < k]
    if short:
        raise ValueError(f"shorter than {k} words: {short}")
    return [(r["name"], list(r["h"]), 1 << (r["n"] - k).bit_length()) for r in rows]


def scan(df: DataFrame, notices: dict[str, str] | None = None, k: int = 5, least: float = 0.8, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, matched (its shingles found in the best window), shingles (all it has) and first_word (place of the first in the best window) for each notice in each row."""
    spark = df.sparkSession
    known = templates(spark, notices or NOTICES, k)
    every = sorted({h for _, hs, _ in known for h in hs})
    classes = sorted({c for _, _, c in known})
    # the words are bound once, by the outer lambda; evaluated inline they would be split anew for each shingle
    found = F.transform(
        F.array(words_of(F.col(text_col))),
        lambda w: F.transform(F.filter(starts(w, k), lambda i: shingle(w, i, k).isin(every)), lambda i: F.struct(i.alias("at"), shingle(w, i, k).alias("h"))),
    )[0]
    # the outer form: for the inner one Spark would work out the array a second time, to filter empty ones
    hits = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), found.alias("hits")).select("row", "doc_id", F.explode_outer("hits").alias("x")).where("x is not null").select("row", "doc_id", "x.at", "x.h")

    def windows(c: int) -> Column:
        """The windows of class c over a place: c // 2 apart (1 at least), one and a half times c wide."""
        step = max(c // 2, 1)
        first = F.greatest(F.lit(0), F.floor((F.col("at") - (c + step - 1) + step) / step).cast("int"))
        return F.transform(F.sequence(first, F.floor(F.col("at") / step).cast("int")), lambda n: F.struct(F.lit(c).alias("c"), n.alias("n")))

    placed = hits.withColumn("w", F.explode(F.flatten(F.array(*map(windows, classes))))).select("row", "doc_id", "w.c", "w.n", "at", "h")
    mins = [F.min(F.xxhash64(F.lit(b), F.col("h"))).alias(f"m{b}") for b in range(bands)]
    sets = placed.groupBy("row", "c", "n").agg(F.first("doc_id").alias("doc_id"), F.collect_set("h").alias("hs"), F.min("at").alias("first_word"), *mins)
    look = spark.createDataFrame([(name, c, hs) for name, hs, c in known], "license string, t_c int, t_hs array<long>")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform("t_hs", lambda h: F.xxhash64(b, h))))
    look = look.select("license", "t_c", "t_hs", F.posexplode(keys).alias("t_b", "t_key"))
    banded = sets.select("row", "doc_id", "c", "n", "hs", "first_word", F.posexplode(F.array(*(F.col(f"m{b}") for b in range(bands)))).alias("b", "key"))
    # bounded by the notices given: bands rows each
    met = banded.join(F.broadcast(look), (F.col("c") == F.col("t_c")) & (F.col("b") == F.col("t_b")) & (F.col("key") == F.col("t_key")))
    checked = met.select("row", "doc_id", "license", F.size(F.array_intersect("hs", "t_hs")).cast("long").alias("matched"), F.size("t_hs").cast("long").alias("shingles"), F.col("first_word").cast("long").alias("first_word")).where(F.col("matched") >= least * F.col("shingles"))
    best = F.max(F.struct("matched", (-F.col("first_word")).alias("before"))).alias("best")
    return checked.groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), F.first("shingles").alias("shingles"), best).select("doc_id", "license", F.col("best.matched").alias("matched"), "shingles", (-F.col("best.before")).alias("first_word"))
