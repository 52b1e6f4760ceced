"""Licence scan: word-bigram Dice similarity to templates (DataFrame functions only).

Every line and every run of lines between blank lines is normalised and
compared with licence templates by the Dice coefficient of their sets of
word bigrams. A coefficient of at least 0.8 bounds the ratio of the two set
sizes, so a text is compared only with templates of about its size; the
templates are a fixed, small table and are broadcast.

Defined results: null and empty texts have no licence; ids may be null or
repeated (one result row per input row); an empty table gives an empty
result; texts of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, packed

SIMILARITY = 0.8

# Short notices and standard headers of common licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]


def normal_words(text: str) -> list[str]:
    """Lower-case runs of letters and digits (the same rule in Python, for the templates)."""
    return re.findall(r"[^\W_]+", text.lower())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def template_bigrams(spark, templates=TEMPLATES) -> DataFrame:
    """(template, licence, size, bigram): one row per distinct bigram of a template."""
    rows = []
    for k, (name, text) in enumerate(templates):
        w = normal_words(text)
        pairs = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        rows += [f"({k}, '{name}', {len(pairs)}, '{p}')" for p in pairs]  # letters, digits and spaces only
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, licence, size, bigram)")


def units(docs: DataFrame, text_col: str) -> DataFrame:
    """(_a, _b, unit, w): words of every line and of every run of lines between blank lines of each text."""
    df = packed(docs.select(text_col), text_col).select(F.coalesce("_0", F.lit("")).alias("_t"))
    blocks = F.split("_t", r"\n[\x20\x09-\x0D]*\n", -1)
    parts = F.array_union(F.split("_t", "\n", -1), blocks)
    df = df.select(*_digest("_t"), F.explode(parts).alias("unit"))
    return once(df, ["_a", "_b", "unit"], w=_words(F.col("unit")))


def _digest(text: str | Column) -> list[Column]:
    return [F.xxhash64(text).alias("_a"), F.xxhash64(F.lit("licence"), text).alias("_b")]


def matches(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY,
            templates=TEMPLATES) -> DataFrame:
    """(_a, _b, licence, dice): the best coefficient of each licence in each text, at least ``similarity``."""
    known = template_bigrams(docs.sparkSession, templates)
    sizes = known.agg(F.min("size"), F.max("size")).first()
    ratio = similarity / (2 - similarity)  # of the smaller set to the larger, at least
    df = units(docs, text_col).filter(F.size("w") >= 2)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(
        " ", F.get("w", i), F.get("w", i + 1))))
    df = once(df, ["_a", "_b", F.xxhash64("unit").alias("_u")], g=pairs)
    df = df.filter(F.size("g").between(sizes[0] * ratio, sizes[1] / ratio))
    df = df.select("_a", "_b", "_u", F.size("g").alias("n"), F.explode("g").alias("bigram"))
    df = df.join(F.broadcast(known), "bigram")
    df = df.filter((F.least("n", "size") >= ratio * F.greatest("n", "size")))
    # copies of a text repeat its bigrams: distinct ones are counted
    dice = 2 * F.count_distinct("bigram") / (F.first("n") + F.first("size"))
    df = df.groupBy("_a", "_b", "_u", "template", "licence").agg(dice.alias("dice")).filter(F.col("dice") >= similarity)
    return df.groupBy("_a", "_b", "licence").agg(F.max("dice").alias("dice"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, licences (sorted) and the best coefficient of each document; no licence: empty and 0."""
    found = matches(docs, text_col, **options).groupBy("_a", "_b").agg(
        F.sort_array(F.collect_list("licence")).alias("licences"), F.max("dice").alias("dice"))
    df = packed(docs.select(id_col, text_col), id_col, text_col)
    df = df.select("_0", *_digest(F.coalesce("_1", F.lit("")))).join(found, ["_a", "_b"], "left")
    return df.select(F.col("_0").alias(id_col), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
                     F.coalesce("dice", F.lit(0.0)).alias("dice"))
