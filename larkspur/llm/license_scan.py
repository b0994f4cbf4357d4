"""License scans: MinHash bands over overlapping text windows, then exact containment.

Words are runs of letters and digits in lower case, shingles are two words, a
window is four shingles and windows start at every second one. So a notice of
three words or more has at least two of its shingles in one window, and a
ratio of 1/2 or more with one of the template's own windows, which start at
every shingle. With BANDS bands of one hash each a window is retrieved with a
probability of 1 - (1/2)**12, 99.98 %, or more; longer notices hold windows
that equal one of the template's and are certain. The bands of templates of
TEMPLATE_BYTES at most are broadcast, and no text is shuffled. Windows that
hold two shingles of their template stay; only their documents are read again,
and the template's shingles around the window are counted.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import keep_rows_of, staged

BANDS = 12
WINDOW = 4  # shingles
CONTAINMENT = 0.8
TEMPLATE_BYTES = 1 << 20  # of templates that are broadcast; beyond it the same joins are shuffled

#: Usual notices of licenses.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("all-rights-reserved", "All rights reserved."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("gpl-3.0", "GPLv3 or later"),
    ("gpl-2.0", "GPLv2 or later"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("artistic-2.0", "licensed under the Artistic License 2.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license_id string, text string")


def shingle_array(text: Column) -> tuple[Column, Column]:
    """Expressions for the words of a text, and for the shingle hashes of the column `words`."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    rest = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    hashes = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), rest, lambda a, b: F.xxhash64(a, b))
    return words, hashes


def shingled(df: DataFrame, *keep: str) -> DataFrame:
    """df's columns `keep` and `grams`, the shingle hashes of `text` in order; null and empty texts have none."""
    words, hashes = shingle_array(F.coalesce("text", F.lit("")))
    return df.select(*keep, words.alias("words")).select(*keep, hashes.alias("grams"))


def windows(grams: DataFrame, stride: int, *keep: str) -> DataFrame:
    """A row for each window and band: keep, the window's first shingle `at`, its shingles `own`, band and MinHash value."""
    starts = F.when(F.size("grams") > 0, F.sequence(F.lit(0), F.greatest(F.size("grams") - stride, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cells = F.transform(starts, lambda i: F.struct(i.alias("at"), *[F.get("grams", i + k).alias(f"g{k}") for k in range(WINDOW)]))
    # A row for each band keeps the generated code small enough to be compiled.
    rows = grams.select(*keep, F.inline(cells)).withColumn("band", F.explode(F.array(*[F.lit(b) for b in range(BANDS)])))
    least = F.least(*[F.when(F.col(f"g{k}").isNotNull(), F.xxhash64(f"g{k}", "band")) for k in range(WINDOW)])
    return rows.select(*keep, "at", F.array(*[f"g{k}" for k in range(WINDOW)]).alias("own"), "band", least.alias("value"))


def license_scan(docs: DataFrame, templates: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, containment, word): notices that documents hold.

    One row for each document and license of which a template's distinct
    shingles stand, to `threshold` or more, around one window; containment is
    the best such share and word the first word, from 0, of the earliest
    window that has it. templates(license_id, text) may give a license several
    texts; texts of fewer than two words match nothing. Null and empty texts
    hold nothing; no templates or no documents give no rows.
    Rows that share an id count as one document, a null id too. Other columns
    are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    templates = templates.where("license_id is not null and text is not null")
    small = (templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= TEMPLATE_BYTES
    dealt = F.broadcast if small else lambda table: table
    known = shingled(templates.withColumn("part", F.xxhash64("license_id", "text")).dropDuplicates(["part"]), "license_id", "part").where(F.size("grams") > 0)
    known = known.withColumn("distinct", F.array_distinct("grams"))
    known = known if small else staged(known, "templates")
    bands = dealt(windows(known, 1, "part").select("part", "band", "value").distinct())
    shape = dealt(known.select("part", "license_id", "distinct", F.size("grams").alias("length")))
    found = windows(shingled(docs, "doc_id"), 2, "doc_id").join(bands, ["band", "value"]).join(shape, "part")
    held = F.size(F.array_intersect("own", "distinct"))
    found = found.where(held >= F.least(F.lit(2), F.size("distinct"))).select("doc_id", "at", "part", "length").distinct()
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("part", "at", "length")).alias("list"))

    lists = staged(lists, "candidates")
    same = F.coalesce(F.col("doc_id"), F.lit(-1)).alias("key")
    texts = keep_rows_of(docs.withColumn("key", same), lists.select(same).distinct(), "key").drop("key")
    grams = shingled(texts, "doc_id")
    lists = lists.withColumnRenamed("doc_id", "id")
    grams = grams.join(lists, grams["doc_id"].eqNullSafe(lists["id"])).drop("id")
    begin = lambda c: F.greatest(c["at"] - c["length"], F.lit(0))
    around = F.transform("list", lambda c: F.struct(c["part"].alias("part"), c["at"].alias("at"), F.slice("grams", begin(c) + 1, 2 * c["length"] + WINDOW).alias("around")))
    near = grams.select("doc_id", F.inline(around)).join(shape, "part")
    share = F.size(F.array_intersect("around", "distinct")) / F.size("distinct")
    near = near.select("doc_id", "license_id", F.round(share, 6).alias("containment"), "at").where(F.col("containment") >= threshold)
    best = near.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("best"))
    return best.select("doc_id", "license_id", "best.containment", (-F.col("best.back")).cast("long").alias("word"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """The usual notices over all of documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), notices(spark))
