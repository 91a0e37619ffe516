"""Find license notices in documents with DataFrame functions only: MinHash bands over windows, then containment.

Words are runs of a-z and 0-9 of the lower-cased text, shingles three words that follow each other. For templates
of n words the text is cut into overlapping windows of n + stride - 1 words every stride = max(1, n / 4) words, so
an occurrence lies whole in some window, and a window with ``CONTAINED`` of a template's shingles is at least 0.6
similar to it. It must also hold the template's ``TELLING`` shingles, which tell it from licenses of like words.
``BANDS`` bands of ``ROWS`` MinHash values miss such a window with a probability of
(1 - 0.6 ** ROWS) ** BANDS, about 2e-5. Windows and templates of one length that share a band are candidates, and
stay if the window holds at least ``CONTAINED`` of the template's shingles, and no window within ``NEAR`` words holds
more of a template of that length (versions of a license differ in a word).

Equal bands mean equal least shingles, so a window without any shingle of a template has no band in common with
it; only windows over such a shingle get a signature. Templates are a fixed list, so what is broadcast is fixed.

Defined results: one row per id and license found, with its best window (the first of equals); a null or empty
text has none; rows that share an id are reported together; further columns do not matter.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SHINGLE, ROWS, BANDS, CONTAINED = 3, 2, 24, 0.8
#: Words between windows that are taken for the same notice.
NEAR = 16

#: Notices of common licenses, as words.
TEMPLATES = [
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license"),
    ("Apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-2.0", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("GPL-1.0", "gnu general public license as published by the free software foundation either version 1 of the license"),
    ("LGPL-2.0", "gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("LGPL-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("LGPL-3.0", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("AGPL-3.0", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-NC-SA-4.0", "licensed under cc by nc sa 4 0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1 0 universal"),
    ("All-Rights-Reserved", "all rights reserved"),
]

#: Shingles that a notice cannot do without, where it has them: family, kind and version.
TELLING = frozenset((
    "gnu general public", "gnu lesser general", "gnu library general", "gnu affero general", "either version 1", "version 1 of",
    "either version 2", "version 2 of", "version 2 1", "2 1 of", "either version 3", "version 3 of", "license version 2",
    "license version 3", "commons attribution 4", "attribution noncommercial 4", "attribution 4 0", "noncommercial 4 0", "license v 2",
))


def stride(n: int) -> int:
    return max(1, n // 4)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingle(at: Column, listed: Column) -> Column:
    """Hash of the shingle that begins at a position (from 0) of a list of words."""
    return F.xxhash64(*(F.get(listed, at + i) for i in range(SHINGLE)))


def positions(listed: Column) -> Column:
    """Positions of the shingles of a list of words."""
    size = F.size(listed)
    return F.when(size >= SHINGLE, F.sequence(F.lit(0), size - SHINGLE)).otherwise(F.array().cast("array<int>"))


def bands(shingles: Column) -> Column:
    """Keys of the bands of a set of shingles."""
    def least(number: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(number))))

    values = [least(number) for number in range(ROWS * BANDS)]
    return F.array(*(F.xxhash64(F.lit(b), *values[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)))


def templates(spark: SparkSession) -> DataFrame:
    """(number, license, n, shingles, telling, bands) of the templates; ``telling`` are shingles it cannot do without."""
    def telling(ws: list[str]) -> list[list[str]]:
        return [ws[i:i + SHINGLE] for i in range(len(ws) - SHINGLE + 1) if " ".join(ws[i:i + SHINGLE]) in TELLING]

    rows = [(i, name, len(text.split()), text, telling(text.split())) for i, (name, text) in enumerate(TEMPLATES)]
    listed = F.split("notice", " ")
    own = spark.createDataFrame(rows, "number int, license string, n int, notice string, telling array<array<string>>").select(
        "number", "license", "n", F.array_distinct(F.transform(positions(listed), lambda i: shingle(i, listed))).alias("shingles"),
        F.transform("telling", lambda ws: shingle(F.lit(0), ws)).alias("telling"))
    return own.withColumn("bands", bands(F.col("shingles")))


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, license, containment double, first_word long, n_windows long) of every license found."""
    known = templates(df.sparkSession)
    of: dict[int, set[int]] = {}
    for r in known.select("n", "shingles").collect():
        for h in r["shingles"]:
            of.setdefault(h, set()).add(r["n"])
    lengths = F.create_map(*(x for h, ns in sorted(of.items()) for x in (F.lit(h), F.array(*map(F.lit, sorted(ns))))))
    steps = F.create_map(*(x for n in sorted({n for ns in of.values() for n in ns}) for x in (F.lit(n), F.lit(stride(n)))))

    def found(ws: Column) -> Column:
        """The words, with the positions of template shingles."""
        return F.struct(ws.alias("words"), F.filter(positions(ws), lambda i: shingle(i, ws).isin(list(of))).alias("hits"))

    # words are bound by a lambda and rows chosen by explode, so that the optimizer cannot repeat the split
    text = F.array(words(F.col(text_column).cast("string")))
    some = F.filter(F.transform(text, found), lambda x: F.size(x["hits"]) > 0)
    # positions are those of one text: rows of one id (or of none) are told apart by what they hold
    own = F.xxhash64(F.col(text_column).cast("string")).alias("own")
    rows = df.select(F.col(id_column).alias("doc_id"), own, F.explode(some).alias("found")).select("doc_id", "own", "found.*")
    listed = F.col("words")

    def starts(hit: Column) -> Column:
        """Windows (n, start) that hold the shingle at a position."""
        def of_length(n: Column) -> Column:
            step = F.element_at(steps, n)
            least = F.greatest(F.lit(0), F.ceil((hit + SHINGLE + 1 - n - step) / step).cast("int"))
            return F.transform(F.sequence(least, F.floor(hit / step).cast("int")),
                               lambda j: F.struct(n.alias("n"), (j * step).alias("start")))
        return F.flatten(F.transform(F.element_at(lengths, shingle(hit, listed)), of_length))

    windows = rows.select("doc_id", "own", "words", F.explode(F.array_distinct(F.flatten(F.transform("hits", starts)))).alias("window"))
    cut = F.slice("words", F.col("window.start") + 1, F.col("window.n") + F.element_at(steps, F.col("window.n")) - 1)
    windows = windows.select("doc_id", "own", F.col("window.n").alias("n"), F.col("window.start").alias("start"), cut.alias("words"))
    windows = windows.withColumn("held", F.array_distinct(F.transform(positions(listed), lambda i: shingle(i, listed))))
    windows = windows.withColumn("keys", bands(F.col("held"))).drop("words")
    # as many rows as TEMPLATES
    met = windows.join(F.broadcast(known), "n").where(
        F.arrays_overlap("keys", "bands") & (F.size(F.array_except("telling", "held")) == 0))
    met = met.withColumn("containment", F.size(F.array_intersect("held", "shingles")) / F.size("shingles"))
    most = F.max("containment").over(Window.partitionBy("doc_id", "own", "n").orderBy("start").rangeBetween(-NEAR, NEAR))
    met = met.where(F.col("containment") >= CONTAINED).withColumn("most", most).where("containment = most")
    best = F.max(F.struct("containment", (-F.col("start")).alias("back")))
    return (met.groupBy("doc_id", "license")
            .agg(best.alias("best"), F.count_distinct("number", "start").alias("n_windows"))
            .select("doc_id", "license", F.col("best.containment").alias("containment"),
                    (-F.col("best.back")).cast("long").alias("first_word"), "n_windows"))
