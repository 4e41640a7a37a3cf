"""License scans by diagonal voting. DataFrame operations only.

Every pair of neighbouring words of a text is joined, by hash and then by the words themselves, to the places of the
same pair in the templates. A match votes for the diagonal (place in the text minus place in the template). A phrase of
m words stands at a place if its diagonal has all m - 1 votes: the pairs overlap, so that verifies the span word by word.
For whole notices, neighbouring diagonals are merged in bands, as inserted or lost words shift what follows; a band
counts once for each place of the template. Those that have enough places are verified: the longest chain of pairs that
stand in the template's order in the text must cover the notice's share. Pairs that tell a notice from another
license's (TELLING) must be among the band's votes; so a version that is named up to SHIFT words later counts.

A row for each document takes part too, so texts are read and cut into words once. Words are compared with A-Z in lower
case. Null texts count as empty. Repeated rows give a row each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and their labels, and the wording of public license notices.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NOTICES = (
    ("licensed under the gnu general public license version 3", "gpl-3.0", 0.6),
    ("licensed under the gnu general public license version 2", "gpl-2.0", 1.0),
    ("licensed under the apache license version 2 0", "apache-2.0", 0.8),
    ("licensed under cc by nc 4 0", "cc-by-nc", 0.8),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1.0),
    ("released under the mit license", "mit-notice", 0.8),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions",
        "mit-text",
        0.6,
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "bsd-text",
        0.6,
    ),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "apache-text",
        0.6,
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation",
        "gpl-text",
        0.6,
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at",
        "mpl-text",
        0.6,
    ),
    (
        "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gpl-2.0-or-later",
        0.8,
    ),
    (
        "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gpl-3.0-or-later",
        0.8,
    ),
    (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "lgpl-text",
        0.6,
    ),
    (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "agpl-text",
        0.6,
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied",
        "apache-text",
        0.6,
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        "bsd-3-clause",
        0.6,
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "isc-text",
        0.6,
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software",
        "unlicense",
        0.6,
    ),
    ("gpl v3", "gpl-3.0", 1.0),
    ("gpl v2", "gpl-2.0", 1.0),
    ("spdx license identifier mit", "mit-notice", 1.0),
    ("spdx license identifier apache 2 0", "apache-2.0", 1.0),
    ("spdx license identifier gpl 2 0 only", "gpl-2.0", 1.0),
    ("spdx license identifier gpl 3 0 only", "gpl-3.0", 1.0),
    ("spdx license identifier gpl 2 0 or later", "gpl-2.0-or-later", 1.0),
    ("spdx license identifier gpl 3 0 or later", "gpl-3.0-or-later", 1.0),
    ("spdx license identifier bsd 3 clause", "bsd-3-clause", 1.0),
)
#: By label, the pairs without which a notice is another version's or another license's, or denies what the license grants.
TELLING = {
    "gpl-3.0": ("gnu general", "version 3"),
    "gpl-2.0": ("gnu general", "version 2"),
    "apache-2.0": ("version 2", "2 0"),
    "cc-by-nc": ("nc 4",),
    "cc-by-sa": ("sa 4",),
    "bsd-text": ("are permitted",),
    "gpl-text": ("gnu general",),
    "gpl-2.0-or-later": ("gnu general", "version 2", "2 of", "later version"),
    "gpl-3.0-or-later": ("gnu general", "version 3", "3 of", "later version"),
    "lgpl-text": ("gnu lesser",),
    "agpl-text": ("gnu affero",),
    "isc-text": ("is hereby", "hereby granted"),
}
#: Words that may be inserted into a notice, or lost from it, in all.
SHIFT = 8
#: A mark that cannot be a word: a pair that stands for the document itself.
MARK = "/"


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, base, pairs, share, needs; place, ta, tb, bit for each pair of the template; template -1 is the document's mark.

    A telling pair has a bit, and needs has the bits of all of them.
    """
    rows = [(k, label, True, 1.0, words) for k, (words, label) in enumerate(phrases)]
    rows += [(len(phrases) + k, label, False, share, words) for k, (words, label, share) in enumerate(notices)]
    values = ", ".join(f"({k}, '{label}', {str(base).lower()}, {share}D, '{words}')" for k, label, base, share, words in rows)
    t = spark.sql(f"SELECT template, label, base, share, split(words, ' ') AS w FROM VALUES {values} AS t(template, label, base, share, words)")
    t = t.withColumn("pairs", F.size("w") - 1).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("pairs") - 1)))
    t = t.select("template", "label", "base", "share", "pairs", "place", F.col("w")[F.col("place")].alias("ta"), F.col("w")[F.col("place") + 1].alias("tb"))
    mark = spark.sql(f"SELECT -1 AS template, '' AS label, false AS base, 1D AS share, 0 AS pairs, 0 AS place, '{MARK}' AS ta, '{MARK}' AS tb")
    t = t.unionByName(mark)
    bit, needs = F.lit(0), F.lit(0)
    for label, telling in TELLING.items():
        own = ~F.col("base") & (F.col("label") == label)
        needs = F.when(own, (1 << len(telling)) - 1).otherwise(needs)
        for k, pair in enumerate(telling):
            bit = F.when(own & (F.concat_ws(" ", "ta", "tb") == pair), 1 << k).otherwise(bit)
    # of the pairs that the template has: a notice of other words under the same label needs what it has of them
    t = t.withColumn("bit", bit.cast("int")).withColumn("needs", needs.cast("int"))
    return t.withColumn("needs", F.col("needs").bitwiseAND(F.bit_or("bit").over(Window.partitionBy("template"))))


def _longest_chain() -> Column:
    """The most points (pos, -place, in order) of a band that go up in both text and template: the words that stand in order.

    ``tails[k]`` is the smallest place at which a chain of k + 1 points ends. Points of one position come with their
    places falling, so a chain has one of them at most.
    """
    ends = lambda tails, place: F.size(F.filter(tails, lambda t: t < place))

    def step(tails: Column, point: Column) -> Column:
        place = -point["back"]
        k = ends(tails, place)
        return F.concat(F.slice(tails, F.lit(1), k), F.array(place), F.slice(tails, k + 2, F.greatest(F.lit(0), F.size(tails) - k - 1)))

    return F.size(F.aggregate("points", F.array().cast("array<int>"), step))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, shift: int = SHIFT) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    # the Kelvin sign is the one sign outside A-Z whose lower case is a letter of a-z
    lower = F.lower(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("K"), F.lit("é")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    pairs = F.expr(
        f"concat(array(named_struct('a', '{MARK}', 'b', '{MARK}')), "
        "if(n_words < 2, cast(array() as array<struct<a:string,b:string>>), zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> named_struct('a', a, 'b', b))))"
    )
    long = rows.select("row", "doc_id", "n_words", F.posexplode(pairs).alias("pos", "z")).select("row", "doc_id", "n_words", "pos", "z.a", "z.b")
    known = templates(spark, phrases, notices)  # as many rows as the templates have words
    known = known.withColumn("hash", F.xxhash64("ta", "tb"))
    hits = long.join(F.broadcast(known), (F.xxhash64("a", "b") == F.col("hash")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
    # a base phrase stands on one diagonal. A notice's diagonals are merged in bands of 2 * shift neighbours, which
    # overlap by half: whatever is inserted or lost, up to ``shift`` words, some band has all of it. A band has at most
    # 2 * shift diagonals of a template's pairs, however long the text is.
    diagonal = (F.col("pos") - 1 - F.col("place")).cast("long")
    half = F.floor(diagonal / shift)
    bands = F.when(F.col("base") | (F.col("template") < 0), F.array(diagonal)).otherwise(F.array(half - 1, half))
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "share", "pairs", "needs"]
    votes = hits.select(*keys, "pos", "place", "bit", F.explode(bands).alias("band"))
    votes = votes.groupBy(*keys, "band").agg(
        F.array_sort(F.collect_list(F.struct("pos", (-F.col("place")).alias("back")))).alias("points"), F.bit_or("bit").alias("bits"), (F.min("pos") - 1).alias("start"), F.max("pos").alias("last")
    )
    places = F.size(F.array_distinct(F.transform("points", lambda p: p["back"])))
    share_of = lambda n: n / F.greatest(F.col("pairs"), F.lit(1))
    full = F.col("base") & (places == F.col("pairs"))
    may = ~F.col("base") & (F.col("template") >= 0) & (share_of(places) >= F.col("share")) & (F.col("bits") == F.col("needs"))
    votes = votes.withColumn("places", places).withColumn("may", may).withColumn("chain", F.when(may, _longest_chain()).otherwise(0))
    covered = F.when(F.col("may"), share_of(F.col("chain"))).otherwise(share_of(F.col("places")))
    bands = votes.withColumn("covered", covered).withColumn("full", full).withColumn("noticed", F.col("may") & (F.col("covered") >= F.col("share")))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  a few labels at most
    out = bands.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.col("full").cast("long")).alias("n_base"),
        F.min(F.when(F.col("full"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("full"), F.col("start"))).cast("long").alias("last_word"),
        text(F.when(F.col("full"), F.col("label"))).alias("base_labels"),
        text(F.when(F.col("full") | F.col("noticed"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.when(F.col("full") | F.col("noticed"), F.col("covered")).otherwise(F.col("covered") / 4))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
