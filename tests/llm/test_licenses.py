import re

from pathgrade.llm import licenses

TEXTS = [
    "Released under the MIT License.",
    "released\nunder--the mit x license, cc by; CC-BY ccby Cc By",
    "This work is licensed under the GNU General Public License, version 3. gnu general public license",
    "gnu general public, license apache? license",
    "gnu gnu general public licence",
    "maK mit licenſe MİT license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of THIS nice software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense and or sell copies of the software",
    "cc by " * 500,
    "", None, "mit", " . ",
]


def base(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits, names = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        hits += at
        names |= {label} if at else set()
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(names))


def test_base_places_and_labels(spark, edges):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(TEXTS)], "doc_id long, text string, label string, w string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit-notice" in rows[0].labels and "gpl-3.0" in rows[2].labels and "mit-text" in rows[6].labels and rows[9].labels == ""
    assert licenses.scan(edges).count() == edges.count() and licenses.scan(edges.where("false")).count() == 0


def test_versions_are_told_apart(spark):
    texts = {
        "licensed under the GNU General Public License version 3": {"gpl", "gpl-3.0"},
        "licensed under the GNU General Public License (GPL), version 3": {"gpl", "gpl-3.0"},
        "licensed under the GNU General Public License version 2": {"gpl", "gpl-2.0"},
        "you may copy it under the terms of the GNU General Public License": {"gpl"},
        "licensed under the GNU Lesser General Public License version 3": set(),
        "licensed under CC BY-NC 4.0": {"cc-by", "cc-by-nc"},
        "licensed under CC BY-NC-ND 4.0": {"cc-by"},
        "licensed under CC BY-NC-SA 4.0": {"cc-by"},
        "licensed under CC BY-SA 4.0": {"cc-by", "cc-by-sa"},
        "Licensed under the Apache License, Version 2.0": {"apache", "apache-2.0"},
        "Licensed under the Apache License, Version 2.1": {"apache"},
        "Licensed under the Apache License, version 1.1 or 2 0": {"apache"},
        "SPDX-License-Identifier: Apache-2.0": {"apache-2.0"},
        "SPDX-License-Identifier: GPL-2.0-only": {"gpl-2.0"},
        "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3.0-or-later"},
        "// SPDX-License-Identifier: MIT": {"mit-notice"},
        "under the GPL v3": {"gpl-3.0"},
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(docs).collect()}
    assert {t: got[k] for k, t in enumerate(texts)} == texts


def test_whole_notices(spark):
    """The usual wording of notices, and wording that denies them."""
    free = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are {}permitted provided that the following conditions are met:"
    texts = {
        free.format("program", "") + "; either version 2 of the License, or (at your option) any later version.": {"gpl", "gpl-text", "gpl-2.0-or-later"},
        free.format("program", "") + ", either version 3 of the License, or (at your option) any later version.": {"gpl", "gpl-text", "gpl-3.0", "gpl-3.0-or-later"},
        free.format("program", "") + "; version 2.": {"gpl", "gpl-text"},
        free.format("library", "Lesser ") + "; either version 2.1 of the License, or (at your option) any later version.": {"lgpl-text"},
        free.format("program", "Affero ") + ", either version 3 of the License, or (at your option) any later version.": {"agpl-text"},
        bsd.format(""): {"bsd-text"},
        bsd.format("NOT "): set(),
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND": {"apache-text"},
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": {"isc-text"},
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is never granted, provided that the above copyright notice and this permission notice appear in all copies.": set(),
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software": {"unlicense"},
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(docs).collect()}
    assert {t: got[k] for k, t in enumerate(texts)} == texts


def test_repeated_and_shuffled_words_are_no_notice(spark):
    texts = [
        "licensed under " * 5,
        "licensed under " * 8,
        "released under the " * 4,
        "of the software " * 20,
        "licensed under apples licensed under pears licensed under the plums the gnu in general",
        "software is furnished to do so subject to persons to whom the and to permit copies of the publish distribute merge without limitation any person obtaining",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.labels for r in licenses.scan(docs).collect()} == {""}


def test_words_inserted_and_lost(spark):
    notice = dict((label, words) for words, label, _ in licenses.NOTICES)["bsd-text"].split()
    near = [*notice[:5], "both", *notice[5:9], *notice[10:15], "very", "much", *notice[15:]]
    far = [*notice[:11], *["other"] * 12, *notice[11:]]
    rows = [(0, " ".join(near)), (1, " ".join(["x"] * 997 + near)), (2, " ".join(far[::-1])), (3, "licensed under CC BY NC 4 0 " * 3000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "bsd-text" in got[0].labels and "bsd-text" in got[1].labels and got[2].labels == "" and got[3].labels == "cc-by,cc-by-nc" and got[3].n_base == 3000
