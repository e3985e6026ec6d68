"""Licence scans: headers and licence files against templates, then inheritance by directory.

A text is its lower-case words; line ends, comment marks and punctuation fall away, so a notice
is the same within a sentence, wrapped over several lines or in a comment, and both spellings of
"licence" are one word.  Templates are sparse TF-IDF vectors.  Wherever a weighty word of a template
stands in a text, the window of the template's length in which that word has its place is
compared with it; a file's licence is the template with the largest cosine, if that reaches
``LEAST``.  A window must have the template's version numbers and none of the words that tell other
licences of like wording apart.  A file without a licence of its own inherits that of the licence file in its nearest
ancestor directory, found by joins on paths.

DataFrame functions only; texts are cut into windows where they are read, and only windows at a
weighty word are shuffled.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.common import settle

#: Names of licences by SPDX identifier, fixed values; a mention is one of ``MENTIONS`` with a name in it.
NAMES = {
    "MIT": ["mit license"],
    "ISC": ["isc license"],
    "Apache-1.1": ["apache license version 1 1", "apache software license version 1 1"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0"],
    "GPL-3.0": ["gnu general public license version 3"],
    "GPL-2.0": ["gnu general public license version 2"],
    "AGPL-3.0": ["gnu affero general public license version 3"],
    "LGPL-3.0": ["gnu lesser general public license version 3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1"],
    "LGPL-2.0": ["gnu library general public license version 2"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license"],
    "MPL-1.1": ["mozilla public license version 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0"],
    "EPL-1.0": ["eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license 2 0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "CC0-1.0": ["cc0 1 0"],
}
MENTIONS = ("licensed under the {}", "released under the {}")
#: Notices by SPDX identifier, fixed values: opening, whole or telling parts of licences and of the headers they ask for.
NOTICES = {
    "MIT": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "Apache-1.1": ["the apache software license version 1 1 copyright c 2000 the apache software foundation all rights reserved"],
    "Apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution",
    ],
    "GPL-3.0": [
        "gnu general public license version 3 29 june 2007",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "GPL-2.0": [
        "gnu general public license version 2 june 1991",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "AGPL-3.0": ["gnu affero general public license version 3 19 november 2007", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"],
    "LGPL-3.0": ["gnu lesser general public license version 3 29 june 2007", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1 february 1999", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"],
    "LGPL-2.0": ["gnu library general public license version 2 june 1991", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license"],
    "BSD-2-Clause": ["must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties"],
    "BSD-3-Clause": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "MPL-1.1": ["the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"],
    "EPL-1.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"],
    "EPL-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "Zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international public license"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international public license"],
    "CC-BY-ND-4.0": ["creative commons attribution noderivatives 4 0 international public license"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international public license"],
    "CC-BY-NC-SA-4.0": ["creative commons attribution noncommercial sharealike 4 0 international public license"],
    "CC-BY-NC-ND-4.0": ["creative commons attribution noncommercial noderivatives 4 0 international public license"],
    "CC0-1.0": ["dedicated to the public domain under cc0 1 0", "cc0 1 0 universal"],
    "proprietary": ["all rights reserved", "unauthorized copying of this file via any medium is strictly prohibited", "proprietary and confidential"],
}
#: Words that tell licences of like wording apart, fixed values: a window that has one which its template lacks is of another licence.
TELLING = ("library", "lesser", "affero", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "wtfpl")


def templates() -> list[tuple[str, str]]:
    """(licence, words) of all templates: mentions of each name, its identifier, and notices."""
    found = []
    for name in dict.fromkeys([*NAMES, *NOTICES]):
        found += [(name, m.format(n)) for n in NAMES.get(name, []) for m in MENTIONS]
        if name in NAMES:
            found.append((name, "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")))
        found += [(name, n) for n in NOTICES.get(name, [])]
    return found


def needed(words: list[str]) -> list[str]:
    """The numbers of a template's version, which a window must have."""
    return sorted({w for w in words if w.isdigit() and 0 < int(w) < 10})


LEAST = 0.75
#: Frequent words of English prose and bare numbers, fixed values; they weigh least, as if in every template.
FREQUENT = set("a all an and any are as at be been by can do for from have in into is it its made make may no nor not of on or other out over part so such than that the their them these they this to under up use used was were which who will with you your 0 1 2 3 4".split())
#: A licence file's name.
FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|copyright)[^/]*$"
#: Of a key's rows, the share from which it is looked up by a broadcast; so at most this many keys.
HEAVY = 1000


@functools.cache
def vectors() -> tuple[list[dict], list[dict], float]:
    """The templates; the places of their weighty words; and the idf of a word that a template lacks.

    A word's idf is over the templates: ln((1 + n) / (1 + templates with it)) + 1, or 1 for a frequent
    word; a template's vector
    ``x`` has length one.  Weighty words of a template are so many, the heaviest first and frequent
    ones last, that the rest has less than ``LEAST`` of its length: a window without one of them
    can't reach that cosine.
    """
    texts = [(name, t.split()) for name, t in templates()]
    idf = {w: 1.0 if w in FREQUENT else math.log((1 + len(texts)) / (1 + sum(w in t for _, t in texts))) + 1 for _, t in texts for w in t}
    table, places = [], []
    for n, (name, words) in enumerate(texts):
        own = sorted(set(words), key=lambda w: (-words.count(w) * idf[w], w))
        norm = math.sqrt(sum((words.count(w) * idf[w]) ** 2 for w in own))
        x = [words.count(w) * idf[w] / norm for w in own]
        table.append({"license": name, "words": own, "idf": [idf[w] for w in own], "x": x, "length": len(words), "needs": needed(words), "bars": [w for w in TELLING if w not in words]})
        order = sorted(zip(own, x, strict=True), key=lambda o: o[0] in FREQUENT)
        weighty = [w for i, (w, _) in enumerate(order) if sum(v * v for _, v in order[i:]) >= LEAST**2]
        places += [{"word": w, "template": n, "at": i, "length": len(words)} for i, w in enumerate(words) if w in weighty]
    return table, places, math.log(1 + len(texts)) + 1


def words_of(text: Column) -> Column:
    """Lower-case words and numbers, "licence" as "license"."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "licence", "license"), F.lit("[a-z0-9]+"), F.lit(0))


def cosine(window: Column, unknown: float) -> Column:
    """Of a window's TF-IDF vector and the template in columns words, idf and x; words that the
    template lacks have the idf ``unknown``, or 1 if frequent.
    """
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    n = F.transform("words", lambda w: F.size(F.filter(window, lambda v: v == w)))
    mine = F.zip_with(n, F.col("idf"), lambda k, i: k * i)
    others = F.array_except(window, F.col("words"))
    far = total(F.transform(others, lambda w: F.pow(F.size(F.filter(window, lambda v: v == w)) * F.when(w.isin(*sorted(FREQUENT)), 1.0).otherwise(unknown), F.lit(2.0))))
    dot = total(F.zip_with(mine, F.col("x"), lambda a, b: a * b))
    return F.round(F.coalesce(F.try_divide(dot, F.sqrt(total(F.transform(mine, lambda a: a * a)) + far)), F.lit(0.0)), 6)


def own_licenses(files: DataFrame) -> DataFrame:
    """row, license and score of the files with a window near a template: the nearest one.

    Windows are compared in the task that reads the text; only the near ones are shuffled.
    """
    table, places, unknown = vectors()
    spark = files.sparkSession
    spots = spark.createDataFrame([(p["word"], p["template"], p["at"], p["length"]) for p in places], "word string, template int, at int, length int")
    known = spark.createDataFrame([(n, t["license"], t["words"], t["idf"], t["x"], t["needs"], t["bars"]) for n, t in enumerate(table)], "template int, license string, words array<string>, idf array<double>, x array<double>, needs array<string>, bars array<string>")
    weighty = sorted({p["word"] for p in places})
    hits = files.select("row", words_of(F.col("text")).alias("_words")).select("row", "_words", F.posexplode("_words").alias("i", "word")).where(F.col("word").isin(weighty))
    start = F.col("i") - F.col("at")
    first = F.greatest(start, F.lit(0))
    window = F.slice("_words", first + 1, F.greatest(start + F.col("length") - first, F.lit(0)))
    windows = hits.join(F.broadcast(spots), "word").select("row", "template", window.alias("window"))
    own = (F.size(F.array_except("needs", "window")) == 0) & ~F.arrays_overlap("bars", "window")
    scored = windows.join(F.broadcast(known), "template").where(own).withColumn("score", cosine(F.col("window"), unknown)).where(F.col("score") >= LEAST)
    best = F.max(F.struct("score", (-F.col("template")).alias("order"), "license"))
    return scored.groupBy("row").agg(best.alias("best")).select("row", "best.license", "best.score")


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with ``table``, whose ``key`` is unique.

    Keys of more than one in ``HEAVY`` of the rows, fewer than ``HEAVY`` whatever the input, are
    broadcast; the others are shuffled.
    """
    most = rows.count() / HEAVY
    heavy = settle(rows.groupBy(key).count().where(F.col("count") > most).select(key))
    split = lambda df, kind: df.join(F.broadcast(heavy), key, kind)
    near = split(rows, "left_semi").join(F.broadcast(split(table, "left_semi")), key, how)
    return near.unionByName(split(rows, "left_anti").join(split(table, "left_anti"), key, how))


def folder(path: Column) -> Column:
    """The directory of a path; the empty string at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def license_scan(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path, own_license, own_score,
    license, license_from.

    ``own_license`` comes from the file's own words, all of them (null: no window is near a template;
    ties go to the template listed first).  ``license`` is that, or else what the nearest ancestor
    directory's licence file says, whose directory ``license_from`` names.  Of several licence files
    in a directory the best score counts, then the least name.  Null and empty texts have no words; a
    file with a null path inherits nothing; repeated rows give repeated results.  Other columns are
    not looked at.
    """
    rows = files.select("doc_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    # equal rows have equal keys and results; a null text is like an empty one
    whole = F.concat_ws("\0", F.to_json(F.struct("doc_id", "path")), "text")
    rows = rows.withColumn("row", F.sha2(whole.cast("binary"), 256))
    own = settle(own_licenses(rows.select("row", "text").where("text is not null")))
    found = settle(rows.select("doc_id", "path", "row", folder(F.col("path")).alias("dir")).join(own, "row", "left").drop("row"))
    named = found.where(F.col("path").rlike(FILE) & F.col("license").isNotNull())
    holders = named.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("order"), "path", "license")).alias("best")).select(F.col("dir").alias("up"), F.col("best.license").alias("inherited"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    above = settle(found.where("dir is not null").select("dir").distinct().withColumn("up", F.explode(F.array_distinct(ups))))
    nearest = looked_up(above, settle(holders), "up", "inner").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "inherited")).alias("best"))
    nearest = settle(nearest.select("dir", F.col("best.up").alias("up"), F.col("best.inherited").alias("inherited")))
    joined = looked_up(found, nearest, "dir", "left")
    return joined.select("doc_id", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.coalesce("license", "inherited").alias("license"), F.when(F.col("license").isNull(), F.col("up")).alias("license_from"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` have no paths; the query lays them out as ``source/<thousand>/<hundred>/``
    with the first of every hundred as the directory's licence file.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))
