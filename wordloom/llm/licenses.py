"""License scans in DataFrame functions: MinHash bands over text windows retrieve templates, containment verifies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
#: Share of a template's shingles that one window must hold, in percent.
PERCENT = 80
#: Bytes of band rows up to which templates are broadcast; beyond it they are joined by key.
BROADCAST_BYTES = 16 << 20
#: Bands of one row. A window of twice a template's width class, with PERCENT of the template in it,
#: has a similarity of 0.19 at least, so it misses all bands with probability 0.81 ** 64 < 2e-6.
BANDS = 64
#: License statements and notices as their publishers word them.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Fixed values too: more notices and lines, and of long licenses the passage that stands for their full text.
MORE = {
    "agpl-3.0-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "apache-2.0-text": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "artistic-1.0": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.",
    "bsd-3-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-text": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gfdl-text": "The purpose of this License is to make a manual, textbook, or other functional and useful document \"free\" in the sense of freedom: to assure everyone the effective freedom to copy and redistribute it, with or without modifying it, either commercially or noncommercially.",
    "gpl-1.0-text": "The license agreements of most software companies try to keep users at the mercy of those companies. By contrast, our General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-2.0-text": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-3.0-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "lgpl-2-text": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "lgpl-2.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-2.1-text": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "lgpl-3.0-library-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mpl-1.1-text": "\"Contributor Version\" means the combination of the Original Code, prior Modifications used by a Contributor, and the Modifications made by that particular Contributor.",
    "mpl-2.0-text": "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
#: Between words: white space with what is not a letter, mark or digit around it, comment leaders too. It starts where such a run does, so it is linear.
BETWEEN = r"(?<![^\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}\x20\x09-\x0D]*+[\x20\x09-\x0D][^\p{L}\p{M}\p{N}]*+"


def _shingled(df: DataFrame) -> DataFrame:
    """Adds ``_s``, the hashes of the 5-word shingles of ``text`` in order; fewer words have none."""
    words = F.array_remove(F.split(F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" ")), BETWEEN), "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_h")
    at = lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(WORDS)))
    s = F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), at)).otherwise(F.array().cast("array<long>"))
    # through a generator, or filters would be pushed down with the whole expression, once for every element
    return df.select("*", F.explode(F.array(s)).alias("_s")).drop("_h")


def _keys(part: Column, width: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda k: F.xxhash64(width, k, F.array_min(F.transform(part, lambda x: F.xxhash64(x, k)))),
    )


def license_scan(docs: DataFrame, spark: SparkSession, templates: dict[str, str] = TEMPLATES | MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found: doc_id, license, n_shared, n_template (distinct shingles).

    A template of m shingles is of width class W, the least power of two from m on; windows of 2W
    shingles start every W, so an occurrence lies wholly in one. n_shared is the most that a window
    holds. A window collides in a band only through the shingle that is a template's least in that band,
    BANDS of them at most for a template: windows and texts without such an anchor can't be retrieved
    and leave before their bands are computed. Templates are kept on the driver, being few.
    A license whose shared shingles are all held by another that shares more, or as many of a
    shorter template, has nothing of its own there and is left to that one.
    Rows that share an id, null included, are reported together; a null or short text has no
    license; an empty table gives no rows; other columns are ignored.
    """
    rows = _shingled(spark.createDataFrame(sorted(templates.items()), "license string, text string"))
    known = [(r["license"], sorted(set(r["_s"]))) for r in rows.select("license", "_s").collect() if r["_s"]]
    width = {name: 1 << (len(s) - 1).bit_length() for name, s in known}
    table = spark.createDataFrame([(name, width[name], s) for name, s in known], "license string, width int, template array<long>")
    anchors = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.array_min(F.transform("template", lambda x: F.struct(F.xxhash64(x, k).alias("h"), x.alias("x"))))["x"])
    least = table.select(F.explode(anchors).alias("x")).distinct().collect()  # BANDS for a template at most
    every = F.lit(sorted(r["x"] for r in least)).cast("array<long>")
    table = table.select("license", "template", F.explode(_keys(F.col("template"), F.col("width"))).alias("key"))
    small = BANDS * sum(32 + 8 * len(s) for _, s in known) <= BROADCAST_BYTES
    hit = (
        _shingled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        .where(F.arrays_overlap("_s", every))
        .select("doc_id", "_s")
    )
    cut_at = lambda w: lambda i: F.struct(F.lit(w).alias("width"), F.slice("_s", i + 1, 2 * w).alias("part"))
    windows = F.concat(*(F.transform(F.sequence(F.lit(0), F.size("_s") - 1, F.lit(w)), cut_at(w)) for w in sorted(set(width.values()))))
    cut = hit.select("doc_id", F.explode(windows).alias("w")).select("doc_id", "w.width", "w.part").where(F.arrays_overlap("part", every))
    keyed = cut.select("doc_id", "part", F.explode(_keys(F.col("part"), F.col("width"))).alias("key"))
    both = F.array_intersect("part", "template")
    best = (
        keyed.join(F.broadcast(table) if small else table, "key")
        .where(100 * F.size(both) >= PERCENT * F.size("template"))
        .groupBy("doc_id", "license")
        .agg(F.max(F.struct(F.size(both).alias("n"), F.array_sort(both).alias("s"))).alias("b"), F.max(F.size("template")).alias("m"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("license", "b.n", "b.s", "m")).alias("all"))  # a row per template at most
    )
    left_to = lambda x: lambda y: (F.size(F.array_except(x["s"], y["s"])) == 0) & ((y["n"] > x["n"]) | (y["m"] < x["m"]))
    own = F.filter("all", lambda x: ~F.exists("all", left_to(x)))
    return best.select("doc_id", F.explode(own).alias("x")).select("doc_id", "x.license", F.col("x.n").cast("long").alias("n_shared"), F.col("x.m").cast("long").alias("n_template"))
