"""Licences of files: their headers and licence files against templates, then inheritance by directory.

Statements become sparse TF-IDF vectors, and the cosine to each template is a
join on tokens.  A file's statements are its lines that name a licence, its
paragraphs that do (header blocks; comment signs alone on a line end one), all
from the first such line to the last, and each SPDX tag; of a file called
LICENSE or the like also every paragraph and the whole.  Templates are notices,
titles, header blocks, bodies and SPDX tags; a token's weight falls with the
number of licences that have it.  The best of all cosines above a threshold is
the file's own licence.  A directory's licence is that of its licence file.  A
file without one of its own takes that of its nearest ancestor directory: the
distinct directories are exploded into their ancestors and joined with the
licensed ones by path.

All of it is built-in functions.  The tables that are broadcast are the
templates' (their number is fixed here).  Joins of files with directories are
plain equi-joins, so a directory that holds a third of all files is split by
Spark; everything before them is summed per file or directory first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.storage import Workspace

#: Lowest cosine of a licence.
THRESHOLD = 0.5
#: A statement's line has one of these.
ANCHOR = r"(?i)licen[sc]e|copyright|spdx|copyleft|public domain|released under"
#: Names of licence files.
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"
#: Short notices by licence; fixed values.
TEMPLATES = (
    ("AGPL-3.0", "this program is licensed under the gnu affero general public license version 3"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("BSD-2-Clause", "licensed under the bsd 2-clause simplified license"),
    ("BSD-3-Clause", "licensed under the bsd 3-clause new or revised license"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license cc by 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license cc by-nc 4.0"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license cc by-sa 4.0"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal no copyright reserved"),
    ("GPL-2.0", "this program is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("ISC", "permission to use under the isc license"),
    ("LGPL-3.0", "this library is licensed under the gnu lesser general public license version 3"),
    ("MIT", "released under the mit license"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("Unlicense", "released into the public domain under the unlicense"),
)
#: Titles, header blocks, telling paragraphs and bodies of standard texts; fixed values.
TEXTS = (
    ("AGPL-3.0", "gnu affero general public license version 3, 19 november 2007"),
    ("AGPL-3.0", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version."),
    ("AGPL-3.0", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license version 3 as published by the free software foundation."),
    ("Apache-2.0", "apache license version 2.0, january 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {source} {binary}"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {source} {binary} {bsd}"),
    ("BSD-3-Clause", "{neither}"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {source} {binary} {neither}"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {source} {binary} {neither} {bsd}"),
    ("CC-BY-4.0", "attribution 4.0 international"),
    ("CC-BY-4.0", "creative commons attribution 4.0 international public license"),
    ("CC-BY-NC-4.0", "attribution-noncommercial 4.0 international"),
    ("CC-BY-NC-4.0", "creative commons attribution-noncommercial 4.0 international public license"),
    ("CC-BY-SA-4.0", "attribution-sharealike 4.0 international"),
    ("CC-BY-SA-4.0", "creative commons attribution-sharealike 4.0 international public license"),
    ("CC0-1.0", "cc0 1.0 universal"),
    ("CC0-1.0", "creative commons legal code cc0 1.0 universal"),
    ("GPL-2.0", "gnu general public license version 2, june 1991"),
    ("GPL-2.0", "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version."),
    ("GPL-2.0", "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation."),
    ("GPL-3.0", "gnu general public license version 3, 29 june 2007"),
    ("GPL-3.0", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version."),
    ("GPL-3.0", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license version 3 as published by the free software foundation."),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {isc}"),
    ("LGPL-3.0", "gnu lesser general public license version 3, 29 june 2007"),
    ("LGPL-3.0", "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version."),
    ("LGPL-3.0", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version."),
    ("MIT", "the mit license (mit)"),
    ("MIT", "{grant}"),
    ("MIT", "{grant} {notice} {mit}"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/."),
    ("Unlicense", "this is free and unencumbered software released into the public domain."),
    ("Unlicense", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Parts that several of the texts have; fixed values.
PARTS = {
    "grant": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:",
    "notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    "mit": "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "source": "1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "binary": "2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "neither": "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd": "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "isc": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
}
#: An SPDX tag, a statement of its own; of an expression it is the first identifier.
SPDX = r"(?i)spdx-license-identifier:[ \t(]*[a-z0-9.+-]+"
#: What ends a paragraph: lines without a letter or digit.
PARAGRAPH = r"\n[^\p{L}\p{N}]*\n"
#: A token: a run of letters and digits, with dots, pluses and hyphens inside.
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def templates() -> list[tuple[str, str]]:
    """Licence and text of every template: notices, standard texts, and the SPDX tags made from the licences' names."""
    tags = [(name, f"spdx-license-identifier: {name}{end}".lower()) for name, _ in TEMPLATES for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    return [*TEMPLATES, *((name, text.format(**PARTS)) for name, text in TEXTS), *tags]


def _values() -> str:
    return ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(templates()))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _weights(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """idf of the templates' tokens by the licences that have them, and each template's weights, scaled to length 1."""
    found = spark.sql(f"SELECT * FROM VALUES {_values()} AS t(template, license, body)").select("template", "license", F.explode(_tokens(F.col("body"))).alias("token"))
    tf = found.groupBy("template", "license", "token").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("token").agg((F.log((1 + len(TEMPLATES)) / (1 + F.countDistinct("license"))) + 1).alias("idf"))
    weight = tf.join(idf, "token").select("template", "license", "token", (F.col("tf") * F.col("idf")).alias("w"))
    length = weight.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return idf, weight.join(length, "template").select("template", "license", "token", (F.col("w") / F.col("length")).alias("w"))


def _statements(text: Column, named: Column) -> Column:
    """The distinct statements of a text that has an anchor or, if ``named``, is a licence file."""
    lines = F.split(text, "\n")
    hits = F.transform(lines, lambda line: line.rlike(ANCHOR))
    first, after = F.array_position(hits, True), F.size(lines) - F.array_position(F.reverse(hits), True) + 2
    span = F.when(named, text).when(first > 0, F.array_join(F.slice(lines, first.cast("int"), (after - first).cast("int")), "\n"))
    paragraphs = F.filter(F.split(text, PARAGRAPH), lambda block: named | block.rlike(ANCHOR))
    tags = F.regexp_extract_all(text, F.lit(SPDX), F.lit(0))
    return F.array_distinct(F.array_compact(F.concat(F.filter(lines, lambda line: line.rlike(ANCHOR)), paragraphs, tags, F.array(span))))


def own_licenses(spark: SparkSession, files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, license and similarity of files (path, text) that state one; equal cosines go to the first name.

    Texts are scanned once, for the statements' tokens, which are written as a
    table of their own.
    """
    space = Workspace(spark, "licences")
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    stated = files.where(F.col("text").rlike(ANCHOR) | named).select("path", F.explode(_statements(F.col("text"), named)).alias("body"))
    # The digest is taken before tokens become rows; after it, every token of a long text would digest the whole of it.
    tokens = stated.select("path", F.md5("body").alias("place"), _tokens(F.col("body")).alias("tokens")).select("path", "place", F.explode("tokens").alias("token"))
    tf = space.cut(tokens.groupBy("path", "place", "token").agg(F.count("*").alias("tf")), "tf")
    idf, weights = _weights(spark)
    unseen = F.log(F.lit(1.0 + len(TEMPLATES))) + 1
    mine = tf.join(F.broadcast(idf), "token", "left").select("path", "place", "token", (F.col("tf") * F.coalesce("idf", unseen)).alias("v"))
    length = mine.groupBy("path", "place").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = mine.join(F.broadcast(weights), "token").groupBy("path", "place", "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    cosine = dots.join(length, ["path", "place"]).select("path", "license", F.round(F.col("dot") / F.col("length"), 6).alias("similarity"))
    best = cosine.where(F.col("similarity") >= threshold).groupBy("path").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    return space.cut(best.select("path", "b.license", (-F.col("b.s")).alias("similarity")), "own")


def license_scan(spark: SparkSession, files: DataFrame, threshold: float = THRESHOLD, stated_counts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Own and effective licence of every file.

    ``files`` has path (directories separated by /) and text.  Gives path,
    license and similarity (null where the file states none), directory,
    effective_license and inherited_from (the directory that gave it; null for
    own ones), after the columns of ``keep``, which are passed on as they are.
    A directory's licence comes from its licence files, or from every file that
    states one if ``stated_counts``; of several the first path counts.  Null
    texts and empty ones state nothing; a null path has no directory and
    inherits nothing; rows of one path are one file for its licence and stay
    rows; other columns are ignored; no rows give none.
    """
    if taken := {"path", "text", "directory", "license", "similarity", "effective_license", "inherited_from"} & set(keep):
        raise ValueError(f"names of the result can't be kept: {sorted(taken)}")
    slim = files.select("path", "text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("kept"))
    own = own_licenses(spark, slim, threshold)
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    notices = own if stated_counts else own.where(F.col("path").rlike(LICENSE_FILE))
    declared = notices.select(folder.alias("ancestor"), "path", "license").groupBy("ancestor").agg(F.min(F.struct("path", "license")).alias("n")).select("ancestor", F.col("n.license").alias("given"))

    # Directories, each once, with all their ancestors: their number is the depth of the path.
    folders = slim.where("path IS NOT NULL").select(folder.alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = folders.select("directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("ancestor"))
    nearest = above.join(declared, "ancestor").groupBy("directory").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "given")).alias("n"))
    given = nearest.select("directory", F.col("n.ancestor").alias("ancestor"), F.col("n.given").alias("given"))

    rows = slim.select("path", "kept", F.when(F.col("path").isNotNull(), folder).alias("directory")).join(own, "path", "left").join(given, "directory", "left")
    return rows.select(
        *(F.col(f"kept.`{c}`") for c in keep), "path", "directory", "license", "similarity", F.coalesce("license", "given").alias("effective_license"),
        F.when(F.col("license").isNull(), F.col("ancestor")).alias("inherited_from"),
    )


def tree_path(columns: tuple[str, str] = ("source", "lang"), key: str = "doc_id") -> Column:
    """A path for a row of ``documents``: source, language, then a directory a digit, so ids with a common beginning share ancestors."""
    digits = F.array_join(F.regexp_extract_all(F.col(key).cast("string"), F.lit(r"-?\d"), F.lit(0)), "/")
    return F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("none")) for c in columns), F.coalesce(digits, F.lit("none")))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the query: documents at ``tree_path``, every stated licence counts for its directory."""
    return rf"""
    WITH files AS MATERIALIZED (
      SELECT row_number() OVER () AS file, doc_id, text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(array_to_string(regexp_extract_all(doc_id::VARCHAR, '-?\d'), '/'), 'none') AS path FROM documents),
    t AS (SELECT * FROM (VALUES {_values()}) AS t(template, license, body)),
    tf AS (SELECT template, license, token, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '{TOKEN}')) AS token FROM t) GROUP BY ALL),
    idf AS (SELECT token, ln((1.0 + {len(TEMPLATES)}) / (1 + count(DISTINCT license))) + 1 AS idf FROM tf GROUP BY token),
    w0 AS (SELECT template, license, token, tf * idf AS w FROM tf JOIN idf USING (token)),
    w AS (SELECT template, license, token, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS w FROM w0),
    own_files AS (SELECT file, path, text FROM files WHERE regexp_matches(text, '{ANCHOR}')),
    lines AS (SELECT file, path, place, body, regexp_matches(body, '{ANCHOR}') AS hit
              FROM (SELECT file, path, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS place FROM own_files)),
    spans AS (SELECT file, min(place) AS a, max(place) AS z FROM lines WHERE hit GROUP BY file),
    stated AS (SELECT file, path, 'line' || place AS place, body FROM lines WHERE hit
               UNION ALL SELECT file, path, 'span', body FROM lines JOIN spans USING (file) WHERE place BETWEEN a AND z
               UNION ALL SELECT file, path, 'tag' || body, body FROM (SELECT DISTINCT file, path, unnest(regexp_extract_all(text, '{SPDX}')) AS body FROM own_files)
               UNION ALL SELECT file, path, 'block' || md5(body), body FROM (SELECT DISTINCT file, path, unnest(regexp_split_to_array(text, '{PARAGRAPH}')) AS body FROM own_files) WHERE regexp_matches(body, '{ANCHOR}')),
    f AS (SELECT file, path, place, token, count(*) AS tf FROM (SELECT file, path, place, unnest(regexp_extract_all(lower(body), '{TOKEN}')) AS token FROM stated) GROUP BY ALL),
    v0 AS (SELECT file, path, place, token, tf * coalesce(idf, ln(1.0 + {len(TEMPLATES)}) + 1) AS v FROM f LEFT JOIN idf USING (token)),
    v AS (SELECT file, path, place, token, v / sqrt(sum(v * v) OVER (PARTITION BY file, place)) AS v FROM v0),
    cosine AS (SELECT path, license, round(sum(v * w), 6) AS s FROM v JOIN w USING (token) GROUP BY file, path, place, template, license),
    own AS (SELECT path, license, s AS similarity FROM cosine WHERE s >= {threshold} QUALIFY row_number() OVER (PARTITION BY path ORDER BY s DESC, license) = 1),
    dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files),
    declared AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS ancestor, arg_min(license, path) AS given FROM own GROUP BY 1),
    above AS (SELECT directory, unnest(list_transform(range(0, len(string_split(directory, '/')) + 1), lambda k: array_to_string(string_split(directory, '/')[1:k], '/'))) AS ancestor FROM dirs),
    given AS (SELECT directory, ancestor, given FROM above JOIN declared USING (ancestor) QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(ancestor) DESC) = 1)
    SELECT doc_id, files.path, directory, license, similarity, coalesce(license, given) AS effective_license, CASE WHEN license IS NULL THEN ancestor END AS inherited_from
    FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files) AS files LEFT JOIN own USING (path) LEFT JOIN given USING (directory)
    """
