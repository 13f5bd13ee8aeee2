"""Licence recognition: known sentences to identifiers, and ordered rules over sequences of identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before a licence's name, or an expression of several, in a source file.
TAG = "SPDX-License-Identifier"
# Sentences of well-known licences and notices, by identifier, as they stand between the ends of END. What varies (years, names) lies outside them.
SENTENCES = {
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit0-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "apache-title": ["Apache License"],
    "apache-date": ["Version 2.0, January 2004"],
    "apache-grant": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-comply": ["you may not use this file except in compliance with the License", "you may not use this software except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-warranty": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "gpl-free": ["This program is free software"],
    "gpl-terms3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl-terms2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "later-2": ["either version 2 of the License, or (at your option) any later version"],
    "later-2.1": ["either version 2.1 of the License, or (at your option) any later version"],
    "later-3": ["either version 3 of the License, or (at your option) any later version"],
    "lgpl-free": ["This library is free software"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgpl-terms2.1": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-terms3": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-terms3": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gnu-2-date": ["Version 2, June 1991"],
    "gnu-2.1-date": ["Version 2.1, February 1999"],
    "gnu-3-date": ["Version 3, 29 June 2007"],
    "agpl-3-date": ["Version 3, 19 November 2007"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-warranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "mpl-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "epl-1-title": ["Eclipse Public License - v 1.0"],
    "epl-2-title": ["Eclipse Public License - v 2.0"],
    "epl-2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"],
    "epl-1-notice": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "bsl-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-notice": ["Distributed under the Boost Software License, Version 1.0"],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "wtfpl-terms": ["You just DO WHAT THE FUCK YOU WANT TO"],
    "psf-title": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "artistic-2-title": ["The Artistic License 2.0"],
    "ofl-title": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "ms-pl-title": ["Microsoft Public License (Ms-PL)"],
    "cddl-title": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "ncsa-title": ["University of Illinois/NCSA Open Source License"],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "cc0-waiver": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "cc0-title": ["CC0 1.0 Universal"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "unlicense-use": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "tag": [TAG],
}

# Names of licences in references, by licence.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "the MIT license (MIT)", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the BSD License", "BSD-3-Clause"],
    "BSD-4-Clause": ["the BSD 4-Clause License", "BSD-4-Clause"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPLv2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the AGPLv3", "AGPL-3.0"],
    "ISC": ["the ISC License", "ISC"],
    "0BSD": ["the BSD Zero Clause License", "0BSD"],
    "MIT-0": ["the MIT No Attribution License", "MIT-0"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "MPL-2.0"],
    "EPL-1.0": ["the Eclipse Public License 1.0", "EPL-1.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "EPL-2.0"],
    "EUPL-1.2": ["the European Union Public Licence 1.2", "the EUPL 1.2", "EUPL-1.2"],
    "CDDL-1.0": ["the Common Development and Distribution License 1.0", "CDDL-1.0"],
    "Zlib": ["the zlib License", "Zlib"],
    "BSL-1.0": ["the Boost Software License 1.0", "the Boost Software License, Version 1.0", "BSL-1.0"],
    "WTFPL": ["the WTFPL", "WTFPL"],
    "PSF-2.0": ["the Python Software Foundation License", "the PSF License", "PSF-2.0"],
    "Artistic-2.0": ["the Artistic License 2.0", "Artistic-2.0"],
    "OFL-1.1": ["the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1", "OFL-1.1"],
    "MS-PL": ["the Microsoft Public License", "MS-PL"],
    "NCSA": ["the University of Illinois/NCSA Open Source License", "NCSA"],
    "PostgreSQL": ["the PostgreSQL License", "PostgreSQL"],
    "ODbL-1.0": ["the Open Database License", "the Open Data Commons Open Database License", "ODbL-1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    "Unlicense": ["the Unlicense", "Unlicense"],
}
# The parts of the Creative Commons licences, and the ends of the names of their versions.
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"3.0": "3.0 Unported", "4.0": "4.0 International"}
for _part, _words in CC_PARTS.items():
    for _version, _end in CC_VERSIONS.items():
        _long = f"Creative Commons {_words} {_end} License"
        NAMES[f"CC-{_part}-{_version}"] = [f"CC {_part} {_version}", f"a {_long}", f"the {_long}", f"CC-{_part}-{_version}"]

# What a reference says before a licence's name, as any of the first words with any of the second.
REFERRING = [
    ["", "This project is ", "This work is ", "This software is ", "This program is ", "This code is "],
    ["Licensed under ", "Licensed under the terms of ", "Released under ", "Distributed under ", "Distributed under the terms of "],
]

# Rules in order of precedence, as a licence and the identifiers that must follow each other.
RULES = [
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT-0", "text", ["mit0-grant", "mit-warranty"]),
    ("Apache-2.0", "notice", ["apache-grant", "apache-comply", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", "text", ["apache-title", "apache-date"]),
    ("BSD-4-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", "notice", ["gpl-free", "gpl-terms3"]),
    ("GPL-3.0", "notice", ["gpl-free", "gpl-terms", "later-3"]),
    ("GPL-2.0", "notice", ["gpl-free", "gpl-terms", "later-2"]),
    ("GPL-2.0", "notice", ["gpl-free", "gpl-terms2"]),
    ("LGPL-2.1", "notice", ["lgpl-free", "lgpl-terms", "later-2.1"]),
    ("LGPL-2.1", "notice", ["lgpl-free", "lgpl-terms2.1"]),
    ("LGPL-3.0", "notice", ["lgpl-free", "lgpl-terms3"]),
    ("LGPL-3.0", "notice", ["gpl-free", "lgpl-terms3"]),
    ("LGPL-3.0", "notice", ["lgpl-free", "lgpl-terms", "later-3"]),
    ("AGPL-3.0", "notice", ["gpl-free", "agpl-terms3"]),
    ("GPL-2.0", "text", ["gpl-title", "gnu-2-date"]),
    ("GPL-3.0", "text", ["gpl-title", "gnu-3-date"]),
    ("LGPL-2.1", "text", ["lgpl-title", "gnu-2.1-date"]),
    ("LGPL-3.0", "text", ["lgpl-title", "gnu-3-date"]),
    ("AGPL-3.0", "text", ["agpl-title", "agpl-3-date"]),
    ("ISC", "text", ["isc-grant"]),
    ("0BSD", "text", ["0bsd-grant", "isc-warranty"]),
    ("MPL-2.0", "notice", ["mpl-ref"]),
    ("MPL-2.0", "reference", ["mpl-title"]),
    ("EPL-1.0", "reference", ["epl-1-title"]),
    ("EPL-2.0", "reference", ["epl-2-title"]),
    ("EPL-1.0", "notice", ["epl-1-notice"]),
    ("EPL-2.0", "notice", ["epl-2-notice"]),
    ("Zlib", "text", ["zlib-warranty", "zlib-liable", "zlib-grant"]),
    ("BSL-1.0", "reference", ["bsl-title"]),
    ("BSL-1.0", "notice", ["bsl-notice"]),
    ("WTFPL", "reference", ["wtfpl-title"]),
    ("WTFPL", "text", ["wtfpl-terms"]),
    ("PSF-2.0", "reference", ["psf-title"]),
    ("Artistic-2.0", "reference", ["artistic-2-title"]),
    ("OFL-1.1", "reference", ["ofl-title"]),
    ("MS-PL", "reference", ["ms-pl-title"]),
    ("CDDL-1.0", "reference", ["cddl-title"]),
    ("NCSA", "reference", ["ncsa-title"]),
    ("PostgreSQL", "text", ["postgresql-grant"]),
    ("CC0-1.0", "notice", ["cc0-waiver"]),
    ("CC0-1.0", "reference", ["cc0-title"]),
    ("Unlicense", "text", ["unlicense-grant"]),
    ("Unlicense", "text", ["unlicense-grant", "unlicense-use"]),
]
# Each licence has two rules more: a reference by name, and a tag followed by its name.
RULES += [(licence, kind, ids) for licence in NAMES for kind, ids in (("reference", [f"{licence}-ref"]), ("tag", ["tag", f"{licence}-name"]))]

#: Sentences end at punctuation before white space and at blank lines; in the second reading at every line end too.
END = r"[.!?:;]+[ \t\r\n]+|\n[ \t\r]*\n"
LINE_END = r"[.!?:;]+[ \t\r\n]+|[\r\n]+"
#: What follows a tag in its line, and what stands between the licences of an expression; the exception after WITH is no licence.
TAGGED = r"SPDX-License-Identifier:([^\r\n]*)"
BETWEEN = r"[()]|[ \t]+(?:OR|AND|or|and)[ \t]+|[ \t]+(?:WITH|with)[ \t]+[^ \t()]+"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Identifier by normalised sentence: a licence's names with what refers to them, its names in tags, and SENTENCES."""
    said = [first + then if not first else first + then.lower() for first in REFERRING[0] for then in REFERRING[1]]
    known = {normal(words + name): f"{licence}-ref" for licence, names in NAMES.items() for name in names for words in said}
    for licence in NAMES:
        known |= {normal(licence + end): f"{licence}-name" for end in ("", *(("-only", "-or-later", "+") if "GPL" in licence else ()))}
    return known | {normal(text): name for name, texts in SENTENCES.items() for text in texts}


def _normal(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a licence: doc_id, licenses (sorted, joined by `, `), evidence (`licence kind`, likewise), sentences.

    Texts are cut into sentences twice, with line ends as white space and as ends, so wrapped and one-line
    notices are both read, and a third time the names in tags: `A OR B`, `A AND (B OR C)` and `A WITH exception` are tags of each
    licence in them. Sentences lose case and punctuation and are looked up among the known ones, a
    fixed table that is broadcast. A document's identifiers in order of place are matched with the rules: a rule
    fits where its identifiers follow one another with no other known sentence between. A rule whose
    identifiers are a run of a longer one that fits is left out. sentences counts the known sentences found, in the reading with more.

    Null, empty or other texts without a licence: no row. Repeated rows of an id and text: as one; different texts of
    an id, or without an id: a row each. Very long texts are read whole. Licences of equal places can't be, so there are no
    ties. No rows: no rows. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(list(known_sentences().items()), "sentence string, name string"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # An outer explode: for others Catalyst adds a filter that would cut each text twice.
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("h", F.md5("text"))
    read = lambda reading, end: F.transform(F.split("text", end), lambda s, i: F.struct(F.lit(reading).alias("reading"), i.alias("place"), s.alias("s")))
    tagged = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(TAGGED), F.lit(1)), lambda t: F.flatten(F.transform(F.split(t, BETWEEN), lambda n: F.array(F.lit(TAG), n)))))
    expressions = F.transform(tagged, lambda s, i: F.struct(F.lit(2).alias("reading"), i.alias("place"), s.alias("s")))
    parts = rows.select("doc_id", "h", F.explode_outer(F.concat(read(0, END), read(1, LINE_END), expressions)).alias("p"))
    parts = parts.select("doc_id", "h", "p.reading", "p.place", _normal(F.col("p.s")).alias("sentence"))
    found = parts.join(known, "sentence").select("doc_id", "h", "reading", "place", "name")
    runs = found.groupBy("doc_id", "h", "reading").agg(F.sort_array(F.collect_set(F.struct("place", "name"))).alias("names"))
    runs = runs.withColumn("run", F.concat(F.lit(" "), F.array_join(F.col("names")["name"], " "), F.lit(" ")))
    rules = F.array(*[F.struct(F.lit(r[0]).alias("licence"), F.lit(f"{r[0]} {r[1]}").alias("evidence"), F.lit(f" {' '.join(r[2])} ").alias("ids")) for r in RULES])
    runs = runs.withColumn("fits", F.filter(rules, lambda r: F.contains(F.col("run"), r["ids"])))
    part = lambda r: F.exists("fits", lambda other: (other["ids"] != r["ids"]) & F.contains(other["ids"], r["ids"]))
    runs = runs.select("doc_id", "h", F.size("names").alias("n"), F.filter("fits", lambda r: ~part(r)).alias("rules"))
    per = runs.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("rules")).alias("rules"), F.max("n").cast("long").alias("sentences"))
    pick = lambda field: F.array_join(F.array_sort(F.array_distinct(F.col(f"rules.{field}"))), ", ")
    return per.where(F.size("rules") > 0).select("doc_id", pick("licence").alias("licenses"), pick("evidence").alias("evidence"), "sentences")


def oracle_sql() -> str:
    """DuckDB SQL for scan() on documents, from the same fixed tables."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in known_sentences().items())
    rules = ", ".join(f"({k}, {quoted(r[0])}, {quoted(r[0] + ' ' + r[1])}, {quoted(' ' + ' '.join(r[2]) + ' ')})" for k, r in enumerate(RULES))
    return f"""
        WITH known(sentence, name) AS (VALUES {known}), rules(k, licence, evidence, ids) AS (VALUES {rules}),
        cut AS (
            SELECT doc_id, md5(text) AS h, 0 AS reading, string_split_regex(text, '{END}') AS parts FROM documents
            UNION ALL SELECT doc_id, md5(text), 1, string_split_regex(text, '{LINE_END}') FROM documents
            UNION ALL SELECT doc_id, md5(text), 2, flatten(list_transform(flatten(list_transform(regexp_extract_all(text, '{TAGGED}', 1), lambda t: string_split_regex(t, '{BETWEEN}'))),
                lambda n: ['{TAG}', n])) FROM documents WHERE contains(text, '{TAG}:')
        ), parts AS (
            SELECT doc_id, h, reading, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM cut
        ), found AS (
            SELECT DISTINCT doc_id, h, reading, place, name FROM parts
            JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))
        ), runs AS (
            SELECT doc_id, h, reading, count(*) AS n, ' ' || string_agg(name, ' ' ORDER BY place) || ' ' AS run FROM found GROUP BY ALL
        ), fits AS (
            SELECT doc_id, h, reading, n, k, licence, evidence, ids FROM runs JOIN rules ON contains(run, ids)
        ), chosen AS (
            SELECT * FROM fits f WHERE NOT EXISTS (
                SELECT 1 FROM fits g WHERE g.doc_id IS NOT DISTINCT FROM f.doc_id AND g.h = f.h AND g.reading = f.reading AND g.ids <> f.ids AND contains(g.ids, f.ids))
        )
        SELECT c.doc_id, string_agg(DISTINCT licence, ', ' ORDER BY licence) AS licenses,
               string_agg(DISTINCT evidence, ', ' ORDER BY evidence) AS evidence, max(m.n) AS sentences
        FROM chosen c JOIN (SELECT doc_id, h, max(n) AS n FROM runs GROUP BY doc_id, h) m ON m.doc_id IS NOT DISTINCT FROM c.doc_id AND m.h = c.h
        GROUP BY c.doc_id, c.h
    """
