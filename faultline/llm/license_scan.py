"""Licence recognition from sentences and ordered rules, row by row in DataFrame operations (op1).

A text is lower-cased, runs of anything but letters and digits become one blank, and it is cut
at line ends and at white space after ``.``, ``!``, ``?`` or ``;``.  A known licence sentence is
found where its words lie between two cuts, also over several lines (hard-wrapped text, with or
without comment leaders) and behind ``;``, never over ``.``, ``!`` or ``?``; every other stretch between cuts
is an unknown sentence.  Numbers of list items and lines of punctuation only are no sentences.
The identifiers found, in order, form the text's sequence; a
sentence that is not known ends a run.  The rules are tried in their order on every run: a rule
matches where its identifiers follow each other, and takes them, so a whole licence text is not
also reported as the short reference that it contains.

The sentence tables and the rules are small constants of the code, so the lookup is one pattern
and a literal map in the plan: one pass over the texts, no shuffle and nothing that grows.

Defined results: null and empty texts have no sentences and no licence; a sentence that
repeats counts each time, a licence is listed once, in order of its first appearance; known
sentences that no rule takes are counted as unresolved; rows are handled one by one, so equal
rows get equal results; an empty table gives an empty table; extra columns do not matter.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-reference",
    "licensed under the mit license": "mit-reference",
    "this project is licensed under the mit license": "mit-reference",
    "spdx license identifier mit": "mit-reference",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-reference",
    "licensed under the apache license version 2 0 the license": "apache2-grant",
    "spdx license identifier apache 2 0": "apache2-reference",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
    "an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "this work is licensed under the gnu general public license version 2": "gpl2-reference",
    "this work is licensed under the gnu general public license version 3": "gpl3-reference",
    "licensed under the gnu general public license version 2": "gpl2-reference",
    "licensed under the gnu general public license version 3": "gpl3-reference",
    "spdx license identifier gpl 2 0 only": "gpl2-reference",
    "spdx license identifier gpl 3 0 only": "gpl3-reference",
    "spdx license identifier gpl 3 0 or later": "gpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version": "gpl2-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "gpl3-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "see the gnu general public license for more details": "gpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific "
    "prior written permission": "bsd-endorse",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation either version 2 1 of the license or at your option any "
    "later version": "lgpl2-or-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation either version 3 of the license or at your option any "
    "later version": "lgpl3-or-later",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
    "public license as published by the free software foundation either version 3 of the license or at your option any "
    "later version": "agpl3-or-later",
    "see the gnu affero general public license for more details": "agpl-see",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness": "isc-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
    "and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
    "transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
    "software is furnished to do so all subject to the following": "bsl1-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which "
    "is available at https www eclipse org legal epl 2 0": "epl2-grant",
    "licensed under cc by 4 0": "cc-by-reference",
    "licensed under cc by sa 4 0": "cc-by-sa-reference",
    "licensed under cc by nc 4 0": "cc-by-nc-reference",
    "licensed under cc by nd 4 0": "cc-by-nd-reference",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-reference",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-reference",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-reference",
    "all rights reserved": "reserved",
}
#: Licences by the identifiers that make them, in the order in which they are tried.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-copy", "apache2-warranty"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl2-or-later", "gpl-hope", "gpl-implied", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later", "gpl-hope", "gpl-implied", "lgpl-see"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later", "gpl-hope", "gpl-implied", "agpl-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("LGPL-2.1-or-later", ["lgpl2-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later"]),
    ("MPL-2.0", ["mpl2-grant"]),
    ("Unlicense", ["unlicense-grant"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("EPL-2.0", ["epl2-grant"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("MIT", ["mit-reference"]),
    ("Apache-2.0", ["apache2-reference"]),
    ("GPL-2.0", ["gpl2-reference"]),
    ("GPL-3.0", ["gpl3-reference"]),
    ("CC-BY-4.0", ["cc-by-reference"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-reference"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-reference"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-reference"]),
    ("Proprietary", ["reserved"]),
]
#: Further licences that an SPDX line may name; the line's sentence and rule are made from the name.
SPDX = ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0",
        "ISC", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-or-later", "CC0-1.0"]
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", n.lower()): f"spdx-{n}" for n in SPDX}
RULES += [(n, [f"spdx-{n}"]) for n in SPDX]
# Every pattern below takes a text in one pass: what a repeated class takes, the next part cannot be.
#: A list item's number at the start of a line (of lower-case text), behind comment leaders.
LABEL = r"(?<!version)\n[^a-z0-9\n]*+(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[.)][ \t]++"
#: Between two cuts, a sentence in letters other than a to z (lower-case text has no others of ASCII).
FOREIGN = r"(?<=[\n\r])[^\n\r\p{L}\p{N}]*+[\p{L}\p{N}&&[^\x00-\x7F]][^a-z0-9\n\r]*+(?=[\n\r])"
#: The owner in the third BSD clause; a name may hold a full stop ("Inc.").
OWNER = (r"neither[ \n]the[ \n]name[ \n]of[ \n](?:[a-z0-9]++[ \n\r]){1,16}?nor[ \n]the[ \n]names[ \n]of[ \n]"
         r"(?:its|their|any|other)[ \n]contributors")
HOLDER = "neither the name of the copyright holder nor the names of its contributors"


def cut(text: Column) -> Column:
    """Words with one blank, line feed (line end or ``;``) or carriage return (``.``, ``!``, ``?``) between them."""
    t = F.concat(F.lit("\n"), F.translate(F.lower(F.coalesce(text, F.lit(""))), "\r", "\n"), F.lit("\n"))
    for pattern, put in ((LABEL, "\n"), (r"[.!?][ \t\n]+", "\r"), (r";[ \t]+", "\n"), (FOREIGN, "0"), (r"[^a-z0-9\n\r]+", " "),
                         (r" ?\n[ \n]*", "\n"), (r"[ \n]?\r[ \n\r]*", "\r"), (OWNER, HOLDER)):
        t = F.regexp_replace(t, pattern, put)
    return t


def identifiers(text: Column) -> Column:
    """Identifier of each sentence in order, '' for an unknown one."""
    known = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for s, i in SENTENCES.items()))
    short = min(map(len, SENTENCES))
    longest = sorted(SENTENCES, key=len, reverse=True)
    stretch = r"(?<=[\n\r])(?:" + "|".join(s.replace(" ", r"[ \n]") for s in longest) + r")(?=[\n\r])|[^\n\r]+"
    return F.transform(F.regexp_extract_all(cut(text), F.lit(stretch), F.lit(0)), lambda s: F.when(
        F.length(s) >= short, F.coalesce(F.try_element_at(known, F.translate(s, "\n", " ")), F.lit(""))).otherwise(F.lit("")))


def sequence(ids: Column) -> Column:
    """The identifiers as one string: ``<id>`` each, runs apart by ``|``."""
    marks = F.array_join(F.transform(ids, lambda i: F.when(i == "", F.lit("|")).otherwise(F.concat(F.lit("<"), i, F.lit(">")))), "")
    return F.trim(F.regexp_replace(marks, r"\|+", "|"), F.lit("|"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), identifiers, licenses (comma-separated), n_unresolved."""
    seen = df.select(F.col(doc_id).alias("doc_id"), sequence(identifiers(F.col(text))).alias("seq"))
    resolved = reduce(lambda c, rule: F.replace(c, F.lit("".join(f"<{i}>" for i in rule[1])), F.lit("{" + rule[0] + "}")),
                      RULES, F.col("seq"))
    count = lambda c, mark: (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))).cast("long")
    return seen.withColumn("done", resolved).select(
        "doc_id", count(F.col("seq"), "<").alias("n_sentences"), F.col("seq").alias("identifiers"),
        F.array_join(F.array_distinct(F.regexp_extract_all("done", F.lit(r"\{([^}]*)\}"), F.lit(1))), ",").alias("licenses"),
        count(F.col("done"), "<").alias("n_unresolved"))
