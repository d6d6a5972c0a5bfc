"""License recognition by sentences.

A text is normalised to words and breaks.  Known license sentences are found as
runs of words that end where a sentence or line ends, also inside of longer
sentences and over wrapped lines, and the identifiers found, in order, are matched against
ordered rules: a rule is a run of identifiers, and what a rule has matched no
later rule sees.  The sentence table and the rules are parameters of a fixed
size; all work is done by built-in functions, row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and normalised text of sentences of well-known licenses.
SENTENCES: list[tuple[str, str]] = [
    ("ApacheRef2", "licensed under the apache license version 2 0"),
    ("ApacheRef2", "licensed under the apache license version 2 0 the license"),
    ("ApacheComply", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", "released under the mit license"),
    ("MitRef", "licensed under the mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MitLiable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("IscGrant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdEndorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("GplRef2", "this work is licensed under the gnu general public license version 2"),
    ("GplRef3", "this work is licensed under the gnu general public license version 3"),
    ("GplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplFree2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GplOnly2", "gnu general public license version 2 as published by the free software foundation"),
    ("GplOnly2", "gnu general public license version 2 as published"),
    ("GplOnly2", "gnu general public license as published by the free software foundation version 2 of the license"),
    ("GplOnly3", "gnu general public license version 3 as published by the free software foundation"),
    ("GplOnly3", "gnu general public license version 3 as published"),
    ("GplOnly3", "gnu general public license as published by the free software foundation version 3 of the license"),
    ("GplSee", "see the gnu general public license for more details"),
    ("GplCopy", "you should have received a copy of the gnu general public license along with this program"),
    ("LgplFree21", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("LgplFree3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LgplNoWarranty", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("AgplFree3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("MplForm", "this source code form is subject to the terms of the mozilla public license v"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("BoostRef", "distributed under the boost software license version 1 0"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("UnlicenseFree", "this is free and unencumbered software released into the public domain"),
    ("UnlicenseGrant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("EplRef2", "made available under the terms of the eclipse public license 2 0"),
    ("EplRef2", "made available under the terms of the eclipse public license v2 0"),
    ("EplRef2", "made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0"),
    ("EplRef2", "made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("EplRef2", "made available under the terms of the eclipse public license v2 0 which accompanies this distribution"),
    ("CcZeroRef", "licensed under cc0 1 0"),
    ("SpdxApache2", "spdx license identifier apache 2 0"),
    ("SpdxMit", "spdx license identifier mit"),
    ("SpdxBsd2", "spdx license identifier bsd 2 clause"),
    ("SpdxBsd3", "spdx license identifier bsd 3 clause"),
    ("SpdxIsc", "spdx license identifier isc"),
    ("SpdxMpl2", "spdx license identifier mpl 2 0"),
    ("SpdxGpl2", "spdx license identifier gpl 2 0 only"),
    ("SpdxGpl2Later", "spdx license identifier gpl 2 0 or later"),
    ("SpdxGpl3", "spdx license identifier gpl 3 0 only"),
    ("SpdxGpl3Later", "spdx license identifier gpl 3 0 or later"),
    ("GplNoWarranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("CcByNcRef4", "licensed under cc by nc 4 0"),
    ("CcByRef4", "licensed under cc by 4 0"),
    ("CcBySaRef4", "licensed under cc by sa 4 0"),
    ("AllRights", "all rights reserved"),
]

#: License and the identifiers that make it, in the order in which the rules are tried.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["ApacheRef2", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef2", "ApacheComply", "ApacheCopy"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiable"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("ISC", ["IscGrant", "IscAsIs"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseGrant"]),
    ("GPL-3.0-or-later", ["GplFree", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("GPL-3.0-or-later", ["GplFree", "GplNoWarranty", "GplSee"]),
    ("GPL-3.0-or-later", ["GplFree", "GplNoWarranty"]),
    ("GPL-2.0-or-later", ["GplFree2", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("GPL-2.0-or-later", ["GplFree2", "GplNoWarranty", "GplSee"]),
    ("GPL-2.0-or-later", ["GplFree2", "GplNoWarranty"]),
    ("AGPL-3.0-or-later", ["AgplFree3", "GplNoWarranty"]),
    ("LGPL-2.1-or-later", ["LgplFree21", "LgplNoWarranty"]),
    ("LGPL-3.0-or-later", ["LgplFree3", "LgplNoWarranty"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-2.0-or-later", ["GplFree2"]),
    ("AGPL-3.0-or-later", ["AgplFree3"]),
    ("LGPL-2.1-or-later", ["LgplFree21"]),
    ("LGPL-3.0-or-later", ["LgplFree3"]),
    ("GPL-2.0-only", ["GplOnly2"]),
    ("GPL-3.0-only", ["GplOnly3"]),
    ("EPL-2.0", ["EplRef2"]),
    ("MPL-2.0", ["MplForm", "MplCopy"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostRef"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("Apache-2.0", ["ApacheRef2"]),
    ("MIT", ["MitRef"]),
    ("GPL-3.0", ["GplRef3"]),
    ("GPL-2.0", ["GplRef2"]),
    ("CC-BY-NC-4.0", ["CcByNcRef4"]),
    ("CC-BY-SA-4.0", ["CcBySaRef4"]),
    ("CC-BY-4.0", ["CcByRef4"]),
    ("CC0-1.0", ["CcZeroRef"]),
    ("Apache-2.0", ["SpdxApache2"]),
    ("MIT", ["SpdxMit"]),
    ("BSD-2-Clause", ["SpdxBsd2"]),
    ("BSD-3-Clause", ["SpdxBsd3"]),
    ("ISC", ["SpdxIsc"]),
    ("MPL-2.0", ["SpdxMpl2"]),
    ("GPL-2.0-only", ["SpdxGpl2"]),
    ("GPL-2.0-or-later", ["SpdxGpl2Later"]),
    ("GPL-3.0-only", ["SpdxGpl3"]),
    ("GPL-3.0-or-later", ["SpdxGpl3Later"]),
]

#: Identifiers of the SPDX list that an expression may name.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
#: A line's expression of identifiers, AND, OR, WITH and brackets.
SPDX_LINE = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\t -]+)"

#: No known sentence goes on over one of . ! ? before white space or the end, or over a blank line.
HARD_END = r"[.!?]+(?=\s|$)|\n{2,}"
#: A known sentence may end at, or go on over, one of , ; : before white space or the end, or a single line break.
SOFT_END = r"[,;:]+(?=\s|$)|\n"
#: After a line break: indents and the marks of comments and quotes.
LINE_START = r"\n[ \t\x0B\f#*/;%>|!-]+"
_HARD, _SOFT = "\x01", "\x02"


def normalised(text: Column) -> Column:
    """Words and breaks: A-Z lower-cased, ends of sentences and lines marked, every run of other than letters and digits of ASCII one blank."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _HARD + _SOFT, "abcdefghijklmnopqrstuvwxyz  "
    out = F.regexp_replace(F.translate(text, upper, lower), r"\r\n?", "\n")
    out = F.regexp_replace(out, LINE_START, "\n")
    out = F.regexp_replace(F.regexp_replace(out, HARD_END, _HARD), SOFT_END, _SOFT)
    return F.regexp_replace(out, f"[^a-z0-9{_HARD}{_SOFT}]+", " ")


def runs(known: list[tuple[str, str]]) -> str:
    """Pattern of known sentences in normalised text, of several at a place the longest."""
    between = f"[ {_SOFT}]+"
    every = sorted({s for _, s in known}, key=lambda s: (-len(s), s))
    first = "".join(sorted({s[0] for s in every}))
    return f"(?<![a-z0-9])(?=[{first}])(?:{'|'.join(s.replace(' ', between) for s in every)})(?= ?(?:[{_HARD}{_SOFT}]|$))"


def spdx(text: Column) -> Column:
    """Licenses that the text's SPDX expressions of several terms name, in order; a line of one identifier is a known sentence already."""
    every = F.filter(F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1)), lambda x: x.rlike(r"(?i)\s(?:and|or)\s"))
    terms = F.flatten(F.transform(every, lambda x: F.split(F.regexp_replace(x, r"(?i)\swith\s+\S+|[()]", " "), r"(?i)\s+(?:and|or)\s+")))
    names = F.create_map(*[F.lit(y) for x in SPDX for y in (x.lower(), x)])
    return F.filter(F.transform(terms, lambda x: names[F.lower(F.trim(x))]), lambda x: x.isNotNull())


def recognise(docs: DataFrame, known: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """One row per document: doc_id, its known sentences' identifiers in order, the licenses, and the identifiers no rule took.

    docs: doc_id, text; other columns are ignored.  Null and empty texts have
    no sentences.  A license found several times is named once, at its first
    rule; those that an SPDX expression names come last; rows with the same doc_id are read one by one.  No rows: no rows.
    """
    ids: dict[str, list[str]] = {}
    for name, sentence in known:
        ids.setdefault(name, []).append(sentence)

    def name_of(s: Column) -> Column:
        out = F.when(s.isin(*next(iter(ids.values()))), F.lit(next(iter(ids))))
        for name, texts in list(ids.items())[1:]:
            out = out.when(s.isin(*texts), F.lit(name))
        return out

    matches = F.regexp_extract_all(normalised(F.coalesce("text", F.lit(""))), F.lit(runs(known)), F.lit(0))
    found = F.transform(matches, lambda s: name_of(F.regexp_replace(s, f"[ {_SOFT}]+", " ")))
    out = docs.select(F.col("doc_id"), found.alias("sentence_ids"), spdx(F.coalesce("text", F.lit(""))).alias("spdx"))
    out = out.withColumn("left", F.when(F.size("sentence_ids") > 0, F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))).otherwise(""))
    # each rule takes its runs out of what is left, and names its license if it took any
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{x}|" for x in run)).alias("run")) for name, run in rules])
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<string>").alias("names"))
    took = lambda acc, r: F.struct(F.replace(acc["left"], r["run"], F.lit("/")).alias("left"), F.when(F.contains(acc["left"], r["run"]), F.concat(acc["names"], F.array(r["name"]))).otherwise(acc["names"]).alias("names"))
    taken = F.when(F.col("left") == "", start).otherwise(F.aggregate(table, start, took))
    out = out.select("doc_id", "sentence_ids", "spdx", taken.alias("taken"))
    return out.select(
        "doc_id",
        "sentence_ids",
        F.array_distinct(F.concat("taken.names", "spdx")).alias("licenses"),
        F.filter(F.split("taken.left", r"[|/]+"), lambda x: x != "").alias("unmatched"),
    )
