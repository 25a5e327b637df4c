"""Licence scans by sentence rules, with DataFrame operations only.

Texts are cut into sentences, sentences are normalised and looked up among known licence
sentences, and each text's sequence of identifiers is matched against ordered rules. A rule
that matches takes its identifiers out, so later and more general rules see only the rest. Line
breaks are both tried, as a sentence's end and as none, so the width of lines does not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import held_once

#: Licences as (name, stem of its identifiers, its normalised names in sentences).
LICENSES = [
    ("Apache-2.0", "Apache", ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache license v2.0"]),
    ("Apache-1.1", "Apache11", ["apache software license version 1.1"]),
    ("MIT", "MIT", ["mit license", "expat license"]),
    ("ISC", "ISC", ["isc license"]),
    ("0BSD", "ZeroBSD", ["zero clause bsd license", "0bsd license", "bsd zero clause license"]),
    ("BSD-2-Clause", "BSD2", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"]),
    ("BSD-3-Clause", "BSD3", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"]),
    ("BSD-4-Clause", "BSD4", ["bsd 4 clause license", "original bsd license"]),
    ("GPL-2.0-only", "GPL2", ["gnu general public license version 2", "gnu gpl v2", "gpl version 2", "gplv2", "gnu general public license v2.0"]),
    ("GPL-3.0-only", "GPL3", ["gnu general public license version 3", "gnu gpl v3", "gpl version 3", "gplv3", "gnu general public license v3.0"]),
    ("GPL-2.0-or-later", "GPL2Later", ["gnu general public license version 2 or later", "gplv2 or later"]),
    ("GPL-3.0-or-later", "GPL3Later", ["gnu general public license version 3 or later", "gplv3 or later"]),
    ("LGPL-2.0-or-later", "LGPL2Later", ["gnu library general public license version 2 or later"]),
    ("LGPL-2.0-only", "LGPL2", ["gnu library general public license version 2"]),
    ("LGPL-2.1-only", "LGPL21", ["gnu lesser general public license version 2.1", "lgpl version 2.1", "lgplv2.1"]),
    ("LGPL-2.1-or-later", "LGPL21Later", ["gnu lesser general public license version 2.1 or later", "lgplv2.1 or later"]),
    ("LGPL-3.0-only", "LGPL3", ["gnu lesser general public license version 3", "lgpl version 3", "lgplv3"]),
    ("LGPL-3.0-or-later", "LGPL3Later", ["gnu lesser general public license version 3 or later", "lgplv3 or later"]),
    ("AGPL-3.0-only", "AGPL3", ["gnu affero general public license version 3", "agpl version 3", "agplv3"]),
    ("AGPL-3.0-or-later", "AGPL3Later", ["gnu affero general public license version 3 or later", "agplv3 or later"]),
    ("MPL-1.1", "MPL11", ["mozilla public license version 1.1", "mpl 1.1"]),
    ("MPL-2.0", "MPL2", ["mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"]),
    ("EPL-1.0", "EPL1", ["eclipse public license version 1.0", "eclipse public license v1.0", "eclipse public license 1.0"]),
    ("EPL-2.0", "EPL2", ["eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license 2.0"]),
    ("CDDL-1.0", "CDDL1", ["common development and distribution license version 1.0", "cddl 1.0"]),
    ("CDDL-1.1", "CDDL11", ["common development and distribution license version 1.1", "cddl 1.1"]),
    ("BSL-1.0", "Boost1", ["boost software license version 1.0", "boost software license"]),
    ("BUSL-1.1", "BUSL11", ["business source license 1.1", "business source license version 1.1"]),
    ("Zlib", "Zlib", ["zlib license"]),
    ("PSF-2.0", "PSF2", ["python software foundation license version 2", "psf license"]),
    ("Artistic-2.0", "Artistic2", ["artistic license 2.0", "artistic license version 2.0"]),
    ("EUPL-1.2", "EUPL12", ["european union public licence 1.2", "european union public license 1.2", "eupl 1.2"]),
    ("MS-PL", "MSPL", ["microsoft public license"]),
    ("NCSA", "NCSA", ["university of illinois ncsa open source license"]),
    ("OFL-1.1", "OFL11", ["sil open font license version 1.1", "sil open font license 1.1"]),
    ("ODbL-1.0", "ODbL1", ["open database license", "odbl 1.0"]),
    ("PostgreSQL", "PostgreSQL", ["postgresql license"]),
    ("Unlicense", "Unlicense", ["unlicense"]),
    ("WTFPL", "WTFPL", ["wtfpl"]),
    ("CC0-1.0", "CC0", ["cc0", "cc0 1.0", "cc0 1.0 universal public domain dedication"]),
    ("CC-BY-3.0", "CCBy3", ["cc by 3.0", "creative commons attribution 3.0 unported license"]),
    ("CC-BY-4.0", "CCBy4", ["cc by 4.0", "creative commons attribution 4.0 international license"]),
    ("CC-BY-SA-3.0", "CCBySa3", ["cc by sa 3.0", "creative commons attribution sharealike 3.0 unported license"]),
    ("CC-BY-SA-4.0", "CCBySa4", ["cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"]),
    ("CC-BY-ND-4.0", "CCByNd4", ["cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"]),
    ("CC-BY-NC-4.0", "CCByNc4", ["cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"]),
    ("CC-BY-NC-SA-4.0", "CCByNcSa4", ["cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0 international license"]),
    ("CC-BY-NC-ND-4.0", "CCByNcNd4", ["cc by nc nd 4.0", "creative commons attribution noncommercial noderivatives 4.0 international license"]),
]

#: Sentences that name a licence.
REFERENCES = [
    "licensed under {}", "licensed under the {}", "released under the {}", "distributed under the {}", "available under the {}", "made available under the {}", "published under the {}",
    "this software is released under the {}", "this software is licensed under the {}", "this project is licensed under the {}", "this work is licensed under the {}", "this work is licensed under a {}",
    "this file is licensed under the {}", "this program is licensed under the {}", "this code is licensed under the {}", "this library is licensed under the {}", "this package is licensed under the {}",
    "this project is released under the {}", "this content is licensed under {}", "license {}", "the {}",
]

#: GNU licences as (name, its stem, versions), the words that their headers use, and the headers.
GNU = [("gnu general public license", "GPL", ["2", "3"]), ("gnu library general public license", "LGPL", ["2"]), ("gnu lesser general public license", "LGPL", ["2.1", "3"]), ("gnu affero general public license", "AGPL", ["3"])]
GNU_NOUNS = ["program", "library", "software", "file"]
GNU_LATER = "{} you can redistribute it and or modify it under the terms of the {} as published by the free software foundation either version {} of the license or at your option any later version"
GNU_ONLY = ["{} you can redistribute it and or modify it under the terms of the {} version {} as published by the free software foundation", "{} you can redistribute it and or modify it under the terms of the {} version {} only as published by the free software foundation", "{} you can redistribute it and or modify it under the terms of the {} v{}"]
GNU_WARRANTY = "this {} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
GNU_SEE = "see the {} for more details"

#: The other normalised licence sentences and their identifiers.
SENTENCES = [
    ("licensed under the apache license version 2.0 the license", "ApacheGrant"),
    ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "ApacheGrantUse"),
    ("licensed to the apache software foundation asf under one or more contributor license agreements", "ApacheContributors"),
    ("the asf licenses this file to you under the apache license version 2.0 the license you may not use this file except in compliance with the license", "ApacheGrantUse"),
    ("you may not use this file except in compliance with the license", "ApacheUse"),
    ("you may obtain a copy of the license at", "ApacheCopy"),
    ("http www.apache.org licenses license 2.0", "ApacheUrl"),
    ("https www.apache.org licenses license 2.0", "ApacheUrl"),
    ("you may obtain a copy of the license at http www.apache.org licenses license 2.0", "ApacheCopyUrl"),
    ("you may obtain a copy of the license at https www.apache.org licenses license 2.0", "ApacheCopyUrl"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "ApacheWarranty"),
    ("see the license for the specific language governing permissions and limitations under the license", "ApacheLimits"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "MITGrant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "MITNotice"),
    ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software", "MITNotice"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "MITWarranty"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "MITLiability"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "MIT0Grant"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "ISCGrant"),
    ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "ISCGrant"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "ZeroBSDGrant"),
    ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "ISCWarranty"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "BSDGrant"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "BSDSource"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "BSDBinary"),
    ("all advertising materials mentioning features or use of this software must display the following acknowledgement", "BSDAdvertising"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDEndorse"),
    ("neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "BSDEndorse"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "BSDWarranty"),
    ("this software is provided as is without any express or implied warranty", "ZlibWarranty"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "ZlibGrant"),
    ("this source code form is subject to the terms of the mozilla public license v", "MPL2Grant"),
    ("the contents of this file are subject to the mozilla public license version 1.1 the license you may not use this file except in compliance with the license", "MPL11Grant"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", "MPL2Copy"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "MPL2Copy"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl v10.html", "EPL1Grant"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0", "EPL2Grant"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at", "EPL2Grant"),
    ("the contents of this file are subject to the terms of the common development and distribution license the license", "CDDL1Grant"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", "Boost1Grant"),
    ("this font software is licensed under the sil open font license version 1.1", "OFL11Grant"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "WTFPLGrant"),
    ("this is free and unencumbered software released into the public domain", "UnlicenseGrant"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "UnlicenseUse"),
]

#: Rules in order, each a licence name and the identifiers that follow one another. Full texts come before their parts.
RULES = [
    ("Apache-2.0", ["ApacheGrantUse", "ApacheCopy", "ApacheUrl", "ApacheWarranty", "ApacheLimits"]),
    ("Apache-2.0", ["ApacheGrantUse", "ApacheCopyUrl", "ApacheWarranty", "ApacheLimits"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopyUrl", "ApacheWarranty", "ApacheLimits"]),
    ("MIT", ["MITGrant", "MITNotice", "MITWarranty", "MITLiability"]),
    ("MIT", ["MITGrant", "MITNotice", "MITWarranty"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("MIT-0", ["MIT0Grant", "MITWarranty", "MITLiability"]),
    ("ISC", ["ISCGrant", "ISCWarranty"]),
    ("0BSD", ["ZeroBSDGrant", "ISCWarranty"]),
    ("BSD-4-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDAdvertising", "BSDEndorse"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("Zlib", ["ZlibWarranty", "ZlibGrant"]),
    ("MPL-2.0", ["MPL2Grant", "MPL2Copy"]),
    ("Unlicense", ["UnlicenseGrant", "UnlicenseUse"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse"]),
    ("Apache-2.0", ["ApacheGrantUse"]),
    ("Apache-2.0", ["ApacheGrant"]),
    ("MIT", ["MITGrant"]),
    ("MIT-0", ["MIT0Grant"]),
    ("ISC", ["ISCGrant"]),
    ("0BSD", ["ZeroBSDGrant"]),
    ("Zlib", ["ZlibGrant"]),
    ("MPL-2.0", ["MPL2Grant"]),
    ("MPL-1.1", ["MPL11Grant"]),
    ("EPL-1.0", ["EPL1Grant"]),
    ("EPL-2.0", ["EPL2Grant"]),
    ("CDDL-1.0", ["CDDL1Grant"]),
    ("BSL-1.0", ["Boost1Grant"]),
    ("OFL-1.1", ["OFL11Grant"]),
    ("WTFPL", ["WTFPLGrant"]),
    ("Unlicense", ["UnlicenseGrant"]),
]


def known_sentences() -> list[tuple[str, str]]:
    """All normalised sentences with their identifiers: those above, and what names and headers make by rule."""
    out = dict(SENTENCES)
    for name, stem, names in LICENSES:
        for n in names:
            out |= {r.format(n): f"{stem}Ref" for r in REFERENCES if r.format(n) not in out}
        out["spdx license identifier " + name.lower().replace("-", " ")] = f"{stem}Spdx"
    for v in ("2.0", "3.0"):  # the names before "only" and "or later" were told apart
        out[f"spdx license identifier gpl {v}"] = f"GPL{v[0]}Spdx"
    for name, stem, versions in GNU:
        out[GNU_SEE.format(name)] = f"{stem}See"
        for v in versions:
            short = stem + v.replace(".", "")
            for start in ("", *(f"this {noun} is free software" for noun in GNU_NOUNS)):
                out[GNU_LATER.format(start, name, v).strip()] = f"{short}LaterGrant"
                out |= {form.format(start, name, v).strip(): f"{short}Grant" for form in GNU_ONLY}
    out |= {GNU_WARRANTY.format(noun): "GNUWarranty" for noun in GNU_NOUNS}
    return list(out.items())


def known_rules() -> list[tuple[str, list[str]]]:
    """All rules in order: GNU headers whole, those above, GNU grants alone, names and SPDX lines."""
    whole, alone = [], []
    for name, stem, versions in GNU:
        for v in versions:
            short, number = stem + v.replace(".", ""), v if "." in v else f"{v}.0"
            for end, grant in (("or-later", f"{short}LaterGrant"), ("only", f"{short}Grant")):
                whole.append((f"{stem}-{number}-{end}", [grant, "GNUWarranty", f"{stem}See"]))
                alone.append((f"{stem}-{number}-{end}", [grant]))
    named = [(name, [stem + end]) for name, stem, _ in LICENSES for end in ("Ref", "Spdx")]
    return whole + RULES + alone + named


#: Comment marks at the start of a line are dropped. An SPDX line stands alone.
SPDX = "SPDX-License-Identifier"
MARKS = r"^[ \t*#/;]+"
SENTENCE_END = r"([.!?])[ \t]+"


def blocks(text: Column) -> Column:
    """Array of blocks of normalised pieces: small ASCII letters, digits and inner full stops, single spaces; pieces are parted by a carriage return.

    A block ends at a sentence's end, an empty line, or a line that ends like a sentence. Within it
    lines are pieces, whatever their width: a sentence may go on over any number of them, or be one.
    A line that starts with a small letter belongs to the piece before it, but for one after an SPDX line.
    """

    def joined(lines: Column) -> Column:
        def part(line: Column, i: Column) -> Column:
            before = F.rtrim(F.get(lines, i - 1))
            spdx = F.contains(before, F.lit(SPDX))
            ended = (before == "") | (line == "") | F.substring(before, -1, 1).isin(".", "!", "?")
            goes_on = F.substring(line, 1, 1).between("a", "z") & (before != "")
            return F.concat(F.when(i == 0, "").when(spdx, "\n").when(goes_on, " ").when(ended, "\n").otherwise("\r"), line)

        return F.array_join(F.transform(lines, part), "")

    bare = F.transform(F.split(F.translate(text.cast("string"), "\r", " "), "\n"), lambda x: F.regexp_replace(x, MARKS, ""))
    whole = F.regexp_replace(held_once(bare, joined), SENTENCE_END, "$1\n")
    plain = F.regexp_replace(F.lower(whole), r"[^a-z0-9.\n\r]+", " ")
    tidy = F.regexp_replace(F.regexp_replace(plain, r"[ .]*\r[ .\r]*", "\r"), r"[ .\r]*\n[ .\n\r]*", "\n")
    return F.split(F.regexp_replace(tidy, r"^[ .\r\n]+|[ .\r\n]+$", ""), "\n")


def _runs(pieces: Column, known: list[str]) -> Column:
    """Array of (first, last, sentence): the runs of a block's pieces that begin with two words of a known sentence and are no longer than the longest one."""
    starts = sorted({" ".join(k.split(" ")[:2]) for k in known})
    longest = max(map(len, known))

    def begins(i: Column) -> Column:
        return F.substring_index(F.concat_ws(" ", F.get(pieces, i), F.get(pieces, i + 1)), " ", 2).isin(starts)

    def run(i: Column, j: Column) -> Column:
        return F.struct(i.alias("first"), j.alias("last"), F.array_join(F.slice(pieces, i + 1, j - i + 1), " ").alias("sentence"))

    # Every piece has a letter at least, so that many of them hold the longest sentence.
    own = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), begins)
    runs = F.transform(own, lambda i: F.transform(F.sequence(i, F.least(F.size(pieces) - 1, i + longest // 2)), lambda j: F.when(F.aggregate(F.slice(pieces, i + 1, j - i + 1), F.lit(-1), lambda n, p: n + 1 + F.length(p)) <= longest, run(i, j))))
    return F.filter(F.flatten(runs), lambda r: r.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, identifiers, licenses, n_sentences) of every text with a known licence sentence.

    A sentence is a run of pieces (``blocks``) whose words are those of a known one; of runs that
    overlap the first counts, and of those that start together the longest. ``identifiers`` is the
    sequence in text order, ``licenses`` the matched rules' names in rule order, once each, and empty
    if sentences were known but no rule matched. The sentence table has a fixed size and is broadcast;
    only matched sentences are shuffled. Null and empty texts give no row; rows that repeat an id and
    a text are one; extra columns are ignored.
    """
    spark = docs.sparkSession
    table = known_sentences()
    known = F.broadcast(spark.createDataFrame(table, "sentence string, sid string"))
    names = [k for k, _ in table]
    starts = "|".join(sorted({re.escape(k.split(" ")[0]) for k in names}))
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.posexplode(blocks(F.col(text_col))).alias("block", "whole"))
    cut = cut.filter(F.col("whole").rlike(f"(?:^|\r)(?:{starts})(?: |\r)")).withColumn("pieces", F.split("whole", "\r"))
    met = cut.select("id", "h", "block", F.explode(_runs(F.col("pieces"), names)).alias("r")).select("id", "h", "block", "r.*").join(known, "sentence")
    found = met.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("block", "first", (-F.col("last")).alias("less"), "sid"))).alias("all"))
    none = F.struct(F.lit(-1).alias("block"), F.lit(-1).alias("last"), F.array().cast("array<string>").alias("sids"))

    def take(acc: Column, m: Column) -> Column:
        free = (m["block"] > acc["block"]) | (m["first"] > acc["last"])
        return F.when(free, F.struct(m["block"].alias("block"), (-m["less"]).alias("last"), F.array_append(acc["sids"], m["sid"]).alias("sids"))).otherwise(acc)

    found = found.withColumn("sids", F.aggregate("all", none, take)["sids"])
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("pattern")) for name, ids in known_rules()))
    start = F.struct(F.concat(F.lit("<"), F.array_join("sids", "><"), F.lit(">")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["pattern"])
        return F.struct(F.replace(acc["rest"], rule["pattern"], F.lit("<>")).alias("rest"), F.when(hit, F.array_union(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"))

    return found.select(F.col("id").alias(id_col), F.array_join("sids", ",").alias("identifiers"), F.array_join(F.aggregate(rules, start, step)["names"], ",").alias("licenses"), F.size("sids").cast("bigint").alias("n_sentences"))


def oracle_sql() -> str:
    """DuckDB twin of ``scan`` over documents, one step for each rule."""
    quoted = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences())
    rules = known_rules()
    longest = max(len(k) for k, _ in known_sentences())
    sql = f"""WITH RECURSIVE given AS (SELECT DISTINCT doc_id, text FROM documents),
bare AS (SELECT doc_id, text, [regexp_replace(x, '^[ \\t*#/;]+', '') FOR x IN string_split(translate(text, chr(13), ' '), chr(10))] AS l FROM given),
whole AS (SELECT doc_id, text, array_to_string([CASE WHEN i = 1 THEN '' WHEN contains(l[i - 1], '{SPDX}') THEN chr(10) WHEN x[1] BETWEEN 'a' AND 'z' AND rtrim(l[i - 1], ' ') <> '' THEN ' '
  WHEN x = '' OR rtrim(l[i - 1], ' ') = '' OR rtrim(l[i - 1], ' ')[-1] IN ('.', '!', '?') THEN chr(10) ELSE chr(13) END || x FOR x, i IN l], '') AS t FROM bare),
cut AS (
  SELECT doc_id, text, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(t,
    '([.!?])[ \\t]+', '\\1' || chr(10), 'g')), '[^a-z0-9.\\n\\r]+', ' ', 'g'), '[ .]*\\r[ .\\r]*', chr(13), 'g'), '[ .\\r]*\\n[ .\\n\\r]*', chr(10), 'g'), '^[ .\\r\\n]+|[ .\\r\\n]+$', '', 'g'), chr(10)) AS s FROM whole),
blocks AS (SELECT doc_id, text, string_split(unnest(s), chr(13)) AS p, generate_subscripts(s, 1) AS block FROM cut),
known(sentence, sid) AS (VALUES {quoted}),
firsts AS (SELECT DISTINCT split_part(sentence, ' ', 1) AS w FROM known),
begin AS (SELECT doc_id, text, block, p, unnest(range(1, len(p) + 1)) AS i FROM blocks),
runs AS (SELECT doc_id, text, block, i, unnest(range(i, least(len(p), i + {longest // 2}) + 1)) AS j, p FROM begin WHERE split_part(p[i], ' ', 1) IN (SELECT w FROM firsts)),
met AS (SELECT doc_id, text, sid, {{'block': block, 'i': i, 'less': -j}} AS m FROM runs JOIN known ON known.sentence = array_to_string(p[i : j], ' ')),
follow AS (SELECT a.doc_id, a.text, a.m, min(b.m) AS next FROM met a LEFT JOIN met b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND (b.m.block > a.m.block OR (b.m.block = a.m.block AND b.m.i > -a.m.less)) GROUP BY ALL),
kept AS (SELECT doc_id, text, min(m) AS m FROM met GROUP BY ALL UNION ALL SELECT k.doc_id, k.text, f.next FROM kept k JOIN follow f ON f.doc_id IS NOT DISTINCT FROM k.doc_id AND f.text = k.text AND f.m = k.m WHERE f.next IS NOT NULL),
s0 AS (SELECT doc_id, text, string_agg(sid, ',' ORDER BY m) AS identifiers, '<' || string_agg(sid, '><' ORDER BY m) || '>' AS rest,
  CAST([] AS VARCHAR[]) AS names, count(*) AS n FROM kept JOIN met USING (doc_id, text, m) GROUP BY doc_id, text)"""
    for k, (name, ids) in enumerate(rules):
        p = "".join(f"<{i}>" for i in ids)
        sql += f""",
s{k + 1} AS (SELECT doc_id, identifiers, replace(rest, '{p}', '<>') AS rest,
  CASE WHEN contains(rest, '{p}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names, n FROM s{k})"""
    return sql + f"\nSELECT doc_id, identifiers, array_to_string(names, ',') AS licenses, n AS n_sentences FROM s{len(rules)}"
