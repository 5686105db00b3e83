"""Licence scan by sentence rules.

A text is cut into sentences: they end at marks and at blank lines, and run over single line feeds, so
wrapped licence texts are told as well. Each is normalised (lower case, letters, digits and dots inside
numbers, single spaces; comment leaders and list marks go with the rest) and looked up among known licence
sentences. Where a run of lines is unknown as a whole, its known lines (titles, notices) are
taken out and what stands between them is tried again. The sequence of identifiers that comes out
is matched against ordered rules: the first rule that fits a place takes its identifiers, so a full text is
told before the short notices it contains. Spark expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Licence texts and notices as published, in the rules' order: (rule, licence, text). A text is
#: cut into sentences as any other, so its rule is the sequence of these.
TEXTS: list[tuple[str, str, str]] = [
    ("mit_text", "MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd3_text", "BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("bsd2_text", "BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("apache2_header", "Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at:"""),
    ("lgpl3_header", "LGPL-3.0-or-later", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl21_header", "LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl3_header", "AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl3_header", "GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl2_header", "GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("isc_text", "ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd0_text", "0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""),
    ("bsl1_text", "BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("zlib_text", "Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."""),
    ("mpl2_header", "MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""),
    ("mpl2_form", "MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("epl2_header", "EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"""),
    ("unlicense_text", "Unlicense", """This is free and unencumbered software released into the public domain."""),
    ("wtfpl_text", "WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"""),
    ("reserved_work", "Proprietary", """All rights reserved. No part of this work may be reproduced without permission."""),
]
#: Short notices and titles: (rule, licence, sentences of which each is the rule's).
NOTICES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit_notice", "MIT", ("released under the MIT license", "licensed under the MIT license", "this project is licensed under the MIT license", "this software is released under the MIT license", "distributed under the MIT license")),
    ("apache2_notice", "Apache-2.0", ("licensed under the Apache License, Version 2.0", "licensed under the Apache License, Version 2.0 (the License)", "released under the Apache License, Version 2.0", "distributed under the Apache License, Version 2.0")),
    ("gpl3_notice", "GPL-3.0-only", ("this work is licensed under the GNU General Public License version 3", "licensed under the GNU General Public License version 3", "released under the GNU General Public License version 3")),
    ("gpl2_notice", "GPL-2.0-only", ("this work is licensed under the GNU General Public License version 2", "licensed under the GNU General Public License version 2", "released under the GNU General Public License version 2")),
    ("lgpl3_notice", "LGPL-3.0-only", ("licensed under the GNU Lesser General Public License version 3", "released under the GNU Lesser General Public License version 3")),
    ("lgpl21_notice", "LGPL-2.1-only", ("licensed under the GNU Lesser General Public License version 2.1", "released under the GNU Lesser General Public License version 2.1")),
    ("agpl3_notice", "AGPL-3.0-only", ("licensed under the GNU Affero General Public License version 3", "released under the GNU Affero General Public License version 3")),
    ("bsd2_notice", "BSD-2-Clause", ("licensed under the BSD 2-Clause license", "released under the BSD 2-Clause license")),
    ("bsd3_notice", "BSD-3-Clause", ("licensed under the BSD 3-Clause license", "released under the BSD 3-Clause license")),
    ("mpl2_notice", "MPL-2.0", ("licensed under the Mozilla Public License, Version 2.0", "released under the Mozilla Public License, Version 2.0")),
    ("epl2_notice", "EPL-2.0", ("licensed under the Eclipse Public License 2.0", "licensed under the Eclipse Public License, Version 2.0")),
    ("isc_notice", "ISC", ("licensed under the ISC license", "released under the ISC license")),
    ("ccby4_notice", "CC-BY-4.0", ("licensed under CC BY 4.0", "this work is licensed under CC BY 4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License")),
    ("ccbysa4_notice", "CC-BY-SA-4.0", ("licensed under CC BY-SA 4.0", "this work is licensed under CC BY-SA 4.0", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("ccbync4_notice", "CC-BY-NC-4.0", ("licensed under CC BY-NC 4.0", "this work is licensed under CC BY-NC 4.0", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("ccbynd4_notice", "CC-BY-ND-4.0", ("licensed under CC BY-ND 4.0", "this work is licensed under CC BY-ND 4.0", "this work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("cc0_notice", "CC0-1.0", ("released under CC0 1.0", "licensed under CC0 1.0", "this work is released under CC0 1.0")),
    ("mit_title", "MIT", ("the MIT license", "MIT license", "the MIT license (MIT)")),
    ("apache2_title", "Apache-2.0", ("Apache License, Version 2.0", "Apache License Version 2.0, January 2004")),
    ("gpl3_title", "GPL-3.0-only", ("GNU General Public License version 3", "GNU General Public License version 3, 29 June 2007")),
    ("reserved", "Proprietary", ("all rights reserved",)),
]
#: Sentences that stand beside licences and that no rule needs.
SIDE = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "See the License for the specific language governing permissions and limitations under the License",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "See the GNU General Public License for more details",
    "No part of this work may be reproduced without permission",
)
#: Licences that a notice or a tag may name, by SPDX identifier, with other names of theirs. An identifier is a name itself.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT X11", "X11 MIT", "Expat"),
    "Apache-2.0": ("Apache 2", "Apache License 2.0", "Apache License 2", "Apache License Version 2.0", "Apache Software License 2.0", "Apache v2", "Apache License v2.0", "ASL 2.0"),
    "BSD-2-Clause": ("2 clause BSD", "simplified BSD", "FreeBSD"),
    "BSD-3-Clause": ("3 clause BSD", "new BSD", "modified BSD", "revised BSD"),
    "ISC": (),
    "Zlib": (),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License Version 1.0"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "MPL 2", "MPLv2"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License Version 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0-only": ("GPL 2.0", "GPL 2", "GPLv2", "GPL v2", "GNU GPL v2", "GNU GPLv2", "GNU General Public License v2.0", "GNU General Public License Version 2"),
    "GPL-2.0-or-later": ("GPL 2.0+", "GPLv2+", "GPLv2 or later", "GNU General Public License Version 2 or later"),
    "GPL-3.0-only": ("GPL 3.0", "GPL 3", "GPLv3", "GPL v3", "GNU GPL v3", "GNU GPLv3", "GNU General Public License v3.0", "GNU General Public License Version 3"),
    "GPL-3.0-or-later": ("GPLv3 or later", "GNU General Public License Version 3 or later"),
    "LGPL-2.1-only": ("LGPL 2.1", "LGPLv2.1", "GNU LGPL v2.1", "GNU Lesser General Public License Version 2.1"),
    "LGPL-2.1-or-later": ("LGPLv2.1 or later",),
    "LGPL-3.0-only": ("LGPL 3.0", "LGPL 3", "LGPLv3", "LGPL v3", "GNU LGPL v3", "GNU Lesser General Public License Version 3"),
    "LGPL-3.0-or-later": ("LGPLv3 or later",),
    "AGPL-3.0-only": ("AGPL 3.0", "AGPL 3", "AGPLv3", "AGPL v3", "GNU AGPL v3", "GNU AGPLv3", "GNU Affero General Public License Version 3"),
    "AGPL-3.0-or-later": ("AGPLv3 or later",),
    "CC0-1.0": ("CC0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution ShareAlike 4.0 International",),
    "Unlicense": (),
    "0BSD": ("BSD Zero Clause",),
    "WTFPL": (),
}
#: So many unknown sentences in a row part what stands before from what follows: no rule reaches over them.
GAP = 6
#: A tag before a licence's name, and what it becomes; a sentence with a slot for names (normalised).
_TAG, _TAGGED = "(?i)\\b(?:spdx-license-identifier|licen[sc]e)[ \\t]*:[ \\t]+([^\\n]*)", "licensetag "
_SLOT = "^(?:licensetag|(?:[^ ]+ ){0,8}?(?:dual |double )?(?:licensed|released|distributed|available|published|provided) under) (?:the )?(?:terms of )?(?:the )?(.+?)(?: licen[sc]es?)?(?: (?:see|found in) .*)?$"
#: What ends a sentence gets a _CUT: copyright lines, marks before white space or the end, lines without letters or digits.
_CUT, _LINE = "\x02", "\x03"
_COPYRIGHT = "((?i)(?:^|\\n)[^\\p{L}\\p{N}\\n]*copyright *(?:\\(c\\)|\u00a9|\\[?[0-9]{4}|\\[year)[^\\n]*)"
_ENDS = ("[.;:!?]+([ \\t\\r\\n]|\\z)", "\\n[^\\p{L}\\p{N}\\n]*\\n")
#: Each known sentence, and each copyright line that stands before one, has one of these; other texts need no look.
_HINTS = "(?i)licen[sc]e|permission|warrant|redistribut|rights reserved|free software|unencumbered|as-is|liable|eclipse public|mozilla public|(?:released|distributed|available|published|provided) under"


def normalised(sentence: str) -> str:
    """What the expressions below make of a sentence, for the known ones."""
    kept = re.sub("([0-9])\\.([0-9])", "\\1\x01\\2", sentence.lower())
    return re.sub(r"[^\w\x01]+|_+", " ", kept).strip().replace("\x01", ".")


def sentences(text: str) -> list[str]:
    """Normalised sentences of a text in which each line ends one."""
    parts = re.split(r"[.;:!?]+(?=\s|\Z)|\n", text)
    return [x for x in map(normalised, parts) if x]


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...], str]]]:
    """Identifiers of the known sentences, and the ordered rules: (name, sequence of identifiers, licence)."""
    ids: dict[str, str] = {}
    for rule, _, known in NOTICES:
        for s in known:
            ids.setdefault(normalised(s), rule)
    for rule, _, text in TEXTS:
        for k, s in enumerate(sentences(text), 1):
            ids.setdefault(s, f"{rule}.{k}")
    for k, s in enumerate(SIDE, 1):
        ids.setdefault(normalised(s), f"side.{k}")
    rules = [(rule, tuple(ids[s] for s in sentences(text)), licence) for rule, licence, text in TEXTS]
    return ids, rules + [(rule, (rule,), licence) for rule, licence, _ in NOTICES]


SENTENCES, RULES = _tables()


def _aliases() -> dict[str, str]:
    """SPDX identifier by normalised name; in names, or later is one word, so that or parts names."""
    return {normalised(n).replace(" or later", " orlater"): spdx for spdx, others in NAMES.items() for n in (spdx, *others)}


ALIASES = _aliases()
NAME_RULES = [(f"name.{spdx}", (f"name.{spdx}",), spdx) for spdx in NAMES]
_NONE = "?"


def _norm(s: Column) -> Column:
    """Lower case; a dot between two digits stays, all else but letters and digits becomes a space."""
    dots = F.regexp_replace(F.lower(s), "([0-9])\\.([0-9])", "$1\x01$2")
    return F.trim(F.translate(F.regexp_replace(dots, "[^\\p{L}\\p{N}\\x01]+", " "), "\x01", "."))


def _named(sentence: Column) -> Column:
    """Identifiers of the licences that a sentence with a slot names, or the mark of an unknown sentence. In an expression
    (or, and, with) names that aren't known are passed over."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    slot = F.regexp_replace(F.regexp_extract(sentence, _SLOT, 1), " or (?:any )?later(?: version)?", " orlater")
    parts = F.transform(F.split(slot, " (?:or|and|with) "), lambda x: F.regexp_replace(x, "^the | licen[sc]es?$", ""))
    found = F.transform(F.filter(parts, lambda x: x.isin(list(ALIASES))), lambda x: F.concat(F.lit("name."), F.element_at(names, x)))
    hit = F.contains(sentence, F.lit(" under ")) | sentence.startswith(_TAGGED)
    return F.when(hit & (F.size(found) > 0), found).otherwise(F.array(F.lit(_NONE)))


def _identifiers(text: str) -> Column:
    """Identifiers of the text's sentences, in order; _NONE for each that isn't known."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    known = lambda s: s.isin(list(SENTENCES))
    marked = F.regexp_replace(F.regexp_replace(t, _COPYRIGHT, "$1" + _CUT), _TAG, _CUT + _TAGGED + "$1" + _CUT)
    for ends in _ENDS:
        marked = F.regexp_replace(marked, ends, _CUT)

    def apart(piece: Column) -> Column:
        """A piece whose known lines stand alone, between _LINE; as it is if it is known or one line."""
        own = F.transform(F.split(piece, "\n", -1), lambda x: F.when(known(_norm(x)), F.concat(F.lit(_LINE), x, F.lit(_LINE))).otherwise(x))
        return F.when(~F.contains(piece, F.lit("\n")) | known(_norm(piece)), piece).otherwise(F.array_join(own, "\n"))

    pieces = F.flatten(F.transform(F.split(marked, _CUT, -1), lambda p: F.split(apart(p), _LINE, -1)))
    each = F.filter(F.transform(pieces, _norm), lambda s: s != "")
    ids = F.flatten(F.transform(each, lambda s: F.when(known(s), F.array(F.element_at(names, s))).otherwise(_named(s))))
    return F.when(t.rlike(_HINTS), ids).otherwise(F.array().cast("array<string>"))


def license_scan(df: DataFrame, text: str = "text", rules=RULES + NAME_RULES) -> DataFrame:
    """df without its text, with sentence_ids, rule_ids, licenses (distinct, sorted) and n_unmatched.

    sentence_ids has the known sentences in the text's order, wrapped over lines or not; a sentence with a slot (licensed under X,
    License: X, SPDX-License-Identifier: X OR Y) has one of each licence it names. Rules are tried in their order on the
    sequence; one that fits takes all the stretches it fits, which later rules no longer see; none reaches over GAP unknown sentences.
    n_unmatched is how many known sentences no rule took. Null and empty texts have empty arrays. Rows
    are independent, so repeated rows repeat their result. Columns of df with the new names, or named
    _ids or _m, are replaced.
    """
    keep = [c for c in df.columns if c not in (text, "sentence_ids", "rule_ids", "licenses", "n_unmatched", "_ids", "_m")]
    out = df.withColumn("_ids", _identifiers(text)).select(*keep, "_ids")
    some = F.filter("_ids", lambda x: x != _NONE)
    whole = F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">"))
    parted = F.replace(F.regexp_replace(whole, f"(?:<[{_NONE}]>){{{GAP},}}", "<gap>"), F.lit(f"<{_NONE}>"), F.lit(""))
    table_ = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit("<" + "><".join(ids) + ">").alias("ids"), F.lit(lic).alias("license")) for name, ids, lic in rules])
    none = F.array().cast("array<struct<rule:string,license:string>>")

    def step(s: Column, r: Column) -> Column:
        hit = F.contains(s["left"], r["ids"])
        fired = F.when(hit, F.array_append(s["fired"], F.struct(r["rule"].alias("rule"), r["license"].alias("license")))).otherwise(s["fired"])
        return F.struct(F.replace(s["left"], r["ids"], F.lit("|")).alias("left"), fired.alias("fired"))

    state = F.struct(parted.alias("left"), none.alias("fired"))
    empty = F.struct(F.lit("").alias("left"), none.alias("fired"))
    out = out.withColumn("_m", F.when(F.size(some) > 0, F.aggregate(table_, state, step)).otherwise(empty))
    return out.select(
        *keep,
        some.alias("sentence_ids"),
        F.col("_m.fired.rule").alias("rule_ids"),
        F.array_sort(F.array_distinct("_m.fired.license")).alias("licenses"),
        F.regexp_count("_m.left", F.lit("<[^g]|<g[^a]")).cast("long").alias("n_unmatched"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", joined("sentence_ids"), joined("rule_ids"), joined("licenses"), "n_unmatched")


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    all_ = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
    steps, last = [], "n"
    for k, (_, ids, _lic) in enumerate(RULES + NAME_RULES):
        pattern = "<" + "><".join(ids) + ">"
        steps.append(f"r{k} AS (SELECT * REPLACE (replace(\"left\", '{pattern}', '|') AS \"left\"), contains(\"left\", '{pattern}') AS f{k} FROM {last})")
        last = f"r{k}"
    fired = lambda k: "list_filter([" + ", ".join(f"CASE WHEN f{i} THEN '{r[k]}' END" for i, r in enumerate(RULES)) + "], lambda x: x IS NOT NULL)"
    norm = lambda x: f"trim(replace(regexp_replace(regexp_replace(lower({x}), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[^\\p{{L}}\\p{{N}}\\x01]+', ' ', 'g'), chr(1), '.'))"
    marked = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_COPYRIGHT}', '\\1' || chr(2), 'g'), '{_TAG}', chr(2) || '{_TAGGED}\\1' || chr(2), 'g')"
    alias = ", ".join(f"('{n}', 'name.{i}')" for n, i in ALIASES.items())
    for ends in _ENDS:
        marked = f"regexp_replace({marked}, '{ends}', chr(2), 'g')"
    own = f"list_transform(string_split(p, chr(10)), lambda x: CASE WHEN list_contains({all_}, {norm('x')}) THEN chr(3) || x || chr(3) ELSE x END)"
    return f"""
WITH known(s, id) AS (VALUES {known}), alias(s, id) AS (VALUES {alias}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, i, l[i] AS p FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, string_split({marked}, chr(2)) AS l FROM d))),
o AS (SELECT r, i, string_split(CASE WHEN NOT contains(p, chr(10)) OR {norm('p')} IN (SELECT s FROM known) THEN p ELSE array_to_string({own}, chr(10)) END, chr(3)) AS l FROM p),
x AS (SELECT r, i, j, {norm('l[j]')} AS s FROM (SELECT r, i, l, unnest(range(1, len(l) + 1)) AS j FROM o)),
e AS (SELECT x.*, id FROM x LEFT JOIN known USING (s) WHERE s <> ''),
w AS (SELECT r, i, j, unnest(l) AS p, unnest(range(len(l))) AS k FROM (SELECT r, i, j, string_split_regex(regexp_replace(regexp_extract(s, '{_SLOT}', 1), ' or (?:any )?later(?: version)?', ' orlater', 'g'), ' (?:or|and|with) ') AS l
  FROM e WHERE id IS NULL AND (contains(s, ' under ') OR starts_with(s, '{_TAGGED}')))),
v AS (SELECT r, i, j, k, alias.id FROM w JOIN alias ON alias.s = regexp_replace(p, '^the | licen[sc]es?$', '', 'g')),
y AS (SELECT r, i, j, 0 AS k, id FROM e WHERE id IS NOT NULL UNION ALL SELECT * FROM v UNION ALL SELECT r, i, j, 0, '{_NONE}' FROM e WHERE id IS NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.r = e.r AND v.i = e.i AND v.j = e.j)),
q AS (SELECT r, list(id ORDER BY i, j, k) AS ids FROM y JOIN d USING (r) WHERE regexp_matches(coalesce(text, ''), '{_HINTS}') GROUP BY r),
n AS (SELECT doc_id, list_filter(coalesce(ids, []), lambda x: x <> '{_NONE}') AS ids, CASE WHEN len(list_filter(coalesce(ids, []), lambda x: x <> '{_NONE}')) = 0 THEN ''
  ELSE replace(regexp_replace('<' || array_to_string(ids, '><') || '>', '(?:<[{_NONE}]>){{{GAP},}}', '<gap>', 'g'), '<{_NONE}>', '') END AS "left" FROM d LEFT JOIN q USING (r)),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string({fired(0)}, ',') AS rule_ids, array_to_string(list_sort(list_distinct({fired(2)})), ',') AS licenses,
       len(regexp_extract_all("left", '<[^g]|<g[^a]')) AS n_unmatched FROM {last}"""


QUERIES = {"op7_license_scan": op7_license_scan}
SQL = {"op7_license_scan": _sql()}
