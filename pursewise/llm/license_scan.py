"""License scans: Dice coefficient over word bigrams against licence templates (operator 6).

Units of a document are its lines, its paragraphs (separated by an empty line) and the whole
text. A unit is normalised (A-Z lower-cased, everything but a-z and 0-9 becomes one space)
and its distinct word bigrams are compared with each template's. Dice of sets A and B is
2|A n B| / (|A| + |B|), so a score of t needs t/(2-t) |B| <= |A| <= (2-t)/t |B|: units outside
every template's bounds are never cut into bigrams, and the others meet only the templates
whose bounds they are in.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.llm.common import ascii_lower, bound

#: Lowest Dice coefficient, in percent.
MIN_DICE = 80

# Notices of public licences as their texts and SPDX's notes give them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _tables() -> list[tuple[str, list[str], int, int, int]]:
    """(id, bigrams, their number, fewest and most bigrams of a unit that can reach the score)."""
    out = []
    for name, text in TEMPLATES.items():
        grams = bigrams(normal_words(text))
        n = len(grams)
        out.append((name, grams, n, -(-MIN_DICE * n // (200 - MIN_DICE)), (200 - MIN_DICE) * n // MIN_DICE))
    return out


def _normal(unit: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(unit), "[^a-z0-9]+", " "))


def _units(text: Column) -> Column:
    """Distinct normalised units: lines, paragraphs, the whole text."""
    parts = F.concat(F.split(text, "\n"), F.split(text, "\n\\s*\n"), F.array(text))
    return F.array_distinct(F.transform(parts, _normal))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, unit, license_id, dice (percent, double): every unit and template that reach MIN_DICE.

    Units and templates are compared in the row; the templates are a constant of the plan.
    """
    tables = _tables()
    units = (docs.where("text is not null").select("doc_id", F.explode(_units(F.col("text"))).alias("unit"))
             .where((F.length("unit") > 2) & (F.length("unit") - F.length(F.translate("unit", " ", "")) >= 1)))
    templates = F.array(*[F.struct(F.lit(n).alias("id"), F.array(*map(F.lit, g)).alias("grams"), F.lit(k).alias("n"),
                                   F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, g, k, lo, hi in tables])

    def scored(g: Column) -> Column:
        fits = F.filter(templates, lambda t: F.size(g).between(t["lo"], t["hi"]))
        dice = F.transform(fits, lambda t: F.struct(t["id"].alias("id"), F.size(F.array_intersect(g, t["grams"])).alias("both"),
                                                    (F.size(g) + t["n"]).alias("all")))
        return F.filter(dice, lambda d: 200 * d["both"] >= MIN_DICE * d["all"])

    def grams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2),
                                            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))

    hits = bound(bound(F.split("unit", " "), grams), scored)
    return (units.select("doc_id", "unit", F.explode(hits).alias("hit"))
            .select("doc_id", "unit", F.col("hit.id").alias("license_id"), (200.0 * F.col("hit.both") / F.col("hit.all")).alias("dice")))


def licenses(docs: DataFrame) -> DataFrame:
    """Per document and licence found: doc_id, license_id, dice (best unit's percent, rounded
    to 4 places), n_units (distinct units that reach the score).

    A unit counts for its best template only (ties: the first id). Null and empty texts and
    documents without a licence have no row; repeated rows of a document count once; a null
    doc_id is a document of its own; an empty table gives no rows; other columns are ignored.
    """
    hits = matches(docs)
    best = hits.groupBy("doc_id", "unit").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license_id")).alias("b"))
    return (best.groupBy("doc_id", F.col("b.license_id").alias("license_id"))
            .agg(F.round(-F.min("b.d"), 4).alias("dice"), F.count(F.lit(1)).alias("n_units")))


def _oracle() -> str:
    rows = ",\n".join(f"('{n}', {k}, [{', '.join(repr(x) for x in g)}])" for n, g, k, _, _ in _tables())
    return rf"""
with t(id, n, grams) as (values {rows}),
tg as (select id, n, unnest(grams) as g from t),
d as (select doc_id, text from documents where text is not null),
parts as (select doc_id, unnest(string_split(text, chr(10))) as p from d
  union all select doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) as p from d union all select doc_id, text from d),
u as (select distinct doc_id, trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^a-z0-9]+', ' ', 'g')) as unit from parts),
w as (select doc_id, unit, string_split(unit, ' ') as ws from u),
g as (select distinct doc_id, unit, ws[i] || ' ' || ws[i + 1] as g
      from (select doc_id, unit, ws, unnest(generate_series(1, len(ws) - 1)) as i from w where len(ws) >= 2)),
c as (select doc_id, unit, count(*) as n from g group by doc_id, unit),
x as (select g.doc_id, g.unit, tg.id, tg.n, count(*) as shared from g join tg on g.g = tg.g group by all),
s as (select x.doc_id, x.unit, x.id, 200.0::double * x.shared / (c.n + x.n) as dice from x
      join c on x.doc_id is not distinct from c.doc_id and x.unit = c.unit where 200 * x.shared >= {MIN_DICE} * (c.n + x.n)),
b as (select *, row_number() over (partition by doc_id, unit order by dice desc, id) as k from s)
select doc_id, id as license_id, round(max(dice), 4) as dice, count(*) as n_units from b where k = 1 group by doc_id, id
"""


ORACLE = _oracle()
