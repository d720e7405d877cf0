"""Licence scans by sentence rules: sentences become known identifiers, and their order selects licences.

A text's lines lose the marks that begin a comment, and blank lines, colons at a line's end and SPDX tags
end a paragraph. A paragraph is cut into sentences twice: with its lines joined, as licences come wrapped,
and line by line, as notices stand alone; the reading that knows more sentences counts, the joined one if
they tie. Sentences are normalised to lower-case words and looked up in a fixed table, as they are and in
a canonical form ("this project is released under the terms of X" is "licensed under X").

The sequence of identifiers, in the order of the text, is then matched against ordered rules: a rule
holds if its identifiers follow one another in the sequence, whatever stands between. A rule whose
identifiers are part of a longer rule's holds only where the longer one did not take them: the text of a
three-clause licence is no two-clause one.

All of it is one projection over the text: no shuffle, no Python, and nothing that grows with the data.
Texts without any of the words that known sentences have are passed over.

Nulls: a null or empty text has no sentences and no licences; a null doc_id is kept. Very long texts are
scanned whole. Repeated rows are scanned once each, repeated sentences counted each time. An empty table
gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

# Names of licence families and their versions; names without a version.
FAMILIES = {
    "Apache": (["1.1", "2.0"], ["apache license", "apache software license", "apache"]),
    "GPL": (["2.0", "3.0"], ["gnu general public license", "gnu gpl", "gpl"]),
    "LGPL": (["2.1", "3.0"], ["gnu lesser general public license", "gnu lgpl", "lgpl"]),
    "AGPL": (["3.0"], ["gnu affero general public license", "gnu agpl", "agpl"]),
    "MPL": (["1.1", "2.0"], ["mozilla public license", "mpl"]),
    "EPL": (["1.0", "2.0"], ["eclipse public license", "epl"]),
    "EUPL": (["1.2"], ["european union public licence", "eupl"]),
    "BSL": (["1.0"], ["boost software license"]),
    "CC-BY": (["2.0", "3.0", "4.0"], ["cc by", "creative commons attribution"]),
    "CC-BY-SA": (["2.0", "3.0", "4.0"], ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"]),
    "CC-BY-NC": (["2.0", "3.0", "4.0"], ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    "CC-BY-ND": (["2.0", "3.0", "4.0"], ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"]),
    "CC-BY-NC-SA": (["2.0", "3.0", "4.0"], ["cc by nc sa", "creative commons attribution noncommercial sharealike"]),
    "CC-BY-NC-ND": (["2.0", "3.0", "4.0"], ["cc by nc nd", "creative commons attribution noncommercial noderivatives"]),
    "CC0": (["1.0"], ["cc0"]),
    "ODbL": (["1.0"], ["open database license", "odbl"]),
}
UNVERSIONED = {
    "MIT": ["mit license", "mit", "expat license"],
    "ISC": ["isc license", "isc"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"],
    "0BSD": ["zero clause bsd license", "0bsd"],
    "Zlib": ["zlib license", "zlib"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
}

# Sentences of public licence notices, normalised, by identifier.
SENTENCES = {
    "apache-1.1": "licensed under the apache license version 1 1",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-the": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-2": "this work is licensed under the gnu general public license version 2",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-nc-3.0": "licensed under cc by nc 3 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc0": "licensed under cc0 1 0",
    "gpl-2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-2.1-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gnu-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gnu-library-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gnu-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-name-holders": "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-organization": "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl-2.0-form": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-origin": "the origin of this software must not be misrepresented",
}

# Fixed values: (licence, identifiers in their order).
RULES = [
    ("Apache-1.1", ["apache-1.1"]),
    ("Apache-2.0", ["apache-2.0"]),
    ("Apache-2.0", ["apache-2.0-the", "apache-use", "apache-copy", "apache-basis"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("GPL-2.0", ["gpl-2"]),
    ("GPL-3.0", ["gpl-3"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("CC-BY-4.0", ["cc-by-4.0"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0"]),
    ("CC-BY-NC-3.0", ["cc-by-nc-3.0"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0"]),
    ("CC0-1.0", ["cc0"]),
    ("Apache-2.0", ["apache-2.0-the"]),
    ("GPL-2.0-or-later", ["gpl-2-terms", "gnu-hope"]),
    ("GPL-3.0-or-later", ["gpl-3-terms", "gnu-hope"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-terms", "gnu-library-hope"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-terms", "gnu-hope"]),
    ("LGPL-3.0-or-later", ["lgpl-3-terms", "gnu-library-hope"]),
    ("LGPL-3.0-or-later", ["lgpl-3-terms", "gnu-hope"]),
    ("AGPL-3.0-or-later", ["agpl-3-terms", "gnu-hope"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name-holders"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name-organization"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name-university"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name-organization"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name-university"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant-and", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("MPL-2.0", ["mpl-2.0-form"]),
    ("Unlicense", ["unlicense-free"]),
    ("Zlib", ["zlib-asis", "zlib-liable", "zlib-origin"]),
]


#: What makes sentences that name a licence alike: pattern and replacement, one after another, on normalised words.
CANONICAL = [
    (r"^(this|the) (work|project|software|file|program|library|code|source code|package|module|repository|document|dataset|book|material|content) (is |are )?", ""),
    (r"^(dual )?(licensed|released|distributed|published|available|made available|provided) under (the terms of |the terms and conditions of )?(the |a |an )?", "licensed under "),
    (r" licence\b", " license"),
    (r" the license$", ""),
    (r" (international|unported|version)\b", ""),
    (r" v([0-9])", r" \1"),
    (r" (or any later|or at your option any later)$", " or later"),
    (r" license$", ""),
]


def _canonical_text(words: str) -> str:
    for old, new in CANONICAL:
        words = re.sub(old, new, words)
    return words


def _named() -> dict[str, list[str]]:
    """What "licensed under ..." may name: the names of each licence."""
    names = {k: [*v] for k, v in UNVERSIONED.items()}
    for family, (versions, called) in FAMILIES.items():
        for version in versions:
            spdx, ways = f"{family}-{version}", [version.replace(".", " "), *([version[:-2]] if version.endswith(".0") else [])]
            names[spdx] = [f"{c} {w}{e}" for c in called for w in ways for e in ("", " license")]
            if "GPL" in family:
                names |= {f"{spdx}-only": [f"{n} only" for n in names[spdx]], f"{spdx}-or-later": [f"{n} or later" for n in names[spdx]]}
    return names


def _table() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """All sentences by text, and all rules, those of names and SPDX tags among them."""
    known, rules = {text: i for i, text in SENTENCES.items()}, [*RULES]
    for spdx, names in _named().items():
        tag = f"spdx license identifier {spdx.lower().replace('-', ' ').replace('.', ' ')}"
        for sentence in (tag, *(_canonical_text(f"licensed under {n}") for n in names)):
            known.setdefault(sentence, f"named-{spdx}")
        rules.append((spdx, [f"named-{spdx}"]))
    order = list(dict.fromkeys(name for name, _ in rules))  # a licence's rules together
    return known, sorted(rules, key=lambda r: order.index(r[0]))


KNOWN, ALL_RULES = _table()
#: A character for each identifier, in which sequences are matched.
CODES = {i: chr(0x4E00 + n) for n, i in enumerate(dict.fromkeys(KNOWN.values()))}

#: Every known sentence, in whatever words, has one of these, or "under" and one of the others.
WORDS = ("licen", "spdx", "warrant", "permission", "permitted", "redistribut", "copyright", "unencumbered", "acknowledgement", "damages", "misrepresented", "prior written", "disclaims")
UNDER_WORDS = ("released", "distributed", "published", "available", "provided")
#: What may begin a line of a comment.
LEADER = r"^[ \t]*(//+|/?[*]+/?|#+|--+|;+|%+|>+|<!--)?[ \t]*"
SPDX = r"(?i)^spdx-license-identifier:[ \t]*"
#: A sentence ends at a mark before white space; where lines are read one by one, at a line's end too.
SENTENCE_END = r"[.!?;:][ \t\n]|[.!?;:]\z"
LINE_END = rf"\n|{SENTENCE_END}"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def canonical(sentence: Column) -> Column:
    """A normalised sentence without a lead-in, and with one way to say that something is licensed."""
    for old, new in CANONICAL:
        sentence = F.regexp_replace(sentence, old, new.replace("\\", "$"))
    return sentence


def _known(sentences: Column, table: Column) -> Column:
    found = F.transform(sentences, lambda s: F.coalesce(F.element_at(table, normalised(s)), F.element_at(table, canonical(normalised(s)))))
    return F.filter(found, lambda x: x.isNotNull())


def paragraphs(text: Column) -> Column:
    def read(line: Column) -> Column:
        bare = F.regexp_replace(line, LEADER, "")
        tagged = F.regexp_replace(F.regexp_replace(bare, SPDX, "\nspdx license identifier "), " +(OR|AND|WITH) +", "\n\nspdx license identifier ")
        return F.when(bare.rlike(SPDX), F.concat(tagged, F.lit("\n"))).otherwise(bare)

    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), read)
    return F.split(F.replace(F.array_join(lines, "\n"), F.lit(":\n"), F.lit(":\n\n")), "\n\n+")


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """The identifiers of the known sentences of a text, in its order."""
    table = F.create_map(*(F.lit(x) for pair in (known or KNOWN).items() for x in pair))

    def read(paragraph: Column) -> Column:
        joined = _known(F.split(F.replace(paragraph, F.lit("\n"), F.lit(" ")), SENTENCE_END), table)
        apart = _known(F.split(paragraph, LINE_END), table)
        return F.when(F.size(joined) >= F.size(apart), joined).otherwise(apart)

    return F.when(may_hold(text), F.flatten(F.transform(paragraphs(text), read))).otherwise(F.array().cast("array<string>"))


def may_hold(text: Column) -> Column:
    """Whether a text has a word that every known sentence has: plain searches, far cheaper than a pattern."""

    def has(low: Column) -> Column:
        any_of = lambda words: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words))
        return any_of(WORDS) | F.contains(low, F.lit("under")) & any_of(UNDER_WORDS)

    return F.exists(F.array(F.lower(text)), has)  # lower case once


def pattern(of: list[str], tight: bool = False) -> str:
    """A rule over coded identifiers. ``tight``: as few as can be between them, and not its first again."""
    codes = [CODES[i] for i in of]
    return (f"[^{codes[0]}]*?" if tight else ".*").join(codes)


def is_part(a: list[str], b: list[str]) -> bool:
    """Whether a's identifiers are some of b's, in its order."""
    rest = iter(b)
    return len(a) < len(b) and all(x in rest for x in a)


def taken_first(name: str, of: list[str], rules: list[tuple[str, list[str]]]) -> list[str]:
    """Tight patterns of the longer rules of other licences that this rule is part of, longest first."""
    return [pattern(b, tight=True) for other, b in sorted(rules, key=lambda r: -len(r[1])) if other != name and is_part(of, b)]


def licenses_of(ids: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """The licences whose rules hold, in the order of the table, each once."""
    rules = ALL_RULES if rules is None else rules
    coded = F.array_join(F.transform(ids, lambda i: F.element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), i)), "")

    def held(sequence: Column) -> Column:
        found = []
        for name, of in rules:
            rest = sequence
            for longer in taken_first(name, of, rules):
                rest = F.regexp_replace(rest, longer, "")
            found.append(F.when(F.contains(rest, F.lit(CODES[of[0]])) if len(of) == 1 else rest.rlike(pattern(of)), F.lit(name)))
        return F.array_distinct(F.array_compact(F.array(*found)))

    return F.when(F.size(ids) > 0, F.transform(F.array(coded), held)[0]).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licenses (arrays) of each row."""
    none = F.array().cast("array<string>")
    ids = only(docs, "doc_id", "text").select("doc_id", F.coalesce(sentence_ids(F.col("text")), none).alias("sentence_ids"))
    return ids.withColumn("licenses", licenses_of(F.col("sentence_ids")))
