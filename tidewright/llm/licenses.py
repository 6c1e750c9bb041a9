r"""Licence scan: normalised sentences become licence-sentence identifiers, identifier sequences are matched to ordered rules.

1. A text becomes one normalised line: lower case, comment marks and list numbers at line starts dropped, everything but
   letters, digits and inner dots one blank, so layout and quotes do not matter. Marks stay in it: hard ones behind `. ` (not
   `v. `) and at the end of a paragraph, soft ones at other line ends and behind `; ` and `: `.
2. A sentence stands between two marks. It may run over soft marks, so wrapped notices are found whole, but over no hard one.
3. Sentences are looked up among the licence sentences (some with a wildcard: a pattern for the whole
   sentence, whose open end stops at the first mark); a hit gives an identifier such as `GPL` or `GPLv3`.
4. Rules are tried in order on the identifiers that are left, each a sequence of identifiers that must stand together in the
   text's order of hits. A rule that fits adds its licence and consumes those identifiers, so `GPL` followed by
   `AnyLater` gives GPL-2.0-or-later and is not seen again by the rule for GPL-2.0-only.

All of it is one projection of built-in functions: no shuffle, one row in, one row out, however long the text is.

Cases: null or empty text has no hit (n_sentences 0, no licences). A licence named twice is listed once, and n_rules counts
both. Other columns pass through untouched unless their names are those of the results, which are replaced.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences after normalisation: identifier, pattern of the whole sentence. Order matters: the first that fits wins.
SENTENCES: list[tuple[str, str]] = [
    ("Apache20", r"licensed under the apache license version 2\.0( the license)?"),
    ("ApacheFull", r"you may not use this file except in compliance with the license"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("MITNamed", r"(released|licensed|distributed) under the (terms of the )?mit license"),
    ("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", r"the software is provided as is without warranty of any kind.*"),
    ("GPL3Named", r"this work is licensed under the gnu general public license version 3"),
    ("GPL3Later", r"this (program|work|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license.* version 3.* or at your option any later version"),
    ("GPL2Later", r"this (program|work|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license.* version 2.* or at your option any later version"),
    ("GPL2Named", r"(this work is )?licensed under the gnu general public license version 2"),
    ("AnyLater", r"or at your option any later version"),
    ("LGPLNamed", r".*licensed under the gnu lesser general public license version (2\.1|3)"),
    ("AGPLNamed", r".*licensed under the gnu affero general public license version 3"),
    ("NoWarranty", r"this (program|work|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("BSDGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDSource", r"redistributions of source code must retain the above copyright notice.*"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", r"neither the name of .* may be used to endorse or promote products derived from this software.*"),
    ("MPL20", r"this source code form is subject to the terms of the mozilla public license v\. 2\.0"),
    ("CCBYNC4", r"licensed under cc by nc 4\.0"),
    ("CCBYSA4", r"licensed under cc by sa 4\.0"),
    ("CCBY4", r"licensed under cc by 4\.0"),
    ("CC0", r".*cc0 1\.0 universal( license)?.*"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("Proprietary", r"all rights reserved( worldwide)?"),
    ("LGPLLater", r"this (program|work|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.* version (2|2\.1|3)( of the license)?( or at your option any later version)?"),
    ("AGPL3Later", r"this (program|work|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license.* version 3( of the license)?( or at your option any later version)?"),
    ("GPL2Only", r"this (program|work|library|file|software) is free software you can redistribute it and or modify it under the terms of (the gnu general public license version 2|version 2 of the gnu general public license)( only)? as published by the free software foundation"),
    ("ISCGrant", r"permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSDGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCAsIs", r"the software is provided as is and the author disclaims all warranties.*"),
    ("ZlibAsIs", r"this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("EPL20", r"this program and the accompanying materials are made available under the terms of the eclipse public license (v|v\. |version )?2\.0.*"),
    ("EPL10", r"this program and the accompanying materials are made available under the terms of the eclipse public license (v|v\. |version )?1\.0.*"),
    ("Boost", r"(use modification and distribution are subject to|distributed under) the boost software license version 1\.0"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("SPDX", r"spdx license identifier [a-z0-9. ]+"),
]
#: Names of licences as sentences write them behind `licensed under the`; each holds the word license.
NAMES: list[tuple[str, str]] = [
    ("MITNamed", r"mit (open source )?license"),
    ("Apache20", r"apache (software )?(2\.0 license|license (version |v)?2\.0)"),
    ("BSD3Named", r"((new|modified) bsd|bsd 3 clause|3 clause bsd) license"),
    ("BSD2Named", r"(simplified bsd|bsd 2 clause|2 clause bsd) license"),
    ("GPL3NamedLater", r"gnu general public license (version |v)?3(\.0)? or later"),
    ("GPL2NamedLater", r"gnu general public license (version |v)?2(\.0)? or later"),
    ("GPL3Named", r"gnu general public license (version |v)?3(\.0)?( only)?"),
    ("GPL2Named", r"gnu general public license (version |v)?2(\.0)?( only)?"),
    ("LGPLNamed", r"gnu lesser general public license (version |v)?(2\.1|3|3\.0)( or later| only)?"),
    ("AGPLNamed", r"gnu affero general public license (version |v)?3(\.0)?( or later| only)?"),
    ("MPL20", r"mozilla public license (version |v)?2\.0"),
    ("EPL20", r"eclipse public license (version |v)?2\.0"),
    ("EPL10", r"eclipse public license (version |v)?1\.0"),
    ("Boost", r"boost software license( (version |v)?1\.0)?"),
    ("ISCNamed", r"isc license"),
    ("ZlibNamed", r"zlib license"),
    ("Unlicense", r"unlicense"),
]
_WHAT = r"(this (project|work|software|program|library|file|code|package|repository|document|dataset) is |this is )?"
SENTENCES += [(name, rf"{_WHAT}(released|licensed|distributed|available) under the (terms of the )?{p}( see .*)?") for name, p in NAMES]
#: Creative Commons licences in words and letters: identifier, elements.
COMMONS: dict[str, tuple[str, str]] = {
    "CCBY4": ("attribution", "by"), "CCBYSA4": ("attribution share ?alike", "by sa"), "CCBYND4": ("attribution no ?deriv(ative)?s", "by nd"), "CCBYNC4": ("attribution non ?commercial", "by nc"),
    "CCBYNCSA4": ("attribution non ?commercial share ?alike", "by nc sa"), "CCBYNCND4": ("attribution non ?commercial no ?deriv(ative)?s", "by nc nd"),
}
SENTENCES += [(name, rf"(except where otherwise noted )?{_WHAT}licensed under (a |the )?(creative commons {words}|cc {letters}) 4\.0( international)?( public)?( license)?( see .*)?") for name, (words, letters) in COMMONS.items()]

#: Ordered rules: licence, identifiers that must stand together. Longer sequences come before the shorter ones they contain.
RULES: list[tuple[str, list[str]]] = [
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs"]),
    ("Apache-2.0", ["Apache20", "ApacheFull", "ApacheAsIs"]),
    ("GPL-2.0-or-later", ["GPL2Later", "NoWarranty"]),
    ("GPL-3.0-or-later", ["GPL3Later", "NoWarranty"]),
    ("GPL-2.0-or-later", ["GPL2Named", "AnyLater"]),
    ("GPL-3.0-or-later", ["GPL3Named", "AnyLater"]),
    ("GPL-2.0-or-later", ["GPL2Later"]),
    ("GPL-3.0-or-later", ["GPL3Later"]),
    ("GPL-2.0-only", ["GPL2Named"]),
    ("GPL-3.0-only", ["GPL3Named"]),
    ("LGPL", ["LGPLNamed"]),
    ("AGPL-3.0", ["AGPLNamed"]),
    ("Apache-2.0", ["Apache20"]),
    ("MIT", ["MITNamed"]),
    ("MPL-2.0", ["MPL20"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC0-1.0", ["CC0"]),
    ("Unlicense", ["Unlicense"]),
    ("Proprietary", ["Proprietary"]),
    ("LGPL", ["LGPLLater"]),
    ("AGPL-3.0", ["AGPL3Later"]),
    ("GPL-2.0-only", ["GPL2Only"]),
    ("GPL-2.0-or-later", ["GPL2NamedLater"]),
    ("GPL-3.0-or-later", ["GPL3NamedLater"]),
    ("BSD-3-Clause", ["BSD3Named"]),
    ("BSD-2-Clause", ["BSD2Named"]),
    ("ISC", ["ISCGrant", "ISCAsIs"]),
    ("ISC", ["ISCGrant"]),
    ("ISC", ["ISCNamed"]),
    ("0BSD", ["0BSDGrant", "ISCAsIs"]),
    ("0BSD", ["0BSDGrant"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant"]),
    ("Zlib", ["ZlibNamed"]),
    ("EPL-2.0", ["EPL20"]),
    ("EPL-1.0", ["EPL10"]),
    ("BSL-1.0", ["BoostGrant", "MITAsIs"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["Boost"]),
    ("CC-BY-ND-4.0", ["CCBYND4"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA4"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCND4"]),
]

#: SPDX ids after normalisation (`+` as `or later`), and their licences. An expression gives an identifier for each id of it;
#: ids that are not listed give SPDX.
SPDX_IDS: dict[str, str] = {
    "apache 2.0": "Apache-2.0", "mit": "MIT", "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause",
    "gpl 2.0": "GPL-2.0-only", "gpl 2.0 only": "GPL-2.0-only", "gpl 2.0 or later": "GPL-2.0-or-later",
    "gpl 3.0": "GPL-3.0-only", "gpl 3.0 only": "GPL-3.0-only", "gpl 3.0 or later": "GPL-3.0-or-later",
    **{f"lgpl {v}{end}": "LGPL" for v in ("2.0", "2.1", "3.0") for end in ("", " only", " or later")},
    **{f"agpl 3.0{end}": "AGPL-3.0" for end in ("", " only", " or later")},
    "mpl 2.0": "MPL-2.0", "cc by nc 4.0": "CC-BY-NC-4.0", "cc by sa 4.0": "CC-BY-SA-4.0", "cc by 4.0": "CC-BY-4.0", "cc0 1.0": "CC0-1.0", "unlicense": "Unlicense",
    "isc": "ISC", "0bsd": "0BSD", "zlib": "Zlib", "epl 2.0": "EPL-2.0", "epl 1.0": "EPL-1.0", "bsl 1.0": "BSL-1.0", "cc by nd 4.0": "CC-BY-ND-4.0", "cc by nc sa 4.0": "CC-BY-NC-SA-4.0", "cc by nc nd 4.0": "CC-BY-NC-ND-4.0",
}
SPDX_RULES: list[tuple[str, list[str]]] = [(name, [f"SPDX-{name}"]) for name in sorted(set(SPDX_IDS.values()))]

#: Every licence sentence holds one of these; a text without any is not normalised. A speed-up that changes nothing.
HINT = r"(?i)licen|warrant|copyright|permission|permitted|redistribut|cc0|any later version|public domain|rights reserved|endorse"
_WRAPPED_HINT = HINT.replace(" ", r"[^\p{L}\p{N}]+")
_SPDX = "spdx license identifier "


def stream(text: Column) -> Column:
    """The normalised text between marks: | where a sentence must end, ~ where it may."""
    s = F.translate(F.lower(text), "|~", "  ")
    for pattern, put in (
        (r"\r\n|\n|\r", "~"),
        (r"(?<=gpl-\d\.\d)\+", " or later"),
        (r"(?<=\.)(?<!\bv\.)(?: +|(?=~))", "|"),
        (r"~(?=[\s/*#;%!>-]*~)", "|"),
        (r"(?<=[;:]) +", "~"),
        (r"(^|[|~])[\s/*#;%!>-]*\(?(?:[0-9a-z]\)|[0-9a-uw-z]\.)\s", "$1"),
        (r"[^\p{L}\p{N}.|~]+", " "),
        (r"\.+(?=[ |~]|$)(?<!\bv\.)", ""),
        (r" *([|~]) *", "$1"),
    ):
        s = F.regexp_replace(s, pattern, put)
    return F.concat(F.lit("|"), F.trim(s), F.lit("|"))


def _over_marks(pattern: str) -> str:
    """The pattern of a sentence in a stream: blanks may be soft marks, a wildcard ends where it can; one at the begin stays in its line."""
    begin, pattern = ("[^|~]*", pattern[2:]) if pattern.startswith(".*") else ("", pattern)
    return begin + re.sub(r"(\[[^]]*\])|\.\*| ", lambda m: m[1] or {".*": "[^|]*?", " ": "(?: |~+)"}[m[0]], pattern)


def identifiers(text: Column, table: list[tuple[str, str]] = SENTENCES) -> Column:
    """Array of the identifiers of a text's licence sentences, in order."""
    any_of = "|".join(f"(?:{_over_marks(p)})" for _, p in table)
    # "v. " may be the number of a list
    hits = F.regexp_extract_all(stream(text), F.lit(rf"(?<=[|~])(?:v\. )?({any_of})(?=[|~])"), 1)

    def known(s: Column) -> Column:
        return F.coalesce(*[F.when(s.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in table])

    def named(s: Column) -> Column:
        ids = F.split(F.regexp_replace(F.substring(s, len(_SPDX) + 1, 1 << 20), " or later", "+"), " (?:or|and) ")
        ids = F.transform(ids, lambda i: F.regexp_replace(F.replace(i, F.lit("+"), F.lit(" or later")), " with .*", ""))
        spdx = F.transform(ids, lambda i: F.coalesce(*[F.when(i == x, F.lit(f"SPDX-{name}")) for x, name in SPDX_IDS.items()], F.lit("SPDX")))
        name = known(s)
        return F.when(name == "SPDX", spdx).otherwise(F.array(name))

    found = F.array_compact(F.flatten(F.transform(F.transform(hits, lambda s: F.regexp_replace(s, "~+", " ")), named)))
    # most texts hold no licence word at all
    return F.when(text.rlike(_WRAPPED_HINT), found).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, rules: list[tuple[str, list[str]]] = [*RULES, *SPDX_RULES], table: list[tuple[str, str]] = SENTENCES, text: str = "text") -> DataFrame:
    """Adds license_ids (identifiers in order), licenses (sorted, distinct), n_sentences and n_rules."""
    df = docs.withColumn("license_ids", F.coalesce(identifiers(F.col(text), table), F.array().cast("array<string>")))
    # Identifiers become words of one line: |A|B|. A rule that fits turns its words into |+licence|, which no later rule matches.
    line = F.concat(F.lit("|"), F.concat_ws("||", "license_ids"), F.lit("|"))

    def apply(c: Column, rule: tuple[str, list[str]]) -> Column:
        return F.replace(c, F.lit("|" + "||".join(rule[1]) + "|"), F.lit(f"|+{rule[0]}|"))

    own = "_" + "_".join(df.columns)  # a name that no column of docs has
    df = df.withColumn(own, reduce(apply, rules, line))
    hits = F.regexp_extract_all(F.col(f"`{own}`"), F.lit(r"\|\+([^|]+)\|"), 1)
    return df.withColumn("licenses", F.array_sort(F.array_distinct(hits))).withColumn("n_sentences", F.size("license_ids").cast("long")).withColumn("n_rules", F.size(hits).cast("long")).drop(own)
