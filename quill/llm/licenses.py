"""License scan by canonical digests.

A text is put in canonical form line by line: ASCII case, punctuation and white space are
levelled, lines that only claim a copyright go, and equivalent spellings become one (those of
two words also across lines). The digests of the whole text and of each of its lines are
hash-joined with the digests of known licences. All of it is DataFrame functions; the known
digests are a fixed, small table.

The catalogue: whole texts of the licences in TEXTS and DIGESTS, each with and without its title
and its appendix, however their lines are wrapped; lines that grant a licence by name (GRANTS
and TAGS before NAMES) or have a name with the word licence in it; NOTICES. A bare short name is none.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings (after levelling), applied in this order.
SPELLINGS = (
    ("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authoris", "authoriz"), ("customis", "customiz"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("noncommercial", "non commercial"), ("organis", "organiz"), ("per cent", "percent"), ("programme", "program"),
    ("recognis", "recogniz"), ("sub licens", "sublicens"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https", "http"),
)
#: Spellings of two words, which a line's end may part.
ACROSS = tuple((a, b) for a, b in SPELLINGS if " " in a)
#: Lines that only claim a copyright (unless they speak of copyright itself), and what is no letter or digit. Marks outside ASCII that stand for ASCII ones are punctuation too.
COPYRIGHT = r"^[^0-9A-Za-z]*(?:copyright|\(c\)|©|&copy;)(?:[^0-9A-Za-z].*)?$"
SPEAKS = r"^[^0-9A-Za-z]*copyright[^0-9A-Za-z]+(?:and|by law|disclaimer|grant|holder|in|interest|is|law|licen[cs]e|notice|of|or|owner|protection|right|statement|the|to)s?(?:[^0-9A-Za-z].*)?$"
PUNCTUATION = r"[\x00-/:-@\[-`{-\x7f ©‐-―‘-‟•…]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Names under which licences are granted in one line.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0", "apache 2 0 license"),
    "MIT": ("mit license", "mit"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gpl 2 0", "gplv2", "gpl version 2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gpl 3 0", "gplv3", "gpl version 3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution non commercial 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution non commercial sharealike 4 0 international license"),
    "CC0-1.0": ("cc0 1 0", "cc0"),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
}
#: Names of one word or a number, which are a licence only in a grant or a tag, go by their own line if they have one of these words.
NAMED = ("license", "licence", "gnu", "creative commons", "public license")
#: Machine-readable tags before an SPDX name.
TAGS = ("spdx license identifier ", "license ", "license spdx ")
#: Sentences around a name: one known line for each.
GRANTS = tuple(f"{by} {under}{the}" for by in ("", "this work is ", "this software is ", "this document is ") for under in ("licensed under ", "released under ", "distributed under ") for the in ("", "the "))
NOTICES = {"LicenseRef-All-Rights-Reserved": ("All rights reserved.",), "LicenseRef-Public-Domain": ("This work is in the public domain.", "Released into the public domain.")}

# Whole licence texts.
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
TEXTS = {
    "MIT": (f"{_MIT}\n{_WARRANTY_MIT}", f"MIT License\n{_MIT}\n{_WARRANTY_MIT}", f"The MIT License (MIT)\n{_MIT}\n{_WARRANTY_MIT}"),
    "BSD-2-Clause": (f"{_BSD_HEAD}\n{_WARRANTY_BSD}", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_WARRANTY_BSD}"),
    "BSD-3-Clause": tuple(
        f"{title}{_BSD_HEAD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_WARRANTY_BSD}"
        for title in ("", "BSD 3-Clause License\n")
    ),
    "ISC": tuple(
        f"{title}Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"
        for title in ("", "ISC License\n")
    ),
    "0BSD": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_WARRANTY}",),
}


# SHA-256 of the canonical form, and its bytes, of whole texts: as published, without the title, without what
# follows the terms, and without both.
DIGESTS: dict[str, tuple[tuple[str, int], ...]] = {
    "Apache-2.0": (
        ("4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37", 9826),
        ("c7104523952060493e991206663250aa11fa65e90ed0333cf77dbd62951d905d", 9757),
        ("0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c", 8810),
        ("2e349068b1767ce16c09b3a0a7df25513df42a4881a97a2a0de3ecac55c2ce0a", 8741),
    ),
    "Artistic-1.0-Perl": (
        ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833),
        ("4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c", 5812),
    ),
    "CC0-1.0": (
        ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
        ("a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32", 6664),
    ),
    "GFDL-1.2": (
        ("58b6ebdf2bd26f81dd551d8efda909bfbc8914ce77996a5c289c28616b91ceeb", 19580),
        ("a3017587f0aec108ab69b5a0607880fa81b82bc8b696a77bfc290aeb0d1a7e8d", 19523),
    ),
    "GFDL-1.3": (
        ("c4f8ea2b5247ab1ff721ce8255137250d4c14f50a0fb68c00fd793f496ced65e", 22015),
        ("64d8c3ba3ea2ba0bfaf292292c18a9b0e1561964d61ac746b35ba143ccc4a473", 21956),
    ),
    "GPL-1.0": (
        ("c5e5514bf7b19c3f60d6cc86436f4ade92e8cb58dd94012eeb5485c6ff46fcdd", 11701),
        ("c6eb3120b8569936c25ec8c6e2ddd6505d6f3df9a73d8e7b2717745f0279c515", 11650),
        ("74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b", 9416),
        ("cbe7331e93829cef2fc892c0c502d583fade2f252903c60120323b5d9d074d7f", 9365),
    ),
    "GPL-2.0": (
        ("9c05d74a883c3b9a1f9c0850cd047eb9d7a3580bdda1f342f19570447984ab29", 17116),
        ("7d3b50fd7b07ec11eaddc55d8f18daff53f72c717b156656870d1ba09e07cc01", 17069),
        ("1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca", 14484),
        ("3d6c536f38203f43d4f882a96f62d08ef68247a99702d48f1c232a3250b408c1", 14437),
    ),
    "GPL-3.0": (
        ("1e22646698aebe209e79005a9740e283aed0e2115f705d042ec9fbd1682ab2cd", 33270),
        ("255f49bd4511481e00afbe9dc0cbc74426a1e87643d2e83b4147207f9cb22d89", 33220),
        ("4fd91e8f277c4355a10d09240f8746dc2d105ab1510eb72ced59c5b11f8cfcb0", 30834),
        ("25d7fd241d8a349c0a93aaf3f311b9763570b0273d026219a7e3ca9049ed3d59", 30784),
    ),
    "LGPL-2.0": (
        ("9d46e2d8d4cf31c5871fd3557a6585a19b7bf1dc6c2fee86f928b670ab515553", 24065),
        ("442fc7d1746c66aaeddf47210de41430bda03f547f88f306323b3b8ba5d53b86", 24010),
        ("504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", 22277),
        ("81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688", 22222),
    ),
    "LGPL-2.1": (
        ("a4220bb06c41afc5d24f1af70c1e7f7db32fc07b519c818c8f2d6b1119f47918", 25152),
        ("ac88a0f545ac31e76607d0d5badb78f10441508802f44647167dd25f00fd2323", 25092),
        ("48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", 23365),
        ("98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4", 23305),
    ),
    "LGPL-3.0": (
        ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
        ("13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7", 7047),
    ),
    "MPL-1.1": (
        ("f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", 22339),
        ("2772c161a7ca5eceb4517ee311d5ee8b30c97502771ed5f826ca5e3856ad5c11", 22304),
        ("fb84cdb331a381edd811d3017d5400ac2c74d9d8470038f79413ac78b10c2a59", 20884),
        ("8e0d6bce1c9edcccd142522e83c6de084a68b9500d79e6741b8903df3316c55a", 20849),
    ),
    "MPL-2.0": (
        ("9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56", 14272),
        ("d0c5ff4b1b1df9ae8ac7381433e58aaf10308f4e9fd6a32597b6b0e01220a0a6", 14237),
        ("2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04", 13591),
        ("fa31bb5fe4dacb07f1a4ad162be58edb552e9a96a500b68e081943eb2d3cfec5", 13556),
    ),
}


def canonical(text: str) -> str:
    """The canonical form, on the driver, for known licences."""
    out = []
    for line in text.split("\n"):
        line = line.translate(str.maketrans(_UPPER, _LOWER))
        if re.match(COPYRIGHT, line) and not re.match(SPEAKS, line):
            continue
        line = re.sub(PUNCTUATION, " ", line).strip(" ")
        for a, b in SPELLINGS:
            line = line.replace(a, b)
        if line:
            out.append(line)
    whole = " ".join(out)
    for a, b in ACROSS:
        whole = whole.replace(a, b)
    return whole


def known_texts() -> list[tuple[str, str]]:
    """(licence, canonical text), one licence a text."""
    out: dict[str, str] = {}
    for licence, names in NAMES.items():
        for name in names:
            for text in (*(grant + name for grant in GRANTS), *((name,) if any(w in name for w in NAMED) else ())):
                out.setdefault(canonical(text), licence)
        for tag in TAGS:
            for name in {licence, f"{licence} only", f"{licence} or later"} if "GPL" in licence else {licence}:
                out.setdefault(canonical(tag + name), licence)
    for source in (NOTICES, TEXTS):
        for licence, texts in source.items():
            for text in texts:
                out.setdefault(canonical(text), licence)
    return sorted((licence, text) for text, licence in out.items())


def catalogue() -> list[tuple[str, int, str]]:
    """(digest, bytes, licence) of all that is known."""
    own = [(hashlib.sha256(text.encode()).hexdigest(), len(text.encode()), licence) for licence, text in known_texts()]
    return own + [(digest, size, licence) for licence, known in DIGESTS.items() for digest, size in known]


def canonical_line(line: Column) -> Column:
    """The canonical form of one line; empty if it only claims a copyright."""
    low = F.translate(line, _UPPER, _LOWER)
    out = F.trim(F.regexp_replace(low, PUNCTUATION.replace("[\\x00", "[\\x{0}").replace("\\x7f", "\\x{7f}"), " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(low.rlike(COPYRIGHT) & ~low.rlike(SPEAKS), F.lit("")).otherwise(out)


def known_digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(digest, licence) for digest, _, licence in catalogue()], "digest string, license string")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, text_license, line_licenses, n_license_lines.

    text_license is the known licence that the whole text is, or null; line_licenses the
    sorted names, comma-joined, of licences that single lines are (empty: none). Null and
    empty texts have none. Rows that repeat are each scanned; other columns are not carried.
    """
    spark = docs.sparkSession
    sizes = sorted({size for _, size, _ in catalogue()})
    known = F.broadcast(known_digests(spark))
    lines = F.transform(F.split(F.col(text_col), "\n"), canonical_line)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.filter(lines, lambda x: x != "").alias("lines"))
    # Only texts as long as some known one can be known: the rest needs no digest.
    fits = lambda c: F.octet_length(c).isin(sizes)
    whole = F.array_join("lines", " ")
    for a, b in ACROSS:
        whole = F.replace(whole, F.lit(a), F.lit(b))
    unit = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    units = F.concat(
        F.when(fits(whole), F.array(unit("text", whole))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")),
        F.transform(F.filter("lines", fits), lambda c: unit("line", c)),
    )
    scanned = rows.select("row", "id", F.explode_outer(units).alias("unit")).select("row", "id", "unit.kind", F.sha2("unit.text", 256).alias("digest"))
    found = scanned.join(known, "digest", "left")
    line = F.when(F.col("kind") == "line", F.col("license"))
    out = found.groupBy("row", "id").agg(
        F.max(F.when(F.col("kind") == "text", F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(line)), ",").alias("line_licenses"),
        F.count(line).alias("n_license_lines"),
    )
    return out.select(F.col("id").alias(id_col), "text_license", "line_licenses", "n_license_lines")


def oracle() -> str:
    """The same scan of the table documents as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    level = f"translate(x, '{_UPPER}', '{_LOWER}')"
    marks = PUNCTUATION
    for code in ("00a0", "00a9", "2010", "2015", "2018", "201f", "2022", "2026"):
        marks = marks.replace(f"\\u{code}", f"\\x{{{code}}}")
    line = f"trim(regexp_replace({level}, {quote(marks)}, ' ', 'g'), ' ')"
    for a, b in SPELLINGS:
        line = f"replace({line}, {quote(a)}, {quote(b)})"
    values = ", ".join(f"({quote(digest)}, {quote(licence)})" for digest, _, licence in catalogue())
    whole = "array_to_string(ls, ' ')"
    for a, b in ACROSS:
        whole = f"replace({whole}, {quote(a)}, {quote(b)})"
    return f"""
        WITH known(digest, license) AS (VALUES {values}),
        l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN regexp_matches({level}, {quote(COPYRIGHT)}) AND NOT regexp_matches({level}, {quote(SPEAKS)}) THEN '' ELSE {line} END), lambda x: x <> '') AS ls FROM documents),
        w AS (SELECT l.doc_id, k.license FROM l JOIN known k ON len(ls) > 0 AND sha256({whole}) = k.digest),
        n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n FROM (SELECT doc_id, sha256(unnest(ls)) AS digest FROM l) u JOIN known k USING (digest) GROUP BY doc_id)
        SELECT d.doc_id, w.license AS text_license, coalesce(n.names, '') AS line_licenses, coalesce(n.n, 0)::BIGINT AS n_license_lines
        FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
