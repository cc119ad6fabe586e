"""Licence scans in column expressions, by sentences and rules over their order.

A text is cut into sentences at line ends and at sentence marks before white space; each is
normalised (A-Z lower-cased, everything but letters and digits one space) and mapped to
the identifier of a known licence sentence, or to none. A known sentence is also found where
single line ends (with what isn't a letter or digit around them, as the marks of comments) wrap
it, and where semicolons or colons, not line ends, part it from its neighbours; blank lines and
sentence marks never stand inside one. The SQL knows neither case and has the same results
for texts without them. A rule is a sequence of
identifiers that stand one right behind the other. At each place the first rule of the list
that fits wins and uses its sentences up, so longer rules stand before the shorter ones they hold.

Defined cases: a null text counts as empty and matches nothing; blank sentences, and numbers or letters of lists, don't count and
don't part their neighbours; repeated rows are scanned each; a null doc_id is carried; other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

#: Identifiers of licence sentences, and the sentences in normal form.
SENTENCES = {
    "mit-title": "the mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-licensed": "this work is licensed under the gnu general public license version 3",
    "gpl2-licensed": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "cc-by-nc-licensed": "licensed under cc by nc 4 0",
    "cc-by-licensed": "licensed under cc by 4 0",
    "cc-by-sa-licensed": "licensed under cc by sa 4 0",
    "cc0-dedicated": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "all-rights": "all rights reserved",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-title": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-title": "apache license version 2 0 january 2004",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-title": "mozilla public license version 2 0",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl-title": "eclipse public license v 2 0",
    "epl-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc0-title": "cc0 1 0 universal",
    "cc-by-title": "attribution 4 0 international",
    "cc-by-sa-title": "attribution sharealike 4 0 international",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
}
#: Rules in order: licence, and the identifiers that stand for it.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is-software")),
    ("MIT", ("mit-grant", "mit-notice", "as-is-software")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-header", "apache-comply")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("Apache-2.0 OR MIT", ("apache-licensed", "mit-released")),
    ("Apache-2.0 OR MIT", ("apache-licensed", "mit-licensed")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-header",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-2.0-only", ("gpl2-licensed",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-licensed",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-licensed",)),
    ("CC-BY-4.0", ("cc-by-licensed",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-redistribution",)),
    ("ISC", ("isc-title", "isc-grant")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-title",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl-title",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("EPL-2.0", ("epl-title",)),
    ("EPL-2.0", ("epl-available",)),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC-BY-4.0", ("cc-by-title",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-title",)),
    ("BSL-1.0", ("boost-grant",)),
    ("proprietary", ("all-rights",)),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = r"[.!?]+(?:\s|\z)"
_OTHER = r"[^\p{L}\p{N}\n]+"
#: What parts words, as one character: a space, a semicolon (for colons too), a line end, or a form feed where a sentence ends for certain.
_PARTS = ((_END, "\n\n"), (r"[^\p{L}\p{N}\n;:]+", " "), (r" ?[;:][ ;:]*", ";"), (r"[ ;]?\n[ ;]?\n[ ;\n]*", "\f"), (r"[ ;]?\n[ ;]?", "\n"))
_KNOWN = r"(?<![^\n;\f])(" + "|".join(s.replace(" ", "[ ;\n]") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + r")(?![^\n;\f])"
_MARK = "\x01"
#: One character for each identifier, of a block of thousands that no pattern takes specially; a space for any other sentence.
CODES = {name: chr(0x4E00 + i) for i, name in enumerate(SENTENCES)}
#: Numbers and letters of lists, which stand alone where a mark follows them.
_LISTED = "^([0-9]{1,2}|[a-z])$"


def _rule(names: tuple[str, ...]) -> str:
    return "".join(CODES[n] for n in names)


def sentences(text: Column) -> Column:
    """Normalised sentences, none of them blank."""
    plain = F.translate(text, UPPER, LOWER)
    for pattern, part in _PARTS:
        plain = F.regexp_replace(plain, pattern, part)
    marked = F.regexp_replace(F.trim(plain), _KNOWN, f"{_MARK}$1{_MARK}")  # every second piece is a known sentence
    pieces = F.transform(F.split(marked, _MARK), lambda p, i: F.when(i % 2 == 1, F.array(F.translate(p, ";\n", "  "))).otherwise(F.split(F.translate(p, ";\f", " \n"), "\n")))
    return F.filter(F.transform(F.flatten(pieces), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(_LISTED))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, identifiers (known ones in order), licences (of the rules that matched, in order). No shuffle."""
    ids = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, CODES[name])])
    names = F.create_map(*[F.lit(x) for name, code in CODES.items() for x in (code, name)])
    licence = F.create_map(*[F.lit(x) for code, name in {_rule(r): name for name, r in reversed(RULES)}.items() for x in (code, name)])
    df = docs.select(F.col(id_col).alias("doc_id"), sentences(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("found"))
    coded = F.transform("found", lambda s: F.when(s.isin(*SENTENCES.values()), F.element_at(ids, s)).otherwise(" "))
    df = df.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_join(coded, "").alias("order"))
    matched = F.regexp_extract_all("order", F.lit("|".join(_rule(r) for _, r in RULES)), F.lit(0))
    known = F.filter(F.split(F.translate("order", " ", ""), ""), lambda c: c != "")
    return df.select("doc_id", "n_sentences", F.transform(known, lambda c: F.element_at(names, c)).alias("identifiers"), F.transform(matched, lambda m: F.element_at(licence, m)).alias("licences"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", F.size("identifiers").cast("long").alias("n_known"), F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"))


def _cases(value: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {other} END"


ORACLE = f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''), '{_END}', chr(10), 'g'), '{UPPER}', '{LOWER}'), '{_OTHER}', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '{_LISTED}')) AS found
  FROM documents),
coded AS (
  SELECT doc_id, len(found) AS n_sentences, array_to_string(list_transform(found, lambda s: {_cases("s", {s: CODES[n] for n, s in SENTENCES.items()}, "' '")}), '') AS codes
  FROM cut)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(length(replace(codes, ' ', '')) AS BIGINT) AS n_known,
  array_to_string(list_transform(list_filter(string_split(replace(codes, ' ', ''), ''), lambda c: c <> ''), lambda c: {_cases("c", {c: n for n, c in CODES.items()}, "''")}), ',') AS identifiers,
  array_to_string(list_transform(regexp_extract_all(codes, '{"|".join(_rule(r) for _, r in RULES)}'), lambda m: {_cases("m", {_rule(r): name for name, r in reversed(RULES)}, "''")}), ',') AS licences
FROM coded"""
