import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lamina.llm import licences, sharding

MIT = "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ROWS = [
    (1, MIT), (2, "Plain text. Nothing here! Released under the MIT License.\nMore?"), (3, None), (4, ""), (5, " .\n\n!! "),
    (6, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (7, "Licensed under the Apache License, Version 2.0. Other words. Released under the MIT License."),
    (8, "licensed UNDER the apache license version 2 0\n" * 3), (9, "all rights reserved " * 20_000), (9, "All rights reserved."), (None, "All rights reserved"), (11, "Größe. ALL RIGHTS RESERVED!"),
]


def brute(text):
    parts = [re.sub(r"[\W_]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in s)).strip() for s in re.split(r"[.!?]+(?:[ \t\n\r\f\v]|\Z)|\n", text or "")]
    names = {s: n for n, s in licences.SENTENCES.items()}
    found = [names.get(p) for p in parts if p and not re.fullmatch(licences._LISTED.strip("^$"), p)]
    out, i = [], 0
    while i < len(found):
        rule = next(((name, r) for name, r in licences.RULES if tuple(found[i : i + len(r)]) == r), None)
        if rule:
            out.append(rule[0])
        i += len(rule[1]) if rule else 1
    return len(found), [n for n in found if n], out


def test_licences_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("order", F.lit(2))
    got = sorted(str((r.doc_id, r.n_sentences, r.identifiers, r.licences)) for r in licences.scan(df).collect())
    assert got == sorted(str((i, *brute(t))) for i, t in ROWS)
    assert {r.doc_id: r.licences for r in licences.scan(df).collect()}[6] == ["Apache-2.0 OR MIT"]
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_equal_sql_and_are_native(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = licences.op2_licences(spark, str(tmp_path))
    want = c.sql(licences.ORACLE)
    assert sorted(map(str, map(tuple, df.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the
License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice.""",
}
IDENTIFIERS = {
    "MIT": ["mit-grant", "mit-notice", "as-is-software"], "Apache-2.0": ["apache-header", "apache-comply", "apache-copy", "apache-as-is"],
    "GPL-3.0-or-later": ["gpl-free", "gpl-hope", "gpl-details"], "BSD": ["bsd-redistribution"],
}


def test_wrapped_licences_are_found(spark):
    rows = []
    for name, text in WRAPPED.items():
        for prefix in ("", "# ", " * ", "// ", "    "):
            lines = "\n".join((prefix + line).rstrip() for line in text.split("\n"))
            rows += [(name, lines), (name, f"Copyright 2020 A. Body\n\n{lines}\n\nimport nothing\n"), (name, lines.replace("\n", "\r\n"))]
    rows.append(("Apache-2.0", " ".join(WRAPPED["Apache-2.0"].replace("License at\n", "License at:\n").split("\n"))))
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r.licences == [r.doc_id] for r in got), [r for r in got if r.licences != [r.doc_id]]
    assert all(r.identifiers == IDENTIFIERS[r.doc_id] for r in got[:-1])
    assert got[-1].identifiers == ["apache-header", "apache-comply", "apache-copy"]


FILES = {
    "BSD-3-Clause": """# Copyright (c) 2020, Someone. All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
#
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
#
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission.
""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "LGPL-2.1-or-later": """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
""",
    "GPL-2.0-or-later": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007
""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
}


def test_files_as_they_are_published(spark):
    df = spark.createDataFrame([(k, t) for k, t in FILES.items()], "doc_id string, text string")
    got = {r.doc_id: [x for x in r.licences if x != "proprietary"] for r in licences.scan(df).collect()}
    assert {k: v[:1] for k, v in got.items()} == {k: [k] for k in FILES}, got


def test_blank_lines_and_marks_stay_ends(spark):
    texts = ["all rights\n\nreserved", "all rights. Reserved", "all rights\nreserved", "Notice: all rights reserved; thanks", "all\n" * 50_000 + "rights reserved", "\n" * 50_000, "; " * 50_000, "a: b; c\nde"]
    got = [(r.n_sentences, r.licences) for r in licences.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(2, []), (2, []), (1, ["proprietary"]), (3, ["proprietary"]), (50_000, ["proprietary"]), (0, []), (0, []), (2, [])]


def test_rules_are_in_order():
    codes = [licences._rule(r) for _, r in licences.RULES]
    assert len(licences.CODES) > 45 and len(set(codes)) == len(codes)
    for i, rule in enumerate(codes):
        assert not any(rule != earlier and rule.startswith(earlier) for earlier in codes[:i])


def test_lookup_table_by_turns():
    names, slots = ("a", "b", "c"), 13
    table = sharding.lookup_table(names, slots)
    orders = []
    for s in names:
        start, step = sharding._number(f"start:{s}") % slots, sharding._number(f"step:{s}") % (slots - 1) + 1
        orders.append([(start + step * j) % slots for j in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    taken, turn = {}, 0
    while len(taken) < slots:
        taken[next(x for x in orders[turn % 3] if x not in taken)] = turn % 3
        turn += 1
    assert table == [taken[i] for i in range(slots)]


def test_shares_are_even_and_few_keys_move():
    before, after = sharding.lookup_table(), sharding.lookup_table(sharding.SHARDS[:-1])
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(before, after) if a != 63)
    assert moved / sharding.SLOTS < 0.1
    for bad in ((("a", "a"), 13), (("a",), 12), ((), 13)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    rows = [(i % 50, f"t{i}") for i in range(200)] + [(None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = sharding.place(df)
    assert got.count() == 202 and got.select("doc_id", "slot", "shard").distinct().count() == 51
    table = sharding.lookup_table()
    assert all(r.shard == sharding.SHARDS[table[r.slot]] for r in got.collect())
    assert sharding.place(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan
    df = df.withColumn("shard", F.lit("clash")).withColumn("__slot", F.lit(1))
    sharding.write_sharded(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 202
