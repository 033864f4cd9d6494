"""Licence sentences and rules."""

import duckdb

from findspan.llm import licenses

MIT = "\n".join(licenses.SENTENCES[k] for k in ("MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability"))
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = "\n".join(licenses.SENTENCES[k] for k in ("BSD-grant", "BSD-source", "BSD-binary"))
CASES = [
    (1, "Copyright (c) 2020 Someone\n\n" + MIT.replace(" of ", "\n of "), "MIT"),
    (2, "// " + APACHE.replace("\n", "\n// "), "Apache-2.0"),
    (3, "Words before.\n" + GPL + "\nWords after.", "GPL-3.0-or-later"),
    (4, BSD + "\n" + licenses.SENTENCES["BSD-names"], "BSD-3-Clause"),
    (5, BSD, "BSD-2-Clause"),
    (6, "some line\nReleased under the MIT License.", "MIT"),
    (7, "x y z\nThis work is licensed under the GNU General Public License, version 3.\nq", "GPL-3.0-only"),
    (8, "Licensed under CC BY-NC 4.0. Released under the MIT License.", "CC-BY-NC-4.0,MIT"),
    (9, "# SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"),
    (10, licenses.SENTENCES["BSD-source"] + " " + licenses.SENTENCES["BSD-grant"], ""),
    (11, "We talk about the MIT License here, and of all rights.", ""),
    (20, "/*\n * Copyright (c) 2020 Foo\n *\n * " + MIT.replace(" of ", "\n * of ").replace("\n", "\n") + "\n */\nint x;", "MIT"),
    (21, "# Copyright 2020 Foo Inc.\n# " + MIT.replace(" of ", " of\n# "), "MIT"),
    (22, "Copyright (c) 2020 Foo\n" + MIT.replace(" of ", "\nof "), "MIT"),
    (23, BSD + "\n" + licenses.SENTENCES["BSD-names"].replace("the copyright holder", "Google Inc."), "BSD-3-Clause"),
    (24, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode;", "Apache-2.0,MIT"),
    (25, "# SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) AND MIT", "BSD-3-Clause,GPL-2.0-or-later,MIT"),
    (26, "-- " + GPL.replace("\n", "\n-- "), "GPL-3.0-or-later"),
    (27, "Neither the name of the game nor its rules may be told.", ""),
    (12, "", ""), (13, None, ""), (14, "word " * 60_000 + "\nAll rights reserved.", "Proprietary"), (14, None, ""),
]


def test_licences_by_sentence_sequence(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in CASES], "doc_id long, text string, sentences string")
    got = sorted((r.doc_id, r.licences) for r in licenses.scan_licences(docs).collect())
    assert got == sorted((i, want) for i, _, want in CASES)
    assert licenses.scan_licences(docs.limit(0)).count() == 0


def test_sql_gives_the_same(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in CASES], "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t, _ in CASES])
    want = con.execute(licenses.licences_sql()).fetchall()
    got = [(r.doc_id, r.sentences, r.licences) for r in licenses.scan_licences(docs).collect()]
    assert sorted(got) == sorted(want)


def test_one_stage_without_python(spark):
    plan = licenses.scan_licences(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
