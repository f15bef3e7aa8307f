"""Licences by holder, name, heading and SPDX expression; Spark and SQL on the same texts."""

import duckdb
import pytest

from test_wrapped_licenses import BSD, GPL, MIT

from tessera.llm import licenses

ONE = " ".join(MIT.split())
CASES = [
    ("BSD-3-Clause", BSD.replace("the copyright holder", "Google Inc.")),
    ("BSD-3-Clause", BSD.replace("the copyright holder", "the University of\n   Somewhere, Inc.")),
    ("BSD-2-Clause", BSD[: BSD.index("3. Neither")]),
    ("MIT", "MIT License Copyright (c) 2020 Some One " + ONE),
    ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n" + MIT),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "It works.\nLicensed under the MIT License - see the LICENSE\nfile\n\nBye"),
    ("MIT", "licensed under the terms of the MIT license."),
    ("GPL-3.0-only", "GNU General Public License v3.0"),
    ("GPL-3.0-or-later", "Released under the GPLv3 or later."),
    ("Apache-2.0", "# Apache-2.0 license"),
    ("Apache-2.0", "This software is distributed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "// SPDX-License-Identifier: BSD-3-Clause"),
    ("LGPL-2.1-only", "/* SPDX-License-Identifier: LGPL-2.1-only */"),
    ("Apache-2.0,MIT", "SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("", "SPDX-License-Identifier: MIT OR Weird-1.0"),
    ("", "This is licensed under the MIT license or the Apache License 2.0 at your option."),
    ("", "It is not licensed under the MIT license."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0-or-later", GPL),
    ("", "A Licence Fee is due. Mit freundlichen"),
    ("", ""),
    ("", None),
    ("", "licensed " * 20_000 + "under " * 20_000),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"d{i}", t, "x") for i, (_, t) in enumerate(CASES)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id string, text string, verdict string")
    return licenses.scan_licenses(docs).collect()


def test_names(found):
    got = {r.doc_id: ",".join(r.licenses) for r in found}
    assert got == {f"d{i}": want for i, (want, _) in enumerate(CASES)} and len(found) == len(CASES) + 1


def test_sql_has_the_same_rules(found):
    db = duckdb.connect()
    db.sql("create table documents (doc_id varchar, text varchar)")
    db.executemany("insert into documents values (?, ?)", [(f"d{i}", t) for i, (_, t) in enumerate(CASES)])
    want = {r[0]: r[1:] for r in db.sql(licenses.ORACLE).fetchall()}
    assert want == {r.doc_id: (len(r.sentence_ids), ",".join(r.sentence_ids), ",".join(r.licenses), r.verdict) for r in found}
