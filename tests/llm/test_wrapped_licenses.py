"""Licence texts as they stand in files: wrapped, indented, behind comment leaders."""

from tessera.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_wrapped_licenses(spark):
    rows = []
    for name, text in (("MIT", MIT), ("BSD-3-Clause", BSD), ("GPL-3.0-or-later", GPL)):
        lines = text.split("\n")
        forms = [text, text.replace("\n", "\r\n"), *("\n".join(lead + x for x in lines) for lead in ("# ", " * ", "// ", ";; "))]
        rows += [(name, f"int x;\n{form}\nint y;") for form in forms]
    rows += [("MIT", "/* SPDX-License-Identifier: MIT */\nint x;"), ("MIT", "no full stop\nReleased under the MIT\nLicense\nmore"), ("", "Released under the MIT\n\nLicense")]
    frame = spark.createDataFrame([(i, want, t) for i, (want, t) in enumerate(rows)], "doc_id long, want string, text string")
    got = {r.doc_id: ",".join(r.licenses) for r in licenses.scan_licenses(frame).collect()}
    assert got == {i: want for i, (want, _) in enumerate(rows)}
