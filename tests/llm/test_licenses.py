import textwrap

import duckdb
import pytest

from recordloom.llm import licenses as L


def found(spark, text):
    row = L.recognised(spark.createDataFrame([(text,)], "text string")).first()
    return list(row.licenses), list(row.unmatched)


def test_sql_gives_the_same(docs, none, same):
    report = L.license_report(docs)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    names = ["doc_id", "n_sentences", "sentences", "licenses", "unmatched"]
    same(report, names, con.execute(f"SELECT {', '.join(names)} FROM ({L.license_sql()})").fetchall())
    assert L.license_report(none).count() == 0


def test_whole_licenses_come_before_their_parts(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + ". ".join(s for s, i in L.SENTENCES.items() if i in ("MitGrant", "MitNotice", "MitAsIs")) + "."
    assert found(spark, mit) == (["MIT"], [])
    header = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at:\n http://www.apache.org/licenses/LICENSE-2.0\n"
    as_is = next(s for s, i in L.SENTENCES.items() if i == "ApacheAsIs")
    assert found(spark, header + as_is) == (["Apache-2.0"], [])


def test_references_and_what_no_rule_takes(spark):
    assert found(spark, "Text. Released under the MIT License.\nLicensed under CC BY-NC 4.0.") == (["MIT", "CC-BY-NC-4.0"], [])
    assert found(spark, "See the GNU General Public License for more details.") == ([], ["GplSee"])
    assert found(spark, None) == ([], []) and found(spark, "the licence of poets") == ([], [])


def test_every_known_sentence_has_a_trigger():
    assert all(any(t in s for t in L.TRIGGERS) for s, i in L.SENTENCES.items() if i not in ("ApacheUrl",)) and all("licen" in s for s, i in L.SENTENCES.items() if i == "ApacheUrl")


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
@pytest.mark.parametrize("width", [40, 72, 80])
def test_wrapped_licenses_are_whole(spark, mark, width):
    lines = lambda text: "\n".join(mark + line for p in text.split("\n") for line in textwrap.wrap(p, width) or [""])
    rows = [(n, lines(text)) for n, text in enumerate([MIT, GPL, BSD, APACHE])]
    got = {r.n: (list(r.licenses), list(r.unmatched)) for r in L.recognised(spark.createDataFrame(rows, "n int, text string")).collect()}
    assert got == {0: (["MIT"], []), 1: (["GPL-3.0-or-later"], []), 2: (["BSD-2-Clause"], []), 3: (["Apache-2.0"], [])}


def test_spdx_lines(spark):
    assert found(spark, "// SPDX-License-Identifier: Apache-2.0\nint x;") == (["Apache-2.0"], [])
    assert found(spark, "/* SPDX-License-Identifier: MIT */") == (["MIT"], [])
    assert found(spark, "# SPDX-License-Identifier: GPL-3.0-only\n") == (["GPL-3.0-only"], [])
    assert found(spark, "SPDX-License-Identifier:\tGPL-3.0-or-later\r\n") == (["GPL-3.0-or-later"], [])
    assert found(spark, "spdx license identifier\n\nmit") == ([], []) and found(spark, "spdx license. identifier: mit") == ([], [])


def test_a_sentence_starts_and_ends_with_a_piece(spark):
    assert found(spark, "We like the MIT License.\nReleased under the MIT License of old") == ([], [])
    assert found(spark, "Some words\nreleased under the\nMIT license\nand more") == (["MIT"], [])
    assert found(spark, ";" * 20000 + " x\n" + "." * 20000 + "\nLicensed under CC BY 4.0: yes") == (["CC-BY-4.0"], [])


def test_every_trigger_stands_in_one_line():
    assert all(any(t in s for t in L.TRIGGERS if " " not in t) for s in L.SENTENCES)
