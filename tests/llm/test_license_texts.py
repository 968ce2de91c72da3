"""Licence scans of real licence texts: whole files, headers of source files, single sentences."""

from pathlib import Path

from sparrowdex.llm import licenses

MIT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_HEAD = """Copyright (c) The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.
"""


def gnu_notice(name, version, what):
    return f"""Copyright (C) 1998 Some Author

This {what} is free software; you can redistribute it and/or
modify it under the terms of the {name}
as published by the Free Software Foundation; either version {version}
of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{name} for more details.

You should have received a copy of the {name}
along with this {what}; if not, write to the Free Software
Foundation, Inc., 59 Temple Place - Suite 330, Boston, MA 02111-1307, USA.
"""


def test_license_texts(spark):
    code = "\n".join(f"def step_{i}(value):\n    return value * {i} + offset_{i}" for i in range(30))
    source = lambda text: "\n".join(f"# {x}".rstrip() for x in text.splitlines()) + "\n\n" + code
    texts = {
        "MIT": MIT.split("\n", 2)[2], "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_TAIL, "BSD-2-Clause": BSD_HEAD + BSD_TAIL,
        "GPL-2.0": gnu_notice("GNU General Public License", "2", "program"), "GPL-3.0": gnu_notice("GNU General Public License", "3", "program"), "LGPL-2.1": gnu_notice("GNU Lesser General Public License", "2.1", "library"),
        "LGPL-3.0": gnu_notice("GNU Lesser General Public License", "3", "library"), "AGPL-3.0": gnu_notice("GNU Affero General Public License", "3", "program"),
    }
    want, rows = {}, []
    for name, text in texts.items():
        for path, t in ((f"{name}/whole/LICENSE", text), (f"{name}/head/a.py", source(text)), (f"{name}/plain/LICENSE", text.replace("All rights reserved.", ""))):
            want[path] = name
            rows.append((path, path, t))
    single = {"CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.", "Proprietary": "All rights reserved."}
    for name, text in single.items():
        want[f"one/{name}.md"] = name
        rows.append((f"one/{name}.md", f"one/{name}.md", text))
    for f in sorted((Path(licenses.__file__).parent / "texts").iterdir()):
        want[f.name] = f.stem
        rows.append((f.name, f"whole/{f.name}", f.read_text()))
    got = {r.id: (r.license, r.origin) for r in licenses.license_scan(spark.createDataFrame(rows, "id string, path string, text string")).collect()}
    assert got == {k: (v, "own") for k, v in want.items()}


def test_ties_and_repeated_ids(spark):
    rows = [
        ("1", "d/LICENSE", "Released under the MIT License."), ("2", "d/COPYING", "Released under the MIT License."), ("3", "d/x.py", "code"), ("4", "e/LICENSE", "Licensed under the MIT License.\nReleased under the MIT License."),
        ("4", "e/LICENSE", "Licensed under the MIT License.\nReleased under the MIT License."), ("5", None, None), (None, "f/LICENSE", "Released under the MIT License."), ("6", "f/a.py", "code"), ("7", "f/a.py", ""),
    ]
    got = licenses.license_scan(spark.createDataFrame(rows, "id string, path string, text string").withColumn("b", licenses.F.lit(1)).withColumn("unit", licenses.F.lit("clash"))).collect()
    assert sorted((r.id or "", r.license, r.origin) for r in got if r.id in ("3", "4")) == [("3", "MIT", "inherited"), ("4", "MIT", "own"), ("4", "MIT", "own")]
    assert len(got) == len(rows) and [r.license for r in got if r.id == "5"] == [None]
