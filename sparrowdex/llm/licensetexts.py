"""Texts that licence scans compare beside the single sentences of licenses.TEMPLATES.

kind `header`: one sentence; kind `file`: a notice of several sentences, or a whole licence. Whole licences are the files
in the folder texts, read on the driver; but that of AGPL-3.0 is GPL-3.0's with its name and section 13 changed, so it is
near the licence's words and not the same.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_4 = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n4. Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: Name, the licence's name in its notices, version, and what the notice calls the program.
GNU = [
    ("GPL-1.0", "GNU General Public License", "1", "program"), ("GPL-2.0", "GNU General Public License", "2", "program"), ("GPL-3.0", "GNU General Public License", "3", "program"),
    ("LGPL-2.0", "GNU Library General Public License", "2", "library"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"), ("LGPL-3.0", "GNU Lesser General Public License", "3", "library"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "program"),
]
NAMES = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
REMOTE = "Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."


def _notices(gnu: str, version: str, what: str) -> list[str]:
    """The notice with and without later versions, with an address on the web or by post."""
    start = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {gnu}"
    versions = [f"{start} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.", f"{start} version {version} as published by the Free Software Foundation."]
    rest = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {gnu} for more details."
    copy = f"You should have received a copy of the {gnu} along with this {what}; if not,"
    ends = [f"{copy} see <https://www.gnu.org/licenses/>.", f"{copy} write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
    return ["\n".join((v, rest, e)) for v in versions for e in ends]


@cache
def texts() -> list[tuple[str, str, str]]:
    """License, kind and text, as templates of licenses.py."""
    out = [("MIT", "file", MIT), ("BSD-2-Clause", "file", f"{BSD_2}\n{BSD_END}"), ("BSD-3-Clause", "file", f"{BSD_2}\n{BSD_3}\n{BSD_END}"), ("BSD-4-Clause", "file", f"{BSD_2}\n{BSD_4}\n{BSD_END}"), ("Apache-2.0", "file", APACHE), ("MPL-2.0", "file", MPL)]
    whole = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files(__package__).joinpath("texts").iterdir() if f.name.endswith(".txt")}
    before, after = whole["GPL-3.0"].split("Use with the GNU Affero General Public License.", 1)
    after = after[after.index("14. Revised Versions") :]
    whole["AGPL-3.0"] = f"{before}{REMOTE}\n{after}".replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU GPL", "GNU AGPL")
    out += [(name, "file", text) for name, text in sorted(whole.items())]
    for name, gnu, version, what in GNU:
        out += [(name, "file", n) for w in dict.fromkeys((what, "program")) for n in _notices(gnu, version, w)]
        out += [(name, "header", f"{start} {end}") for start in ("This work is licensed under the", "Licensed under the") for end in (f"{gnu}, version {version}.", f"{gnu} v{version}.")]
    for code in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        long = "-".join(NAMES[c] for c in code.split("-"))
        for version in ("2.0", "2.5", "3.0", "4.0"):
            kind = {"3.0": " Unported", "4.0": " International"}.get(version, "")
            out += [(f"CC-{code.upper()}-{version}", "header", t) for t in (f"Licensed under CC {code.upper()} {version}.", f"This work is licensed under a Creative Commons {long} {version}{kind} License.")]
    return out
