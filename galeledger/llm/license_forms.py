"""Forms in which the texts of licences are published and found.

``license_texts`` holds whole published texts, one file per licence. A licence is found
with and without its title, its closing remarks on how to apply it, and the numbers of
its conditions; each such form is a text of its own.
"""

from __future__ import annotations

import itertools
import os
import re

_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
_MIT_TITLES = ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT")
_ISC_TITLES = ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)")
_BSD = """{0}Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.
{clause}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:
"""
_BSD_NAMES = """{2}Neither the name of {holder} nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written
permission.
"""
_APPENDIX = re.compile(r"(?mi)^[ \t]*(?:appendix: )?how to apply (?:these terms|the apache license) to your\b.*$")
_END = re.compile(r"(?m)^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$")


class Forms:
    """Texts by licence, of which a licence may have several; its first is the plain one."""

    def __init__(self, pairs):
        self._pairs = list(dict.fromkeys(pairs))

    def items(self) -> list[tuple[str, str]]:
        return list(self._pairs)

    def __getitem__(self, name: str) -> str:
        return next(text for known, text in self._pairs if known == name)


def _titled(name: str, body: str, titles) -> list[tuple[str, str]]:
    heads = itertools.product(("", *titles), ("", "All rights reserved."))
    return [(name, "\n\n".join(p for p in (*head, body) if p)) for head in heads]


def _bsd() -> list[tuple[str, str]]:
    out = []
    for marks in (("1. ", "2. ", "3. "), ("* ",) * 3, ("a. ", "b. ", "c. ")):
        for who in ("HOLDER", "OWNER"):
            body = _BSD_START + _BSD.format(*marks, clause="", who=who)
            out += _titled("BSD-2-Clause", body, ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"))
            for holder in ("the copyright holder", "the copyright owner", "the author", "the organization", "the <organization>"):
                clause = _BSD_NAMES.format(*marks, holder=holder)
                body = _BSD_START + _BSD.format(*marks, clause=clause, who=who)
                out += _titled("BSD-3-Clause", body, ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"))
    return out


def _published() -> list[tuple[str, str]]:
    """Whole texts, also without the remarks after the terms and without the title."""
    out = []
    for file in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, file), encoding="utf-8") as source:
            text = source.read()
        forms = [text]
        appendix, end = _APPENDIX.search(text), _END.search(text)
        if appendix:
            forms.append(text[: appendix.start()])
        if end:
            forms += [text[: end.end()], text[: end.start()]]
        name = file.removesuffix(".txt")
        for form in forms:
            out.append((name, form))
            title, _, rest = form.strip().partition("\n\n")
            if len(title.split()) <= 12 and rest:
                out.append((name, rest))
        if name == "Unlicense":
            out += [(name, t + "\n\n" + f) for t in ("The Unlicense", "Unlicense") for f in forms]
            out += [(name, text[: text.index("For more information")])]
            out += [(name, text.replace("http://unlicense.org/", "https://unlicense.org"))]
    return out


def _headers() -> list[tuple[str, str]]:
    """Notices at the head of files, from the published remarks on how to apply."""
    out = []
    for name, notice, begin, end in (
        ("Apache-2.0", "Apache-2.0", "Licensed under the Apache License", "limitations under the License."),
        ("GPL-2.0", "GPL-2.0-or-later", "This program is free software", "02110-1301 USA."),
        ("GPL-2.0", "GPL-2.0-or-later", "This program is free software", "GNU General Public License for more details."),
        ("GPL-3.0", "GPL-3.0-or-later", "This program is free software", "<https://www.gnu.org/licenses/>."),
        ("GPL-3.0", "GPL-3.0-or-later", "This program is free software", "GNU General Public License for more details."),
        ("LGPL-2.1", "LGPL-2.1-or-later", "This library is free software", "02110-1301  USA"),
        ("LGPL-2.1", "LGPL-2.1-or-later", "This library is free software", "Lesser General Public License for more details."),
        ("MPL-2.0", "MPL-2.0", "This Source Code Form is subject", "http://mozilla.org/MPL/2.0/."),
    ):
        with open(os.path.join(_FOLDER, name + ".txt"), encoding="utf-8") as source:
            text = source.read()
        start = text.rfind(begin)
        stop = text.find(end, start)
        if start >= 0 and stop >= 0:
            out.append((notice, text[start : stop + len(end)]))
    return out


def forms(short: dict[str, str]) -> Forms:
    """``short`` texts and notices, and all published texts."""
    out = list(short.items())
    out += _titled("MIT", short["MIT"], _MIT_TITLES)
    for isc in (short["ISC"], short["ISC"].replace("and/or distribute", "and distribute")):
        out += _titled("ISC", isc, _ISC_TITLES)
    return Forms(out + _bsd() + _published() + _headers())
