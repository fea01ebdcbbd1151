"""The list of licences that the registered scan knows: whole texts, standard headers, notices.

``license_texts`` holds whole texts, one file each, named by the licence, and by a wording after ``@`` where there are
several. Short ones are listed without a title and under their usual ones. Since the canonical form drops every line that
begins with the word copyright, a text is also listed with each paragraph on one line, and short texts and headers wrapped
at the usual ``WIDTHS``. A text that ends in how to apply it is listed without that part, too.
"""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

FOLDER = Path(__file__).parent / "license_texts"
WIDTHS = (60, 64, 65, 66, 68, 70, 72, 74, 75, 76, 77, 78, 79, 80, 100, 120)
SHORT = 4000
END = "END OF TERMS AND CONDITIONS"

BSD_RESERVED = ("", "All rights reserved.")
# Titles under which a short text is given.
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "BSD-2-Clause": tuple(f"{t}\n\n{r}".strip() for r in BSD_RESERVED for t in (
        "", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License")),
    "BSD-3-Clause": tuple(f"{t}\n\n{r}".strip() for r in BSD_RESERVED for t in (
        "", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "Modified BSD License")),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("", "BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("", "zlib License", "The zlib License", "zlib/libpng license"),
    "Unlicense": ("", "The Unlicense", "Unlicense"),
}

_FSF = """{this} is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{either} version {version} of the License, or
(at your option) any later version."""
_ONLY = """{this} is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, version {version}."""
_WARRANTY = """{this} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind}General Public License for more details."""
_RECEIVED = ("""You should have received a copy of the GNU {kind}General Public License
along with {that}.  If not, see <https://www.gnu.org/licenses/>.""",
             """You should have received a copy of the GNU {kind}General Public License
along with {that}.  If not, see <http://www.gnu.org/licenses/>.""",
             """You should have received a copy of the GNU {kind}General Public
License along with {that}; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
             """You should have received a copy of the GNU {kind}General Public License
along with {that}; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
             """You should have received a copy of the GNU {kind}General Public License
along with {that}; if not, write to the Free Software Foundation, Inc.,
59 Temple Place, Suite 330, Boston, MA 02111-1307 USA""")
_GNU = (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"),
        ("AGPL-3.0", "Affero ", "3"))

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    {url}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
_ASF = """Licensed to the Apache Software Foundation (ASF) under one
or more contributor license agreements.  See the NOTICE file
distributed with this work for additional information
regarding copyright ownership.  The ASF licenses this file
to you under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at

  http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied.  See the License for the
specific language governing permissions and limitations
under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {url}://mozilla.org/MPL/2.0/."""
_BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
{url}://www.boost.org/LICENSE_1_0.txt)"""
_BSD_HEADER = """Use of this source code is governed by a BSD-style
license that can be found in the LICENSE file."""
_MIT_HEADER = """Use of this source code is governed by an MIT-style
license that can be found in the LICENSE file or at
https://opensource.org/licenses/MIT."""

# Names by which one-sentence notices call a licence.
NAMES = {
    "MIT": ("MIT License", "MIT license (MIT)", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",), "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"), "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"),
    **{f"{short}GPL-{v}": tuple(f"{name}{by}" for name in (f"GNU {kind}General Public License", f"GNU {short}GPL", f"{short}GPL")
                                for by in (f", version {v[:-2] if v.endswith('.0') else v}", f" version {v}", f" v{v[:-2] if v.endswith('.0') else v}", f" {v}"))
       for short, kind, versions in (("", "", ("1.0", "2.0", "3.0")), ("L", "Lesser ", ("2.1", "3.0")), ("A", "Affero ", ("3.0",)))
       for v in versions},
    **{f"CC-{code}-{v}": (f"CC {code} {v}", f"CC-{code}-{v}", f"Creative Commons {words} {v} {place} License",
                         f"Creative Commons {words} {v} License")
       for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                           ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                           ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
       for v, place in (("3.0", "Unported"), ("4.0", "International"))},
}
SUBJECTS = ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ", "This code is ",
            "This document is ", "This library is ")
VERBS = ("licensed under", "released under", "distributed under", "available under")


def notices() -> list[tuple[str, str]]:
    """One-sentence notices: each way of saying so with each name, and SPDX lines."""
    said = [(license, f"{subject}{verb} {article}{name}.") for license, names in NAMES.items() for name in names
            for subject in SUBJECTS for verb in VERBS for article in ("the ", "a ", "")]
    tagged = [(license, f"SPDX-License-Identifier: {license}{end}") for license in NAMES
              for end in ("", *(("-only", "-or-later", "+") if "GPL" in license else ()))]
    return said + tagged


def headers() -> list[tuple[str, str]]:
    """What stands at the top of source files."""
    found = [(license, text.format(url=url)) for license, text in (("Apache-2.0", _APACHE), ("MPL-2.0", _MPL), ("BSL-1.0", _BOOST))
             for url in ("http", "https")]
    found += [("Apache-2.0", _ASF), ("BSD-3-Clause", _BSD_HEADER), ("MIT", _MIT_HEADER)]
    for license, kind, version in _GNU:
        for noun in ("program", "library", "file", "software"):
            for grant, colon, either in ((_FSF, ":", ", either"), (_FSF, ";", "; either"), (_ONLY, ":", "")):
                given = {"this": f"This {noun}", "that": f"this {noun}", "kind": kind, "version": version, "colon": colon,
                         "either": either}
                parts = [grant.format(**given), _WARRANTY.format(**given)]
                found += [(license, "\n\n".join([*parts, r.format(**given)])) for r in _RECEIVED]
                found += [(license, parts[0]), (license, "\n\n".join(parts))]
    return found


def wrapped(text: str) -> list[str]:
    """A text as it is, with each paragraph on one line, and a short one wrapped at the usual widths."""
    parts = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n[ \t]*\n", text)]
    widths = WIDTHS if len(text) < SHORT else ()
    return [text, "\n\n".join(parts), *("\n\n".join(textwrap.fill(p, w, break_on_hyphens=False) for p in parts) for w in widths)]


def texts() -> list[tuple[str, str]]:
    """Whole licences."""
    found = []
    for path in sorted(FOLDER.glob("*.txt")):
        license, body = path.stem.partition("@")[0], path.read_text(encoding="utf-8")
        found += [(license, f"{t}\n\n{w}".strip()) for t in TITLES.get(license, ("",)) for w in wrapped(body)]
        if END in body:
            before = body[:body.index(END)]
            found += [(license, w) for part in (before, before + END) for w in wrapped(part)]
    return found


def rows() -> list[tuple[str, str]]:
    """Licence and text of every entry; several may have one canonical form."""
    return notices() + [(license, w) for license, text in headers() for w in wrapped(text)] + texts()
