"""Licence recognition by sentences.

A text is cut into pieces at line ends and at full stops, question and exclamation marks and
colons before white space; a piece is normalised (lower case, letters and digits only, single
spaces), which also drops comment leaders.  A sentence is the longest run of pieces that is known:
so wrapped sentences are found, sentences with a full stop in the midst, and notices on a line of
their own beside lines without a full stop.  Known licence sentences are replaced by their identifiers.

The sequence of a document's identifiers, in their order and without other sentences, is matched
against ordered rules.  A rule names identifiers that must stand next to one another in the
sequence; those with a question mark may be absent.  Rules are tried in order, at every place from
the first on, and identifiers used by a rule are not used again.

Defined results: null and empty texts and texts without known sentences have no licences;
identifiers that no rule uses are reported as ``unmatched``; repeated sentences match again;
each row gets a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_columns

#: Known sentences (fixed values: wording of public licences and notices) by identifier.
SENTENCES = {
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["The software is provided \"as is\", without warranty of any kind, express or implied.", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."],
    "mit-liability": ["In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."],
    "isc-title": ["ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-as-is": ["The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."],
    "isc-liability": ["In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."],
    "apache-2-title": ["Apache License Version 2.0, January 2004"],
    "apache-2-notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "This project is licensed under the Apache License 2.0."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "bsd-3-notice": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License."],
    "bsd-title": ["BSD 2-Clause License", "BSD 3-Clause License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-as-is": ["This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."],
    "bsd-liability": ["In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."],
    "gpl-3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl-2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl-21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl-3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl-3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gpl-3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "lgpl-21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "no-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."],
    "gpl-copy": [
        "You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "You should have received a copy of the GNU Lesser General Public License along with this program.", "You should have received a copy of the GNU Affero General Public License along with this program.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>.",
    ],
    "gpl-link": ["If not, see <https://www.gnu.org/licenses/>.", "If not, see <http://www.gnu.org/licenses/>."],
    "mpl-2-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl-2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl-1-title": ["Eclipse Public License - v 1.0"],
    "epl-1-notice": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl-2-title": ["Eclipse Public License - v 2.0"],
    "epl-2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."],
    "cddl-title": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE Version 1.0"],
    "cddl-notice": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").", "You may not use this file except in compliance with the License."],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0."],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "artistic-2-title": ["The Artistic License 2.0"],
    "ofl-title": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "ofl-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "eupl-notice": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");"],
    "psf-title": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "busl-title": ["Business Source License 1.1"],
    "sspl-title": ["Server Side Public License VERSION 1, OCTOBER 16, 2018"],
    "cc0-title": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
    "cc0-notice": ["Licensed under CC0 1.0.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "cc-by-4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-4-notice": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa-4-notice": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd-4-notice": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc-by-3-notice": ["This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "cc-by-sa-3-notice": ["This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "all-rights": ["All rights reserved."],
}
#: Rules in the order in which they are tried: identifiers that stand next to one another, those with a
#: question mark if they are there.
RULES = [
    ("MIT", ["mit-title?", "all-rights?", "mit-grant", "mit-keep", "as-is", "mit-liability?"]),
    ("MIT-0", ["all-rights?", "mit-0-grant", "as-is", "mit-liability?"]),
    ("MIT", ["mit-title?", "mit-notice"]),
    ("MIT", ["mit-title"]),
    ("ISC", ["isc-title?", "all-rights?", "isc-grant", "isc-as-is?", "isc-liability?"]),
    ("ISC", ["isc-title"]),
    ("0BSD", ["all-rights?", "0bsd-grant", "isc-as-is?", "isc-liability?"]),
    ("Apache-2.0", ["apache-2-title?", "all-rights?", "apache-2-notice", "apache-copy?", "apache-as-is?", "apache-see?"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("AGPL-3.0-or-later", ["agpl-3-free", "no-warranty?", "gpl-see?", "gpl-copy?", "gpl-link?"]),
    ("LGPL-2.1-or-later", ["lgpl-21-free", "no-warranty?", "gpl-see?", "gpl-copy?", "gpl-link?"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free", "no-warranty?", "gpl-see?", "gpl-copy?", "gpl-link?"]),
    ("GPL-3.0-or-later", ["gpl-free", "no-warranty?", "gpl-see?", "gpl-copy?", "gpl-link?"]),
    ("GPL-2.0-or-later", ["gpl-2-free", "no-warranty?", "gpl-see?", "gpl-copy?", "gpl-link?"]),
    ("GPL-2.0-only", ["gpl-2-only", "no-warranty?", "gpl-see?", "gpl-copy?", "gpl-link?"]),
    ("GPL-3.0-only", ["gpl-3-notice"]),
    ("GPL-3.0", ["gpl-3-title"]),
    ("GPL-2.0", ["gpl-2-title"]),
    ("LGPL-2.1", ["lgpl-21-title"]),
    ("LGPL-3.0", ["lgpl-3-title"]),
    ("AGPL-3.0", ["agpl-3-title"]),
    ("BSD-4-Clause", ["all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name?", "bsd-as-is?", "bsd-liability?"]),
    ("BSD-3-Clause", ["bsd-title?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is?", "bsd-liability?"]),
    ("BSD-2-Clause", ["bsd-title?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is?", "bsd-liability?"]),
    ("BSD-3-Clause", ["all-rights?", "bsd-3-notice"]),
    ("MPL-2.0", ["mpl-2-title?", "mpl-2-notice", "mpl-2-copy?"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("EPL-1.0", ["epl-1-notice"]),
    ("EPL-1.0", ["epl-1-title"]),
    ("EPL-2.0", ["epl-2-notice"]),
    ("EPL-2.0", ["epl-2-title"]),
    ("CDDL-1.0", ["cddl-title"]),
    ("CDDL-1.0", ["cddl-notice"]),
    ("Unlicense", ["unlicense-free", "unlicense-grant?"]),
    ("BSL-1.0", ["boost-title?", "boost-grant", "mit-keep?"]),
    ("BSL-1.0", ["boost-notice"]),
    ("BSL-1.0", ["boost-title"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("WTFPL", ["wtfpl-title"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("Artistic-2.0", ["artistic-2-title"]),
    ("OFL-1.1", ["ofl-notice", "ofl-title?"]),
    ("OFL-1.1", ["ofl-title"]),
    ("EUPL-1.2", ["eupl-notice"]),
    ("PSF-2.0", ["psf-title"]),
    ("BUSL-1.1", ["busl-title"]),
    ("SSPL-1.0", ["sspl-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4-notice"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-3.0", ["cc-by-sa-3-notice"]),
    ("CC-BY-3.0", ["cc-by-3-notice"]),
    ("Proprietary", ["all-rights"]),
]
# A tag names its licence itself.
for _name in sorted({name for name, _ in RULES} - {"Proprietary"}):
    SENTENCES[f"spdx-{_name}"] = [f"SPDX-License-Identifier: {_name}"]
    RULES.append((_name, [f"spdx-{_name}"]))
_CUT = re.compile(r"\n|(?<=[.!?:])\s")
_OTHER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def known(sentences: dict[str, list[str]]) -> dict[str, str]:
    return {normalise(s): i for i, some in sentences.items() for s in some}


def beginnings(table: dict[str, str]) -> frozenset[str]:
    """The first words of known sentences, one word, two words and so on."""
    return frozenset(s[: m.start()] for s in table for m in re.finditer(" |$", s))


def identifiers(text: str, table: dict[str, str], begins: frozenset[str]) -> list[str]:
    """Identifiers of a text's sentences, in order.  Only pieces whose first word begins a known
    sentence are normalised in full, and runs go on while they begin one; the others can't be known."""
    out, pieces, at = [], _CUT.split(text), 0
    while at < len(pieces):
        head, found, end = _WORD.search(pieces[at]), None, at + 1
        # Lower-casing can split a word, so only the part before that is held against the first words.
        if head and normalise(head[0]).split(" ", 1)[0] in begins:
            run = ""
            for k in range(at, len(pieces)):
                run = f"{run} {normalise(pieces[k])}".strip()
                if run in table and (k == at or _WORD.search(pieces[k])):
                    found, end = table[run], k + 1
                if run not in begins:
                    break
        if found:
            out.append(found)
        at = end
    return out


def _run(ids: list[str], used: list[bool], at: int, need: list[str]) -> list[int]:
    """The places that a rule takes from place ``at`` on, none if it does not fit there."""
    taken = []
    for part in need:
        if at < len(ids) and not used[at] and ids[at] == part.rstrip("?"):
            taken.append(at)
            at += 1
        elif not part.endswith("?"):
            return []
    return taken


def recognise(ids: list[str], rules: list[tuple[str, list[str]]]) -> tuple[list[str], list[str]]:
    """(licences in the order of their first sentence, identifiers left over)."""
    used, found, own = [False] * len(ids), [], set(ids)
    for name, need in rules:
        if all(part.endswith("?") or part in own for part in need):
            for at in range(len(ids)):
                taken = _run(ids, used, at, need)
                if taken:
                    for i in taken:
                        used[i] = True
                    found.append((at, name))
    return [name for _, name in sorted(found)], [x for x, u in zip(ids, used, strict=True) if not u]


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, sentence_ids, licences, unmatched) of every text; arrays of strings."""
    table, rules = known(sentences or SENTENCES), rules or RULES
    begins = beginnings(table)

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        for c in columns:
            ids = [identifiers(t or "", table, begins) for t in c["text"]]
            got = [recognise(x, rules) if x else ([], []) for x in ids]
            yield {"doc_id": c["doc_id"], "sentence_ids": ids, "licences": [g[0] for g in got], "unmatched": [g[1] for g in got]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, sentence_ids array<string>, licences array<string>, unmatched array<string>")
