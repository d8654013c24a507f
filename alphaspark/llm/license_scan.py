"""License scans: how much better a block compresses with a license text as raw dictionary."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Parts that several licenses share.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Notices, grants and the conditions of short licenses by SPDX id, as their texts word them.  The first
#: line holds short forms, each of its own.
TEMPLATES: dict[str, str] = {
    "MIT": """Released under the MIT License. Licensed under the MIT License. This project is licensed under the terms of the MIT license. The MIT License (MIT). License: MIT. SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0. Released under the Apache License 2.0. License: Apache 2.0. SPDX-License-Identifier: Apache-2.0
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """Licensed under the Mozilla Public License 2.0. Licensed under the Mozilla Public License, version 2.0. Licensed under MPL 2.0. SPDX-License-Identifier: MPL-2.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause": f"""Licensed under the BSD 3-Clause License. Licensed under the 3-Clause BSD License. Released under the BSD License. Licensed under the New BSD License. SPDX-License-Identifier: BSD-3-Clause
{_BSD}
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_AS_IS}""",
    "BSD-2-Clause": f"""Licensed under the BSD 2-Clause License. Licensed under the 2-Clause BSD License. Licensed under the Simplified BSD License. SPDX-License-Identifier: BSD-2-Clause
{_BSD}
{_BSD_AS_IS}""",
    "ISC": f"""Licensed under the ISC License. Released under the ISC License. License: ISC. SPDX-License-Identifier: ISC
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
{_AS_IS}""",
    "0BSD": f"""Licensed under the Zero-Clause BSD License. Licensed under the BSD Zero Clause License. SPDX-License-Identifier: 0BSD
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
{_AS_IS}""",
    "Unlicense": """Released under the Unlicense. Licensed under the Unlicense. SPDX-License-Identifier: Unlicense
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. For more information, please refer to <http://unlicense.org/>""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0. Licensed under the Boost Software License 1.0. SPDX-License-Identifier: BSL-1.0
Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""",
    "Zlib": """Licensed under the zlib License. Released under the zlib/libpng license. SPDX-License-Identifier: Zlib
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "Artistic-2.0": """Licensed under the Artistic License 2.0. Licensed under the Artistic License, version 2.0. SPDX-License-Identifier: Artistic-2.0
This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.""",
    "CC0-1.0": """Licensed under CC0 1.0. License: CC0. SPDX-License-Identifier: CC0-1.0
This work is dedicated to the public domain under the Creative Commons Zero 1.0 Universal Public Domain Dedication. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. http://creativecommons.org/publicdomain/zero/1.0/""",
}
#: What the words of a stretch must hold to name a license, in lower case and joined by spaces; a text
#: without the name or the version of its license is told by wording that only it has.
KEYS: dict[str, str] = {
    "MIT": r"(?<![-\w])mit\b(?!-)|to deal in the software without restriction|the above copyright notice and this permission notice shall be included in all copies",
    "Apache-2.0": r"\bapache(?: software)? license (?:version |v )?v?2(?:\.0)?(?![.\d])|\bapache[- ]v?2(?:\.0)?(?![.\d])|unless required by applicable law or agreed to in writing",
    "MPL-2.0": r"\bmozilla public license (?:version |v )?v?2\.0|\bmpl[-/ ]?v?2(?:\.0)?\b",
    "BSD-3-Clause": r"\bbsd-3-clause\b(?!-)|\b(?:bsd 3-clause|3-clause bsd|new bsd|modified bsd|revised bsd)\b|(?<!0-clause )(?<!2-clause )(?<!4-clause )(?<!simplified )(?<!zero-clause )\bbsd license\b|neither the names? of",
    "BSD-2-Clause": r"\bbsd-2-clause\b(?!-)|\b(?:bsd 2-clause|2-clause bsd|simplified bsd|freebsd license)\b|^(?!.*neither the names? of).*redistributions in binary form must reproduce",
    "ISC": r"\bisc license\b|(?:identifier|license) isc\b|or without fee is hereby granted provided that the above copyright notice",
    "0BSD": r"\b0bsd\b|zero-clause bsd|bsd zero[- ]clause|or without fee is hereby granted(?! provided)",
    "Unlicense": r"\bunlicense\b|free and unencumbered software",
    "BSL-1.0": r"\bboost software license\b|\bbsl-1\.0|any person or organization obtaining a copy of the software",
    "Zlib": r"\bzlib(?:/libpng)? license\b|identifier zlib\b|origin of this software must not be misrepresented|permission is granted to anyone to use this software for any purpose",
    "Artistic-2.0": r"\bartistic license (?:version |v )?v?2\.0|\bartistic-2\.0",
    "CC0-1.0": r"\bcc0\b|creative commons zero|publicdomain/zero/",
}


def _add_versions() -> None:
    """Licenses that differ in a few words: their keys hold the name and the version in one place."""
    rest = r"(?: (?!v?\d)\S+){0,16} v?"
    for short, full, what, versions in (
        ("GPL", "General", "program", "23"), ("LGPL", "Lesser General", "library", ("2.1", "3")), ("LGPL", "Library General", "library", "2"), ("AGPL", "Affero General", "program", "3"),
        ("EPL", "Eclipse", "", "12"), ("GFDL", "Free Documentation", "", ("1.2", "1.3")),
    ):
        for v in versions:
            dotted = v if "." in v else f"{v}.0"
            name, spdx, low = f"{'' if short == 'EPL' else 'GNU '}{full} {'License' if short == 'GFDL' else 'Public License'}", f"{short}-{dotted}", short.lower()
            forms = [f"This work is licensed under the {name}, version {v}.", f"Licensed under the {name} v{dotted}.", f"Licensed under the {name} {v}.", f"Licensed under the {short}v{v}.", f"Licensed under the {short} {v}.", f"License: {spdx}.", *(f"SPDX-License-Identifier: {spdx}{end}." for end in ("", "-only", "-or-later", "+"))]
            grant = f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
            if short == "EPL":
                grant = f"This program and the accompanying materials are made available under the terms of the {name} v{dotted} which is available at https://www.eclipse.org/legal/epl-{dotted}/"
            elif short == "GFDL":
                grant = f"Permission is granted to copy, distribute and/or modify this document under the terms of the {name}, Version {v} or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."
            TEMPLATES[spdx] = "\n".join([" ".join(forms), grant])
            ver = re.escape(v) + r"(?:\.0)?(?:\+|-only|-or-later)?(?![-.\w])"
            KEYS[spdx] = rf"(?<![-\w]){low}[- ]?v?{ver}|(?<![-\w]){low}(?: license)? version {ver}|{'' if short == 'EPL' else 'gnu '}{full.lower()} {'license' if short == 'GFDL' else 'public license'}{rest}{ver}"
    for short, full in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v in ("4.0", "3.0"):
            kind, low, spaced = "International" if v == "4.0" else "Unported", short.lower(), full.replace("-", " ")
            TEMPLATES[f"CC-{short}-{v}"] = f"""Licensed under CC {short} {v}. This work is licensed under a Creative Commons {full} {v} {kind} License. Licensed under the Creative Commons {full} {v} {kind} License. Licensed under CC-{short}-{v}. SPDX-License-Identifier: CC-{short}-{v}
To view a copy of this license, visit http://creativecommons.org/licenses/{low}/{v}/"""
            names = "[- ]".join(w + ("s" if w == "noderiv" else "") for w in spaced.lower().split())
            KEYS[f"CC-{short}-{v}"] = rf"\bcc[- ]{low.replace('-', '[- ]')}[- ]v?{re.escape(v)}(?![.\d])|creative commons {names} (?:version )?v?{re.escape(v)}(?![.\d])|creativecommons\.org/licenses/{low}/{re.escape(v)}"


_add_versions()
#: What makes the mention of a license a grant, in its sentence and not after it.
_GRANT = re.compile(r"\b(?:under|licen[sc]ed|licen[sc]e:|spdx|terms|released|distributed|dedicated|available)")
#: A stretch of so many words needs no grant; longer units are cut.
LONG, UNIT_WORDS = 10, 200

#: What a block must hold, in lower case, to be looked at.
CUES = ("licen", "copyright", "spdx", "creative commons", "permission is hereby", "redistribut", "public domain", "gnu ", "permission to use", "permission is granted", "unencumbered", "eclipse public", "cc by", "cc-by", "cc0")
_CUE = re.compile("|".join(map(re.escape, CUES)), re.I)
_WORD = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9./:+-]*[A-Za-z0-9+])?")
_SENTENCE = re.compile(r"(?<=[.!?;])[\"')\]]*[ \t]+(?=[\"'(\[]*[A-Z])")
#: Units next to a unit with a cue belong to its block if so many of their words are words of the templates.
FAMILIAR = 0.75


def words_of(text: str) -> list[str]:
    return [plain_word(w) for w in _WORD.findall(text)]


def plain_word(word: str) -> str:
    """In lower case; addresses without their scheme."""
    low = word.lower()
    return re.sub(r"^https?://(?:www\.)?", "", low) if low.startswith("http") else low


class Scanner:
    """Finds the stretch of a block that a template words best and compresses it with and without each template."""

    def __init__(self, templates: dict[str, str], confirm: float, level: int = 3) -> None:
        self.names = sorted(templates)
        self.confirm = confirm
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False)
        self.primed = [zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(templates[n].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n in self.names]
        self.words = [words_of(templates[n]) for n in self.names]
        self.keys = [re.compile(KEYS[n]) if n in KEYS and templates[n] == TEMPLATES.get(n) else None for n in self.names]
        self.phrases = [self.short_forms(templates[n]) for n in self.names]
        self.vocabulary = frozenset(w for own in self.words for w in own if len(w) > 2)
        self.seen: dict[str, tuple] = {}

    @staticmethod
    def short_forms(template: str) -> list[int]:
        """For each word the number of its sentence in a template's first line, where each is a form of its own; else -1."""
        first, *others = template.split("\n", 1)
        forms = [i for i, part in enumerate(_SENTENCE.split(first)) for _ in words_of(part)] if others else [-1] * len(words_of(first))
        return forms + [-1] * (len(words_of(template)) - len(forms))

    def units(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, long) of each line, of the sentences of a line, and of pieces of sentences without an end."""
        out, at = [], 0
        for line in text.split("\n"):
            ends = [m.end() for m in _SENTENCE.finditer(line)] if _CUE.search(line) or len(line) > 2000 else []
            for a, b in zip([0, *ends], [*ends, len(line)], strict=True):
                cuts = [m.start() for m in _WORD.finditer(line, a, b)][UNIT_WORDS::UNIT_WORDS] if b - a > 2 * UNIT_WORDS else []
                out += [(at + x, at + y, bool(cuts)) for x, y in zip([a, *cuts], [*cuts, b], strict=True)]
            at += len(line) + 1
        return out

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each run of units with cues and of familiar units next to them, over up to two blank lines."""
        if not _CUE.search(text):
            return []
        units, out, end = self.units(text), [], -1
        cued = [bool(_CUE.search(text, a, b)) for a, b, _ in units]
        blank = [not text[a:b].strip() for a, b, _ in units]
        near = lambda k: cued[k] or self.familiar(text[units[k][0] : units[k][1]])

        def reached(i: int, step: int) -> int:
            """The unit next to unit ``i`` if it belongs to its block, else ``i``."""
            k = i + step
            for _ in range(2):
                if 0 <= k < len(units) and blank[k]:
                    k += step
            if not end < k < len(units) or blank[k]:
                return i
            return k if near(k) or (k == i + step and units[i][2] and units[k][2] and cued[i]) else i

        for i in range(len(units)):
            if i <= end or not cued[i]:
                continue
            first = last = i
            while (k := reached(first, -1)) != first:
                first = k
            while (k := reached(last, 1)) != last:
                last = k
            out.append((units[first][0], units[last][1]))
            end = last
        return out

    def familiar(self, line: str) -> bool:
        own = [w for w in words_of(line) if len(w) > 2]
        # The few words that wrapping leaves on a line must all be.
        return bool(own) and sum(w in self.vocabulary for w in own) >= (FAMILIAR * len(own) if len(own) >= 4 else len(own))

    def best(self, block: str) -> tuple | None:
        """(name, plain size, primed size, second name, its size, share, missing, added) of the first stretch, or None."""
        found = self.stretches(block)
        return found[0][2:] if found else None

    def stretches(self, block: str) -> list[tuple]:
        """(start, end, *what best() returns) of each licensed stretch of a block, in order: the one that a template reduces
        most, then those of what lies before and behind it."""
        if block in self.seen:
            return self.seen[block]
        spans = [m.span() for m in _WORD.finditer(block)]
        own, found, todo = [plain_word(block[a:b]) for a, b in spans], [], [(0, len(spans))]
        while todo:
            low, high = todo.pop()
            hit = self.stretch(block, spans, own, low, high)
            if hit:
                first, last, *verdict = hit
                found.append((spans[first][0], self.end(block, spans[last][1]), *verdict))
                # "A OR B" names two.
                todo += [(low, first), (last + 1 + (own[last + 1 : last + 2] in (["or"], ["and"])), high)]
        if len(self.seen) >= 1 << 16:
            self.seen.clear()
        self.seen[block] = found = sorted(found)
        return found

    @staticmethod
    def end(block: str, at: int) -> int:
        """Behind the punctuation after a word."""
        return at + len(re.match(r"[^\w\s]*", block[at : at + 8])[0])

    def stretch(self, block: str, spans: list[tuple[int, int]], own: list[str], low: int, high: int) -> tuple | None:
        """(first word, last word, *verdict) of the stretch among words low .. high - 1 that a template reduces most."""
        part = own[low:high]
        joined, best, result = " ".join(part), (0, 0.0, 0), None
        for i, key in enumerate(self.keys):
            if not part or (key and not key.search(joined)):
                continue
            first, last, share, missing, added = self.differences(part, self.words[i], self.phrases[i])
            if share < self.confirm or not self.evidence(block, spans, own, low + first, low + last, i, round(share * (last - first + 1))):
                continue
            data = block[spans[low + first][0] : self.end(block, spans[low + last][1])].encode()
            plain, size = len(self.plain.compress(data)), len(self.primed[i].compress(data))
            # Exact wording decides among the templates that reduce as much as the best, or nearly so.
            gain = plain - size
            if gain <= 0 or not (gain > best[0] + 4 or (gain >= best[0] - 4 and (share, last - first) > best[1:])):
                continue
            best, result = (gain, share, last - first), (low + first, low + last, i, data, plain, size, share, missing, added)
        if result is None:
            return None
        first, last, i, data, plain, size, share, missing, added = result
        other, its = min(((len(c.compress(data)), k) for k, c in enumerate(self.primed) if k != i), default=(plain, i))[::-1]
        return first, last, self.names[i], plain, size, self.names[other], its, share, missing, added

    def evidence(self, block: str, spans: list[tuple[int, int]], own: list[str], first: int, last: int, i: int, same: int) -> bool:
        """Whether a stretch names the template's license, and grants it: by its length, by a word in its
        sentence, or as a line of its own."""
        if self.keys[i] is None:
            return same >= min(4, len(self.words[i]))
        stretch = " ".join(own[first : last + 1])
        # Two words more, so that "simplified bsd license" isn't cut to "bsd license".
        if not any(m.end() > (len(" ".join(own[max(0, first - 2) : first])) if first else 0) for m in self.keys[i].finditer(" ".join(own[max(0, first - 2) : last + 1]))) or not self.keys[i].search(stretch):
            return False
        if same >= LONG:
            return True
        start = max([block.rfind("\n", 0, spans[first][0]) + 1, *(m.end() for m in _SENTENCE.finditer(block, max(0, spans[first][0] - 400), spans[first][0] + 1))])
        granted = _GRANT.search(block[start : spans[last][1]].lower())
        if granted:
            return same >= 2 or "spdx" in block[start : spans[last][1]].lower()
        stop = block.find("\n", spans[last][1])
        return same >= 2 and last - first + 1 >= self.confirm * len(words_of(block[start : stop if stop >= 0 else len(block)]))

    def differences(self, own: list[str], template: list[str], forms: list[int]) -> tuple[int, int, float, list[str], list[str]]:
        """First and last word of the stretch of ``own`` that fits the template best, the share of its words that stand in
        the template in order, and the words that the template's stretch has and it lacks, and the other way round."""
        parts = [m for m in SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks() if m.size]
        # The stretch with the largest sum, where a word of the template counts 1 - confirm, any other -confirm, and words left
        # out confirm - 1, up to 20 a place: a text may leave out sentences.
        top, total, start, chosen = 0.0, 0.0, 0, (0, -1)
        for k, m in enumerate(parts):
            if k:
                x = parts[k - 1]
                left_out = sum(f < 0 for f in forms[x.b + x.size : m.b])
                total -= self.confirm * (m.a - x.a - x.size) + (1 - self.confirm) * min(20, left_out)
            if total <= 0:
                total, start = 0.0, k
            total += max(1 - self.confirm, 1e-9) * m.size
            if total > top:
                top, chosen = total, (start, k)
        if not parts:
            return 0, -1, 0.0, [], []
        # And its neighbours that are longer than what lies between, while enough of all words still fit.
        a, b = chosen
        for step in (-1, 1):
            while 0 <= (k := (a if step < 0 else b) + step) < len(parts):
                x, y = parts[min(k, k - step)], parts[max(k, k - step)]
                first, last = min(parts[a].a, x.a), max(parts[b].a + parts[b].size, y.a + y.size)
                if parts[k].size < max(y.a - x.a, y.b - x.b) - x.size or sum(m.size for m in parts[min(a, k) : max(b, k) + 1]) < self.confirm * (last - first):
                    break
                a, b = min(a, k), max(b, k)
        parts = parts[a : b + 1]
        first, last = parts[0].a, parts[-1].a + parts[-1].size - 1
        used = {forms[j] for m in parts for j in range(m.b, m.b + m.size)} | {-1}
        missing, added, at, there = [], [], parts[0].a, parts[0].b
        for m in parts:
            added += own[at : m.a]
            missing += [template[j] for j in range(there, m.b) if forms[j] in used]
            at, there = m.a + m.size, m.b + m.size
        return first, last, sum(m.size for m in parts) / (last - first + 1), missing, added


def _scan(templates: dict[str, str], confirm: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, confirm)
        for _, (ids, texts) in chunks(batches):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                for start, end in scanner.blocks(text or ""):
                    block = text[start:end]
                    for a, b, name, plain, primed, second, second_size, share, missing, added in scanner.stretches(block):
                        first, last = text.count("\n", 0, start + a), text.count("\n", 0, start + b)
                        rows.append((doc, first, last, name, plain, primed, second, second_size, round(share, 6), not missing and not added, json.dumps({"missing": missing, "added": added}), block[a:b]))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], SCHEMA.replace(",", "").split()[::2])

    return run


SCHEMA = "doc_id long, first_line int, last_line int, license string, plain_size int, primed_size int, runner_up string, runner_up_size int, share double, exact boolean, differences string, block string"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, confirm: float = 0.8) -> DataFrame:
    """One row for each licensed stretch of ``docs`` (doc_id, text), with the columns of SCHEMA.

    A block is a run of lines (or sentences of a line) with a cue and those next to it that are worded like the templates.
    For each template that the block names (KEYS), its stretch is the part of the block in which at least ``confirm`` of the
    words stand in the template in order; it is compressed alone and with the template as zstandard raw dictionary.
    Stretches are ranked by the reduction, and of the best (within 4 bytes) the one whose wording fits best wins;
    ``differences`` lists words missing from and added to it.  The block is cut around it and the rest scanned again.

    Texts are scanned whole; those without any cue don't leave the JVM.  Null and empty texts hold no license.  Null
    ids and repeated rows are reported row by row.  No rows: no rows.
    """
    low = F.lower("text")
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(low, F.lit(c))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(cue)
    return own.mapInArrow(_scan(dict(TEMPLATES if templates is None else templates), confirm), SCHEMA)
