"""License scans by conditional compression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of common license notices and references.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License. Licensed under the MIT license. This project is licensed under the terms of the MIT License. SPDX-License-Identifier: MIT "
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License. SPDX-License-Identifier: Apache-2.0"
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: GPL-3.0-or-later GPL-3.0-only"
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2. This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. SPDX-License-Identifier: GPL-2.0-or-later GPL-2.0-only"
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3. This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: LGPL-3.0-or-later"
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors "
        "may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES SPDX-License-Identifier: BSD-3-Clause"
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1. This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. SPDX-License-Identifier: LGPL-2.1-or-later LGPL-2.1-only"
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: AGPL-3.0-or-later AGPL-3.0-only"
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License. SPDX-License-Identifier: BSD-2-Clause Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
    ),
    "ISC": (
        "Licensed under the ISC License. Released under the ISC license. SPDX-License-Identifier: ISC Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "Unlicense": (
        "Released under the Unlicense. SPDX-License-Identifier: Unlicense This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. For more information, please refer to http://unlicense.org"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. Licensed under the Mozilla Public License 2.0. SPDX-License-Identifier: MPL-2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License. SPDX-License-Identifier: CC-BY-4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. SPDX-License-Identifier: CC-BY-SA-4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. SPDX-License-Identifier: CC-BY-NC-4.0",
    "CC0-1.0": "Released under CC0 1.0. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. SPDX-License-Identifier: CC0-1.0",
    "Proprietary": "All rights reserved. Copyright. No part of this work may be reproduced without permission. Confidential and proprietary.",
}

#: Lower-case wordings one of which every block of interest has.
CUES = (b"licen", b"copyright", b"spdx-", b"all rights reserved", b"permission is hereby", b"cc by", b"cc0", b"creative commons", b"redistribution", b"public domain", b'"as is"')
# Words that tell licenses of like wording apart; versions and identifiers do so by their form.
DECISIVE = {"lesser", "affero", "sharealike", "noncommercial", "noderivatives", "attribution-sharealike", "attribution-noncommercial", "attribution-noderivatives", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd", "2-clause", "3-clause", "4-clause", "neither"}
_VERSION = re.compile(r"v?(\d(?:\.\d+)*?)(?:\.0)*")
_IDENTIFIER = re.compile(r"(?:[al]?gpl|bsd|cc-by|cc0|mpl|apache|epl|artistic)-.*\d.*")

_SENTENCE = re.compile(rb"(?<=[.!?:;]) ")
_WORDS = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")


def blocks(text: bytes, longest: int = 400, gap: int = 2) -> list[tuple[int, int, bool]]:
    """Spans of candidate blocks: lines with a cue, joined over at most gap lines without; long lines go by sentences.

    Comparison takes time in the square of a block's length, so one of more than 4 * longest bytes is cut between lines;
    the third value is true where a block goes on from the one before.
    """
    low = text.lower()
    if not any(c in low for c in CUES):
        return []
    spans, a = [], 0
    for line in low.split(b"\n"):
        b = a + len(line)
        if len(line) > longest:
            ends = [a + m.end() for m in _SENTENCE.finditer(line)] + [b]
            spans += zip([a, *ends], ends, strict=False)
        else:
            spans.append((a, b))
        a = b + 1
    out, last = [], -gap - 2
    for k, (a, b) in enumerate(spans):
        if any(c in low[a:b] for c in CUES):
            near = k - last <= gap + 1
            if near and b - out[-1][0] <= 4 * longest:
                out[-1] = (out[-1][0], b, out[-1][2])
            else:
                out.append((a, b, near))
            last = k
    return out


def decisive(words: list[str]) -> set[str]:
    """Versions (one figure, with or without others behind points), identifiers and DECISIVE words among lower-case words."""
    out = set()
    for w in words:
        if m := _VERSION.fullmatch(w):
            out.add(m[1])
        elif w in DECISIVE or _IDENTIFIER.fullmatch(w):
            out.add(w)
    return out


class Templates:
    """Compressors for blocks with each template as their dictionary, made once in a worker."""

    def __init__(self, templates: dict[str, str]):
        options = {"level": 6, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.bare = zstandard.ZstdCompressor(**options)
        self.given = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for k, t in templates.items()}
        self.words = {k: _WORDS.findall(t.lower()) for k, t in templates.items()}
        self.decisive = {k: decisive(w) for k, w in self.words.items()}

    def ranked(self, block: bytes) -> list[tuple[float, str]]:
        """(share of the compressed size that the template saves, name), best first."""
        alone = len(self.bare.compress(block))
        return sorted(((round(1 - len(c.compress(block)) / alone, 4), k) for k, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def differences(self, block: bytes, name: str) -> tuple[int, list[str], list[str]]:
        """Equal words, words of the template's matching stretch that the block lacks, and words that only the block has."""
        own, theirs = _WORDS.findall(block.decode(errors="replace").lower()), self.words[name]
        # the stretch of the template that the block follows: around its longest common run
        best = SequenceMatcher(None, theirs, own, autojunk=False).find_longest_match()
        low, high = max(0, best.a - best.b), min(len(theirs), best.a - best.b + len(own))
        equal, missing, extra = 0, [], []
        for tag, a, b, c, d in SequenceMatcher(None, theirs[low:high], own, autojunk=False).get_opcodes():
            if tag == "equal":
                equal += b - a
            else:
                missing += theirs[low + a : low + b]
                extra += own[c:d]
        return equal, missing, extra


def parts(text: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of the lines of a block that have a cue, and of their sentences that have one, where those are not all of it."""
    low, out = text[a:b].lower(), []
    for m in re.finditer(rb"[^\n]+", low):
        ends = [m.start() + x.end() for x in _SENTENCE.finditer(m[0])]
        sentences = list(zip([m.start(), *ends], [*ends, m.end()], strict=True))
        for c, d in dict.fromkeys([m.span(), *sentences]):
            if (c, d) != (0, b - a) and any(x in low[c:d] for x in CUES):
                out.append((a + c, a + d))
    return out


def _best(block: bytes, templates: Templates, least_saved: float, most_changed: float) -> list[tuple]:
    """(share of changed words, -saved, license, equal, missing, extra) of each template that passes, fewest changes first."""
    out = []
    for saved, name in templates.ranked(block):
        if saved < least_saved:
            break
        equal, missing, extra = templates.differences(block, name)
        if decisive(missing) - decisive(_WORDS.findall(block.decode(errors="replace").lower())) or decisive(extra) - templates.decisive[name]:
            continue  # another version, or another clause
        changed = (len(missing) + len(extra)) / max(1, equal + len(missing) + len(extra))
        if changed <= most_changed:
            out.append((changed, -saved, name, equal, missing, extra))
    return sorted(out, key=lambda x: x[:3])


def found_in(text: bytes, templates: Templates, least_saved: float = 0.25, most_changed: float = 0.4) -> list[dict]:
    """Licenses of a text's candidate blocks, and of the lines and sentences with a cue in them.

    Of the templates that save enough, the one with the fewest wording differences wins, if at most most_changed of the
    words differ and none that decides does: a version, an identifier or a word of DECISIVE that only one of the two has
    rules the license out. A part counts where its winner is no license of what holds it, or fits strictly better than that one.
    A block that goes on from one of the same license lengthens its row: words add up, saved is the mean by bytes.
    """
    out: list[dict] = []
    whole = None  # the row of the block before
    for a, b, goes_on in blocks(text):
        before, whole = whole if goes_on else None, None
        taken: list[tuple[int, int, str]] = []
        for c, d in [(a, b), *parts(text, a, b)]:
            best = _best(text[c:d].strip(), templates, least_saved, most_changed)
            around = {name for p, q, name in taken if p <= c and d <= q}
            if not best or any(x[0] == best[0][0] and x[2] in around for x in best):
                continue
            _, saved, name, equal, missing, extra = best[0]
            taken.append((c, d, name))
            row = {"first_byte": c, "end_byte": d, "license": name, "saved": -saved, "n_equal": equal, "missing": " ".join(missing), "extra": " ".join(extra), "verbatim": not missing and not extra}
            if (c, d) != (a, b):
                out.append(row)
            elif before and before["license"] == name:
                whole = _lengthened(before, row)
            else:
                whole = row
                out.append(row)
    return out


def _lengthened(row: dict, more: dict) -> dict:
    """row, changed in place, with the block of the same license that goes on from it."""
    n, m = row["end_byte"] - row["first_byte"], more["end_byte"] - more["first_byte"]
    row |= {
        "end_byte": more["end_byte"], "saved": round((row["saved"] * n + more["saved"] * m) / (n + m), 4), "n_equal": row["n_equal"] + more["n_equal"],
        "missing": f"{row['missing']} {more['missing']}".strip(), "extra": f"{row['extra']} {more['extra']}".strip(), "verbatim": row["verbatim"] and more["verbatim"],
    }
    return row


_FOUND = [("first_byte", pa.int64()), ("end_byte", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("n_equal", pa.int64()), ("missing", pa.string()), ("extra", pa.string()), ("verbatim", pa.bool_())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each licensed block of a document: doc_id, first_byte and end_byte in its UTF-8 text, license, saved (the
    share of the block's compressed size that the template as a raw dictionary saves), n_equal, missing and extra words,
    verbatim.

    Whole texts, however long, are read where they lie; nothing is shuffled. A notice of any length has one row; it is
    compared in pieces of about 1,600 bytes, and all templates that save enough word by word. Null and blank texts have
    no blocks; a document may have several rows and repeated documents each have theirs. Further columns of
    docs take no part.
    """
    given = templates or TEMPLATES
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(given)
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                for x in found_in(t, own) if t else ():
                    rows.append(i)
                    found.append(x)
            columns = [pa.array([x[n] for x in found], k) for n, k in _FOUND]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["doc_id", *(n for n, _ in _FOUND)])

    schema = f"doc_id {kind}, first_byte long, end_byte long, license string, saved double, n_equal long, missing string, extra string, verbatim boolean"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
