"""Notices inside long lines, beside each other and beside other lines with a cue."""

from __future__ import annotations

import pytest

from tessera.llm.licenses import TEMPLATES, Templates, found_in

PROSE = "we walked along the river for an hour and then came to a small house where nobody had lived for many years or so people said to us. "


@pytest.fixture(scope="module")
def templates():
    return Templates(TEMPLATES)


def licenses(text, templates):
    return [(r["license"], text.encode()[r["first_byte"] : r["end_byte"]].decode().strip()) for r in found_in(text.encode(), templates)]


def test_inline(templates):
    assert licenses(PROSE + "Released under the MIT License.", templates) == [("MIT", "Released under the MIT License.")]


def test_dual(templates):
    lines = ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0"]
    assert licenses("\n".join(lines), templates) == [("MIT", lines[0]), ("Apache-2.0", lines[1])]


def test_neighbouring_cue(templates):
    text = f"The copyright debate of that year was long and {PROSE}\n{PROSE}\nLicensed under the Apache License, Version 2.0."
    assert ("Apache-2.0", "Licensed under the Apache License, Version 2.0.") in licenses(text, templates)


def test_a_whole_notice_is_one_row(templates):
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0"):
        assert [x for x, _ in licenses(TEMPLATES[name].split("SPDX")[0].strip() if name != "MIT" else TEMPLATES[name], templates)].count(name) >= 1


def test_prose_has_none(templates):
    assert licenses("He lost his driving licence. The copyright debate was long. This is licensed nonsense.", templates) == []


#: A notice of about 7,000 bytes, each line with a cue.
LONG = [f"Clause {i}: a licensee{i} keeps paragraph{i * 7} beside item{i * 13} of schedule{i * 17} where copyright{i} of holder{i * 19} is named in annex{i * 23}." for i in range(60)]


def test_a_notice_of_any_length_is_one_row():
    """Longer than a piece that is compared at once: one row with the words of all pieces."""
    own = Templates({"Long": " ".join(LONG), "MIT": TEMPLATES["MIT"]})
    lines = [x.replace("keeps", "loses") if i % 20 == 0 else x for i, x in enumerate(LONG)]
    text = "\n".join([PROSE, *lines, PROSE]).encode()
    (row,) = [r for r in found_in(text, own) if r["end_byte"] - r["first_byte"] > 1600]
    assert row["license"] == "Long" and text[row["first_byte"] : row["end_byte"]] == "\n".join(lines).encode()
    assert row["extra"].split() == ["loses"] * 3 and row["missing"].split() == ["keeps"] * 3 and not row["verbatim"]
    assert row["n_equal"] == len(" ".join(LONG).split()) - 3


def test_pieces_of_two_licenses_stay_apart():
    own = Templates({"A": " ".join(LONG[:30]), "B": " ".join(LONG[30:])})
    text = "\n".join(LONG).encode()
    whole = [r for r in found_in(text, own) if r["end_byte"] - r["first_byte"] > 400]
    assert {r["license"] for r in whole} == {"A", "B"}
    assert max(r["end_byte"] - r["first_byte"] for r in whole) < len(text)


MIT_BODY = TEMPLATES["MIT"][TEMPLATES["MIT"].index("Permission is hereby") :]
BSD_2 = TEMPLATES["BSD-2-Clause"][TEMPLATES["BSD-2-Clause"].index("Redistribution and use") :]
BSD_3 = TEMPLATES["BSD-3-Clause"][TEMPLATES["BSD-3-Clause"].index("Redistribution and use") :].split(" SPDX")[0]
ISC_BODY = TEMPLATES["ISC"][TEMPLATES["ISC"].index("Permission to use") :]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under the GNU Lesser General Public License v2.1", "LGPL-2.1"), ("Licensed under the GNU Lesser General Public License v3.0", "LGPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License v3.", "GPL-3.0"), ("Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"), (BSD_2, "BSD-2-Clause"), (BSD_3, "BSD-3-Clause"), (ISC_BODY, "ISC"),
        (MIT_BODY, "MIT"), (MIT_BODY.replace(". ", ".\n\n"), "MIT"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("Released under the ISC license.", "ISC"),
        (TEMPLATES["Unlicense"][TEMPLATES["Unlicense"].index("This is free") :], "Unlicense"),
    ],
)
def test_versions_and_clauses_decide(templates, text, name):
    assert {x for x, _ in licenses(text, templates)} == {name}


@pytest.mark.parametrize("text", ["Licensed under the GNU General Public License, version 1.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-ND 4.0.", "Licensed under the Mozilla Public License 1.1."])
def test_versions_without_a_template_have_no_license(templates, text):
    assert licenses(text, templates) == []


def test_a_whole_body_counts_all_its_words(templates):
    (row,) = found_in(MIT_BODY.encode(), templates)
    assert row["verbatim"] and row["n_equal"] > 150
