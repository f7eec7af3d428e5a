"""Labels of standard notices, and the exact aligner against brute force."""

import random
import textwrap

import pytest

pytest.importorskip("trailmark.llm.queries")
from trailmark.llm import license_scan  # noqa: E402

GNU = "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
THIRD = " 3. Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
NOTICES = [
    ("LGPL-3.0", GNU.format(what="program", kind="Lesser ", v="3", a=":", b=",")),
    ("LGPL-2.1", GNU.format(what="library", kind="Lesser ", v="2.1", a=";", b=";")),
    ("AGPL-3.0", GNU.format(what="program", kind="Affero ", v="3", a=":", b=",")),
    ("GPL-3.0", GNU.format(what="program", kind="", v="3", a=":", b=",")),
    ("GPL-2.0", GNU.format(what="program", kind="", v="2", a=";", b=";")),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + THIRD.format(who="the copyright holder")),
    ("BSD-3-Clause", BSD + THIRD.format(who="the University")),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "released under CC BY 4.0 terms"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
]


def labels(text):
    return [hit[2] for _, _, block in license_scan.candidate_blocks(text) for hit in license_scan.classify_block(block)]


@pytest.mark.parametrize(("name", "notice"), NOTICES)
def test_notices_get_their_own_label(name, notice):
    wrapped = textwrap.wrap(notice, 68)
    other = [f"words {i} of the other text in the file" for i in range(30)]
    for text in (notice, "\n".join(wrapped), "\n".join(f"# {x}" for x in wrapped), "/*\n" + "\n".join(f" * {x}" for x in wrapped) + "\n */", "\n".join([*other, *wrapped, *other])):
        assert labels(text) == [name], text


def test_one_sentence_of_a_family_names_the_family():
    assert labels("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:") == ["BSD"]


def test_two_licences_side_by_side():
    assert sorted(labels("Licensed under the MIT License or the Apache License, Version 2.0.")) == ["Apache-2.0", "MIT"]
    assert labels("SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT"]
    assert labels("the licence of this car, version 3, is public") == []


def brute(words, own, strange):
    """Least difference over all places: every choice of the place's first and last word, and of the words kept between."""
    best = None
    for lo in range(len(words) + 1):
        for hi in range(lo, len(words) + 1):
            part = words[lo:hi]
            # Least cost of turning own into part: d[i][j].
            d = [[0] * (len(part) + 1) for _ in range(len(own) + 1)]
            for i in range(len(own) + 1):
                for j in range(len(part) + 1):
                    if i == j == 0:
                        continue
                    ways = []
                    if i:
                        ways.append(d[i - 1][j] + (license_scan.NEVER if license_scan._needed(own[i - 1]) else license_scan.MISSING))
                    if j:
                        ways.append(d[i][j - 1] + (license_scan.NEVER if part[j - 1] in strange else 1))
                    if i and j and own[i - 1] == part[j - 1]:
                        ways.append(d[i - 1][j - 1])
                    d[i][j] = min(ways)
            best = d[-1][-1] if best is None else min(best, d[-1][-1])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    confirmed = 0
    for _ in range(250):
        own = [rng.choice(["alpha", "beta", "gamma", "delta", "2.0", "epsilon"]) for _ in range(rng.randint(1, 7))]
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "2.0", "epsilon", "lesser", "word"]) for _ in range(rng.randint(0, 5))]
        near = [w for w in own if rng.random() < 0.9]
        for _ in range(rng.randint(0, 2)):
            near.insert(rng.randint(0, len(near)), rng.choice(["word", "lesser", "alpha"]))
        words = words + near + words[:2]
        want, strange = brute(words, own, {"lesser"}), frozenset({"lesser"})
        got = license_scan._align(words, own, 0.5, strange)
        if got is None:
            # Nothing without needed words or with strange ones; or too much is missing or added at the least difference.
            assert want >= license_scan.NEVER or want >= license_scan.MISSING * 0.5 * len(own) or want > len(own)
            continue
        confirmed += 1
        lo, hi, hit, missing, added = got
        assert license_scan.MISSING * len(missing) + len(added) == want and hit + len(missing) == len(own) and hi - lo == hit + len(added)
        assert "lesser" not in added and not any(license_scan._needed(w) for w in missing)
        # Taking the added words out of the place and the missing ones out of the template leaves the same words.
        place, rest = list(words[lo:hi]), list(own)
        for w in added:
            place.remove(w)
        for w in missing:
            rest.remove(w)
        assert sorted(place) == sorted(rest)
    assert confirmed > 100
