"""The registered templates: usual headers, whole texts and their variants."""

import numpy as np
import pyarrow as pa
import pytest

from monthloom.llm import licenses as L
from monthloom.llm import shingles as S
from monthloom.llm.common import text_buffers

GPL3 = """# This file is part of Foo. Foo is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


@pytest.fixture(scope="module")
def index():
    texts = L.registered()
    names = sorted(texts)
    return L.Templates(names, [texts[n] for n in names], 5, 0.8, 2, 1e-4, 7)


def found(index, text):
    words, counts = S.word_hashes(*text_buffers(pa.array([text], pa.string())), S.ALNUM)
    return {index.entries[t][0]: share for _, t, share, _, _ in index.scan(words, counts)}


def test_headers_name_family_and_version(index):
    assert set(found(index, GPL3)) == {"GPL-3.0-header"}
    assert set(found(index, GPL3.replace("version 3", "version 2"))) >= {"GPL-2.0-header"}
    assert "GPL-3.0-header" not in found(index, GPL3.replace("version 3", "version 2"))
    assert set(found(index, GPL3.replace("GNU General", "GNU Affero General"))) == {"AGPL-3.0-header"}
    assert set(found(index, GPL3.replace("GNU General", "GNU Lesser General"))) == {"LGPL-3.0-header"}
    assert found(index, "The river was high, and the people had to leave the town by the old road.") == {}


def test_texts_are_found_whole_reworded_and_apart(index):
    texts = L.registered()
    filler = " ".join(f"filler{i}" for i in range(700))
    for name in ("ISC-text", "Unlicense-text", "MPL-2.0-text", "BSD-3-Clause-text", "GPL-3.0-text", "BSD-warranty", "MIT-text", "MPL-2.0-header"):
        got = found(index, f"{filler} {texts[name]} {filler}")
        assert got[name] == 1, name
        words = texts[name].split()
        if len(words) > 60:  # another first sentence
            assert name in found(index, f"{filler} So says whoever wrote this: {' '.join(words[len(words) // 10 :])} {filler}"), name


def test_only_windows_with_enough_get_values(index):
    """A common phrase of long texts is no reason to look at every window around it."""
    c, k = max(index.index)
    assert index.least[c, k] > 1000
    words, counts = S.word_hashes(*text_buffers(pa.array(["in the hope that it will be useful " * 20], pa.string())), S.ALNUM)
    h = S.folded(words, np.arange(len(words) - k + 1), k)
    held = np.flatnonzero(np.isin(h, index.known[k][0]))
    assert len(held) and len(index.candidates(h, np.zeros(len(h), np.int64), 1, held, c, k)) == 0
