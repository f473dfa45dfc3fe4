import pytest

from backline.llm import licenses as L
from .frames import ODD, docs

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor " * 6


@pytest.mark.parametrize("name,text", [(n, t) for n, ts in L.TEMPLATES.items() for t in ts])
def test_every_wording_is_found_where_it_stands(name, text):
    whole = WORDS + "\n" + text + "\n" + WORDS
    found = L.Scanner().scan(whole)
    assert any(f[0] == name and f[4] == 1.0 and f[5] == "" and whole.index(text) <= f[1] < f[2] <= whole.index(text) + len(text) for f in found)


def test_differences_are_named():
    [f] = L.Scanner().scan("x y. This work was licensed under the GNU General Public License, version 3. z")
    assert f[0] == "GPL-3.0" and f[5] == "-is +was"


@pytest.mark.parametrize("text", ["", "Permission denied. The licensed driver had no license to speak.", WORDS, "copyright " * 500, "all rights reserved"])
def test_clean_texts(text):
    assert L.Scanner().scan(text) == []


def test_documents(spark):
    line = "Licensed under CC BY-NC 4.0."
    rows = ODD + [(6, "é\n" + line), (7, (line + "\n" + WORDS) * 3), (6, "é\n" + line)]
    got = sorted((r.doc_id, r.license, r.start, r.end) for r in L.license_spans(docs(spark, rows, extra=("license",))).collect())
    assert got[:2] == [(6, "CC-BY-NC-4.0", 2, 2 + len(line) - 1)] * 2 and len(got) == 5
    assert L.license_spans(docs(spark, [])).count() == 0


def test_wording_that_many_neighbours_outrank():
    text = "Licensed under the BSD 3-Clause License., Licensed under the BSD 3-Clause License., This work is licensed under a Creative Commons Attribution 4.0 International our"
    assert [f[:3] + f[4:5] for f in L.Scanner().scan(text)] == [("BSD-3-Clause", 0, 39, 1.0), ("BSD-3-Clause", 42, 81, 1.0), ("CC-BY-4.0", 84, 160, 0.9565)]
