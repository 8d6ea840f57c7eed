import re
from collections import defaultdict

import pytest
from llm_fixtures import TABLES, docs  # noqa: F401

from traitloom.llm.licenses import TEMPLATES, WORDS, Limits, align, license_scan, rising, scan
from traitloom.llm.queries import op8_license_notices

NOTICES = [(name, WORDS.findall(text.lower())) for name, texts in TEMPLATES.items() for text in texts]


def test_rising():
    assert [[3, 1, 2, 5, 4][i] for i in rising([3, 1, 2, 5, 4])] in ([1, 2, 5], [1, 2, 4])
    assert rising([]) == []


def test_align_anchors_and_gaps():
    left, right = "a b c d e f".split(), "x a b y c q d d e f z".split()
    pairs = align(left, right)
    assert all(left[i] == right[j] for i, j in pairs)
    assert [i for i, _ in pairs] == [0, 1, 2, 3, 4, 5] and [j for _, j in pairs] == sorted({j for _, j in pairs})


def test_whole_table_against_exact_lines(spark):
    """Every notice that stands in a text word for word is found at its place, and nothing in texts without its words."""
    texts = dict(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect())
    found = {row.doc_id: row for row in op8_license_notices(spark, TABLES).collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        want = defaultdict(list)
        for name, templates in TEMPLATES.items():
            for template in templates:
                for match in re.finditer(re.escape(template.rstrip(".")), text):
                    want[name].append((match.start(), match.end()))
        spans = [x.rsplit(":", 2) for x in filter(None, found[doc_id].spans.split(","))]
        assert len(spans) == found[doc_id].n_matches
        for name, places in want.items():
            for start, end in places:
                assert any(x[0] == name and int(x[1]) == start and int(x[2]) == end for x in spans) or any(
                    int(x[1]) <= start and end <= int(x[2]) for x in spans
                )
        if not want:
            assert found[doc_id].n_matches == 0


@pytest.mark.parametrize("copies", [1, 2, 7, 40])
def test_repeated_changed_and_long(copies):
    mit = TEMPLATES["MIT"][2].replace("free of charge", "free of any charge").replace("merge, publish,", "")
    filler = "other words of the text that say nothing " * 300
    text = filler + "".join(f"{mit.upper()}\n\n" for _ in range(copies)) + filler
    found = scan(text, NOTICES, Limits())
    assert [x["license"] for x in found] == ["MIT"] * copies
    assert text[found[0]["start"] : found[0]["end"]] == mit.upper().rstrip(".")


@pytest.mark.parametrize("copies", [1, 2, 3, 5, 10, 40, 150, 300])
@pytest.mark.parametrize("between", ["\n", " and some other words of ours stand here in the middle "])
@pytest.mark.parametrize("name, place", [(name, i) for name, texts in TEMPLATES.items() for i in range(len(texts))])
def test_all_copies_one_after_the_other(name, place, between, copies):
    """Against exact search: every copy is found at its place, and nothing else beside them."""
    notice = TEMPLATES[name][place]
    text = between.join([notice] * copies)
    exact = re.sub(r"\W+$", "", notice)
    want = [(match.start(), match.end()) for match in re.finditer(re.escape(exact), text)]
    assert len(want) == copies
    found = scan(text, NOTICES, Limits())
    assert [(x["start"], x["end"]) for x in found if x["license"] == name] == want
    assert len(found) == copies


@pytest.mark.parametrize("copies", [3, 30, 300])
def test_changed_copies_one_after_the_other(copies):
    words = TEMPLATES["MIT"][2].split()
    texts = []
    for i in range(copies):
        at = 7 + i * 5 % (len(words) - 14)
        texts.append(" ".join([*words[:at], *(["inserted"] if i % 2 else []), *words[at + (i % 3 == 0) :]]))
    found = scan(" ".join(texts), NOTICES, Limits())
    assert len(found) == copies and {x["license"] for x in found} == {"MIT"}
    assert min(x["coverage"] for x in found) > 0.9


def test_similar_notices_go_to_the_better_one():
    text = "This work is licensed under the GNU General Public License, version 2. Licensed under CC BY-NC 4.0!"
    assert [x["license"] for x in scan(text, NOTICES, Limits())] == ["GPL-2.0", "CC-BY-NC-4.0"]
    assert scan("the license of under a public work is version general", NOTICES, Limits()) == []


def test_nulls_empty_repeats_and_clashing_columns(docs):
    line = "İ ẞ Released under the MIT License."
    rows = [(1, None), (2, ""), (None, line), (3, line), (3, line), (4, "x " * 100_000)]
    found = sorted(license_scan(docs(rows, extra=["matches", "license"])).collect(), key=repr)
    assert len(found) == 6
    assert all(len(row.matches) == (row.doc_id in (None, 3)) for row in found)
    assert {line[m.start : m.end] for row in found for m in row.matches} == {"Released under the MIT License"}
    assert license_scan(docs([])).count() == 0
