import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from llm_fixtures import docs  # noqa: F401

from traitloom.llm.middles import Settings, SkipList, draws, fill_in_middle, rearranged, restore, restored, token_widths

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(alphabet=st.sampled_from(list(" \n\t\x0b\x0c\rab<>PSM\x1c\x85 　é😀")), max_size=60)


def naive(doc_id, text):
    """(n, form, prefix, middle, output) by the list of tokens."""
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(TEXTS, st.integers(-5, 10**12))
def test_texts(text, doc_id):
    assert token_widths(text).tolist() == [len(x) for x in TOKEN.findall(text)]
    made = rearranged(text, draws(42, doc_id), Settings())
    assert made == naive(doc_id, text)
    assert restored(made[4], made[1]) == text


@pytest.mark.parametrize("many", [0, 1, 7, 8, 9, 1000, 20_000])
@pytest.mark.parametrize("sparse", [2, 4])
def test_every_rank(many, sparse):
    widths = np.random.default_rng(many).integers(1, 9, many)
    tokens = SkipList(widths, sparse)
    ends = np.concatenate([[0], np.cumsum(widths)])
    assert all(tokens.seek(rank) == ends[rank] for rank in range(0, many + 1, max(1, many // 500)))
    assert tokens.seek(many) == ends[-1]
    for rank in (-1, many + 1):
        with pytest.raises(IndexError):
            tokens.seek(rank)
    for units, chars, _ in tokens.lanes:  # every lane leads over the whole text
        assert units.sum() == many and chars.sum() == widths.sum()
    if many > 1000:
        assert len(tokens.lanes) > 3 and len(tokens.lanes[-1][0]) <= 8


def test_rows(spark, docs):  # noqa: F811
    long = "ab é\U0001f600\n" * 50_000
    rows = [(i, f"w{i} x\ty  z\n" * (i % 7)) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \t "), (303, "a<S>b"), (304, long), (1, rows[1][1]), (305, "<"), (306, "<P")]
    made, name = fill_in_middle(docs(rows, extra=["fim", "output", "n"]))
    assert name == "_fim" and "fim" in made.columns
    back, text = restore(made.select("doc_id", "text", f"{name}.*"), "output", "form")
    found = back.collect()
    assert len(found) == len(rows)
    for row in found:
        want = naive(row.doc_id, row.text or "")
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == want
        assert row[text] == (row.text or "")
    assert {row["form"] for row in found} == {"plain", "psm", "spm"}


def test_null_ids_and_no_rows(docs):  # noqa: F811
    made, name = fill_in_middle(docs([(None, "a b c"), (None, "a b c")]))
    rows = made.select(f"{name}.*").collect()
    assert rows[0] == rows[1] and rows[0]["n"] == 3
    assert fill_in_middle(docs([]))[0].count() == 0
