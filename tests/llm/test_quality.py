import numpy as np

from llm_fixtures import docs  # noqa: F401

from traitloom.llm.quality import Rules, divergence, language_references, quality_rules

PROSE = " ".join(f"the cat number {'abcdefghij'[i % 10]} sat on a mat, and the dog {i % 7} ran." for i in range(40))


def judged(df, rules=Rules(min_reference_words=100)):
    return {row.doc_id: row for row in quality_rules(df, rules).collect()}


def test_divergence_bounds():
    same = np.array([3, 1, 0])
    assert divergence(same, same * 5) == 0
    assert divergence(np.array([1, 0]), np.array([0, 1])) == 1
    assert divergence(np.array([0, 0]), np.array([0, 1])) == 0


def test_base_counts(docs):
    row = judged(docs([(1, "a b c a b c #\n \nx\nx\n\n")]))[1]
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines) == (9, 9, 1, 1)
    assert row.n_repeat_words == 6 and row.base_failed and not row.kept


def test_overlapping_windows_count_each_word_once(docs):
    assert judged(docs([(1, "a a a a a")]))[1].n_repeat_words == 5


def test_symbol_soup_fails_and_prose_stays(docs):
    soup = " ".join(f"{w}%%% {w[::-1]}###" for w in PROSE.split()[:200])
    rows = judged(docs([(i, f"{PROSE[i * 30:]}") for i in range(20)] + [(99, soup)]))
    assert all(rows[i].kept or rows[i].base_failed for i in range(20))
    assert not rows[99].kept and rows[99].char_distance > 0.3


def test_nulls_empty_repeats_and_clashing_columns(docs):
    rows = [(1, None), (2, ""), (None, PROSE), (3, PROSE), (3, PROSE), (4, PROSE, None, None)]
    found = quality_rules(docs(rows, extra=["n_words", "kept_", "char_distance"])).collect()
    assert len(found) == 6
    by_id = {row.doc_id: row for row in found}
    assert by_id[1].n_words == by_id[2].n_words == 0 and by_id[1].base_failed and by_id[2].base_failed
    # a null language has no reference of its own: the document is compared with the whole corpus of 2080 words
    assert by_id[4].char_distance == by_id[4].word_distance == 0.0
    assert judged(docs(rows), Rules(min_reference_words=2081))[4].char_distance is None


def test_empty_table_and_rare_language(docs):
    assert quality_rules(docs([])).count() == 0
    assert language_references(docs([(1, "few words", "xx", "a")])).count() == 0


def test_references_by_join_give_the_same(docs):
    rows = [(i, PROSE[i * 7 :], ["en", "fr", "xx", None][i % 4], "a") for i in range(40)]
    rows += [(50, "only a few words of a rare language " * 10, "rare", "a")]
    rows += [(51, " ".join(f"zq{i}%% #{i * i}" for i in range(300)), "rare too", "a")]
    for least in (100, 2000, 10**6):
        found = [
            sorted(map(tuple, quality_rules(docs(rows), Rules(min_reference_words=least, most_carried=most)).collect()))
            for most in (1000, 0)
        ]
        assert found[0] == found[1] and len(found[0]) == 42
    # a rare language is judged, by the whole corpus
    by_id = judged(docs(rows), Rules(min_reference_words=2000))
    assert by_id[51].char_distance is not None and not by_id[51].kept
