import math
import zlib
from collections import Counter

import numpy as np
from llm_fixtures import TABLES, docs  # noqa: F401
from pyspark.sql import functions as F

from traitloom.llm import scoring
from traitloom.llm.common import arrow_rows
from traitloom.llm.queries import op7_bloom_lm_scores
from traitloom.llm.scoring import BlockTable, Settings, build_filter, level_counts, level_of, score_texts, train


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def exact_base(texts, learned):
    counts = Counter(token for text in learned for token in tokens(text))
    size = sum(counts.values()) + 0.5 * (len(counts) + 1)
    return sum(counts.values()), [
        (len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), sum(math.log10((counts[t] + 0.5) / size) for t in tokens(text)))
        for text in texts
    ]


def test_whole_table(spark):
    texts = dict(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect())
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    total, base = exact_base(texts.values(), [text for i, text in texts.items() if not held[i]])
    want = dict(zip(texts, base))
    gains = {True: 0.0, False: 0.0}
    rows = op7_bloom_lm_scores(spark, TABLES).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n, known, score = want[row.doc_id]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[row.doc_id], n, known, total)
        assert math.isclose(row.base_score, score, rel_tol=1e-9)
        gains[row.held_out] += row.score - row.base_score
    # the model explains held-out text better than single words do
    assert gains[True] > 0 and gains[False] > 0


def test_filter_never_reads_less(spark):
    settings = Settings()
    grams = spark.range(5000).select(
        F.xxhash64("id").alias("key"), level_of(F.col("id") % 40 + 1, settings.steps).alias("level"), (F.col("id") % 40 + 1).alias("n")
    )
    filled, least = build_filter(grams, settings)
    rows = grams.collect()
    keys = np.array([row.key for row in rows]).view(np.uint64)
    levels = filled.levels(keys)
    assert least == 1 and (levels >= [row.level for row in rows]).all()
    assert np.mean(levels == [row.level for row in rows]) > 0.97
    other = filled.levels(np.arange(10_000, dtype=np.uint64) * np.uint64(2654435761))
    assert np.mean(other > 0) < 0.05
    counts = level_counts(settings.steps)
    assert all(abs(counts[row.level] - row.n) <= 0.25 * row.n for row in rows)


def test_small_filter_keeps_the_frequent(spark):
    settings = Settings(most_bits=2**16, block_bits=2**12)
    grams = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.when(F.col("id") < 500, 9).otherwise(1).alias("level"))
    filled, least = build_filter(grams, settings)
    assert least > 1 and len(filled.bits) * 8 <= 2**16
    frequent = np.array([row.key for row in grams.where("level = 9").collect()]).view(np.uint64)
    assert (filled.levels(frequent) >= 9).all()


def test_rare_words_are_exact_and_probabilities_add_up(docs):
    rows = [(i, "the cat sat on the mat . the dog ran") for i in range(30)] + [(99, "odd words once")]
    data = docs(rows)
    model, counts = train(data, Settings(most_frequent=2))
    assert len(model.frequent) <= 2
    found = {row.doc_id: row for row in score_texts(data, model, counts).collect()}
    total, base = exact_base([text for _, text in rows], [text for _, text in rows])
    for (i, _), (n, known, score) in zip(rows, base):
        assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (n, known, total)
        assert math.isclose(found[i].base_score, score, rel_tol=1e-9)
    assert found[0].score > found[0].base_score and found[0].score <= 0


def test_nulls_empty_long_repeats_and_clashing_columns(docs):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "w " * 200_000)]
    data = docs(rows, extra=["n_tokens", "known", "at", "token", "n"])
    model, counts = train(data)
    found = score_texts(data, model, counts).collect()
    assert sorted(row.n_tokens for row in found) == [1, 1, 3, 3, 3, 200_001]
    assert all(np.isfinite(row.score) and row.score < 0 for row in found)
    empty, counts = train(docs([]))
    assert score_texts(docs([]), empty, counts).count() == 0
    assert score_texts(docs([(1, "new words")]), empty, counts).first().n_known == 0


def test_rare_words_and_pairs_count_however_large_the_filters(docs):
    """Words and pairs that are seen once; filters that are too large to be broadcast read like others."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)] + [(99, None)]
    data = docs(rows)
    scores = []
    for settings in (Settings(), Settings(most_bits=2**14, block_bits=2**10)):
        model, counts = train(data, settings)
        table = settings.most_bits < 2**16
        assert isinstance(model.words, BlockTable) == isinstance(model.pairs, BlockTable) == table
        scores.append({row.doc_id: row.score for row in score_texts(data, model, counts).collect()})
    for i, _ in rows[:-1]:
        # each word follows the one before it with at least 1/4
        assert min(found[i] for found in scores) > 60 * math.log10(0.25) - 3
        assert math.isclose(scores[0][i], scores[1][i], rel_tol=0.05)
    assert scores[0].keys() == scores[1].keys()


def test_a_table_is_asked_by_some_of_the_texts_at_a_time(spark, docs, monkeypatch):
    """Each text is scored once, as it is by a filter that is broadcast, and no wave asks for all keys."""
    rows = [(i % 70, f"w{i}  a b c{i % 7}\u00a0x ") for i in range(80)] + [(None, None), (None, "a b")]
    data = docs(rows)
    waves = []
    ask = scoring.with_levels

    def asked(parts, name, held, keys_of):
        waves.append({row.part for row in parts.select("part").collect()})
        return ask(parts, name, held, keys_of)

    with arrow_rows(spark, 2):
        small = Settings(most_bits=2**9, block_bits=2**10)
        model, counts = train(data, small)
        assert isinstance(model.pairs, BlockTable)
        monkeypatch.setattr(scoring, "with_levels", asked)
        found = score_texts(data, model, counts).collect()
        monkeypatch.undo()
    want = score_texts(data, *train(data)).collect()

    def known(rows):
        return sorted((row.doc_id or -1, row.n_tokens, row.n_known, row.train_tokens, round(row.base_score, 6)) for row in rows)

    assert known(found) == known(want) and len(found) == len(rows)
    everything = set().union(*waves)
    assert len(everything) > 20 and all(len(wave) < len(everything) / 2 for wave in waves)


def test_pairs_of_a_larger_corpus_are_sent_packed(spark, docs, monkeypatch):
    """Millions of pairs go to their lots as a few rows of bytes, not as a row each; a table of them gives their counts back."""
    rows = [(i, " ".join(f"w{(i * j) % 997} x{j % 5}" for j in range(200))) for i in range(100)] + [(None, None), (100, "")]
    data, settings, sent = docs(rows), Settings(most_pair_bits=2**10, block_bits=2**12), []
    count = scoring.pair_counts

    def counted(*asked):
        sent.append(count(*asked))
        return sent[-1]

    monkeypatch.setattr(scoring, "pair_counts", counted)
    model, _ = train(data, settings)
    monkeypatch.undo()
    want, context = Counter(), Counter()
    for _, text in rows:
        words = tokens(text)
        context.update(words)
        want.update(zip([b"", *words], words))
    assert not isinstance(model.words, BlockTable) and isinstance(model.pairs, BlockTable) and model.pairs.lots > 1
    assert sent[0].count() * 100 < sum(want.values())
    pairs = list(want)
    first, second = (scoring.hashes([pair[i] for pair in pairs]) for i in (0, 1))
    keys = scoring.pair_keys(first, second)
    lots = {row.lot: np.frombuffer(row.bits, dtype=np.uint8) for row in model.pairs.rows.collect()}
    of = scoring.LogBloom.block_of(keys, model.pairs.lots)
    found = np.zeros(len(keys))
    for lot, bits in lots.items():
        found[of == lot] = scoring.LogBloom(bits, len(bits) * 8, settings.probes, settings.steps).counts(keys[of == lot])
    exact = np.array([want[pair] for pair in pairs])
    assert (found >= 0.75 * exact).all() and np.mean(found <= 1.25 * exact) > 0.95
    # what a context leaves to words it was not seen with: 0.75 of each different pair
    levels = model.words.levels(first)
    for level in np.unique(levels):
        here = levels == level
        assert math.isclose(model.rest[level], 0.75 * here.sum() / exact[here].sum(), rel_tol=1e-9)


def test_tokens_are_cut_at_ascii_white_space_only():
    texts = [" A\tb\x0b\x0cC \r\n", None, "", "  ", "\u00c9\u00a0x \x1cy\x85 \u3000 A", "end"]
    found, row, begins = scoring.numbered(texts)
    assert len(set(found)) == len(found)
    want = [tokens(text) for text in texts]
    assert [[found[i] for i in row[start:stop]] for start, stop in zip(begins, begins[1:])] == want
    assert scoring.numbered([])[0] == [] and list(scoring.numbered([])[2]) == [0]
