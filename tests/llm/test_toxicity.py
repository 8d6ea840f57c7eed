import numpy as np
from llm_fixtures import TABLES, docs  # noqa: F401
from pyspark.sql import functions as F

from traitloom.llm import toxicity
from traitloom.llm.queries import op9_weak_toxicity

ANY = lambda doc_id: doc_id.isNotNull()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def corpus(many=400):
    """Every tenth text holds a bad word or one made from a bad stem; half of the others shout."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]
    rows = []
    for i in range(many):
        text = list(rng.choice(words, 60))
        if i % 10 == 0:
            text[5] = ["nasty", "vileword", f"grimlo{rng.choice(words)}"][i // 10 % 3]
        rows.append((i, " ".join(text).upper() if i % 2 else " ".join(text)))
    return rows


def test_held_out_rows_and_new_endings(spark, docs):
    rows = corpus()
    labels = labels_of(spark, [(i, 1, int(i % 10 == 0)) for i, _ in rows])
    model = toxicity.train(docs(rows), labels, lambda doc_id: doc_id < 300)
    new = [(1000, "bal bel grimlozzz bol"), (1001, "bal bel bol"), (1002, "THE NASTY ONE")]
    scored, score = toxicity.score_texts(docs(rows + new), model, ["doc_id"])
    found = {row.doc_id: row[score] for row in scored.collect()}
    assert all((found[i] >= 0.5) == (i % 10 == 0) for i in range(400))
    assert found[1000] >= 0.5 and found[1002] >= 0.5 and found[1001] < 0.5


def test_label_model_counts_copies_of_a_voter_once():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = np.stack([truth & (rng.random(4000) < 0.7) for _ in range(3)], axis=1)
    noisy = (rng.random(4000) < np.where(truth, 0.5, 0.2))[:, None]
    fired = np.hstack([good, np.repeat(noisy, 8, axis=1)]).astype(float)
    given = np.where(rng.random(4000) < 0.9, truth, ~truth).astype(float)
    posterior = toxicity.label_model(fired, given, 10)
    assert np.mean((posterior > 0.5) == truth) > np.mean(given == truth)
    # eight copies of a poor voter do not outvote the label
    alone = (fired[:, :3].sum(axis=1) == 0) & (given == 0) & noisy[:, 0]
    assert posterior[alone].mean() < 0.5


def test_parts_are_counted_over_all_labelled_texts(spark):
    """Against plain counting, over the whole table."""
    texts = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    toxic = {row.doc_id: row.toxic for row in labels.collect() if row.doc_id % 3}
    want = {("", ""): [0, 0]}
    for doc_id, text in texts.collect():
        if toxic.get(doc_id) is None:
            continue
        words = {word for word in toxicity.LETTERS.findall((text or "").lower())}
        parts = {("word", word) for word in words}
        parts |= {(f"start{n}", word[:n]) for word in words for n in range(4, 9) if len(word) > n}
        for key in parts | {("", "")}:
            want.setdefault(key, [0, 0])[toxic[doc_id]] += 1
    found = toxicity.part_counts(texts, labels, lambda doc_id: doc_id % 3 != 0).collect()
    assert {(row.kind, row.part): [row.clean, row.toxic] for row in found} == want


def test_chance_bound():
    rng = np.random.default_rng(5)
    chance = rng.exponential(1, 20_000)
    levels = lambda strengths: list(zip(*np.unique(np.floor(strengths * 10).astype(int), return_counts=True)))
    assert (chance >= toxicity.chance_bound(levels(chance), len(chance), 0.05)).sum() <= 3
    both = np.append(chance, rng.normal(40, 5, 300))
    bound = toxicity.chance_bound(levels(both), len(both), 0.05)
    assert 5 < bound < 9 and (chance >= bound).sum() <= 0.1 * (both >= bound).sum()
    assert toxicity.chance_bound([], 0, 0.05) == float("inf")


def test_rare_words_share_a_voter_and_none_is_lost(spark, docs):
    """Many toxic words, each in few texts: more than there are voters, and too few in the sample to be weighed."""
    letters = "bcdfghjklmnpqrstvwxz"
    bad = [f"{a}{b}{c}uq" for a in letters[:6] for b in letters[:10] for c in letters[:10]][:500]
    calm = corpus(3000)
    rows = [(i, text if i % 10 else f"{text} {bad[i // 10 % 60]}") for i, text in calm if not (i % 10 == 0 and i > 2990)]
    settings = toxicity.Settings(most_labelled=600, most_voters=8)
    labels = labels_of(spark, [(i, 1, int(i % 10 == 0)) for i, _ in rows])
    model = toxicity.train(docs(rows), labels, ANY, settings)
    assert all(word in model.lexicon["word"] for word in bad[:60])
    assert len(set(model.lexicon["word"].values())) < 60
    scored, score = toxicity.score_texts(docs([(i, f"bal bel {word} bol") for i, word in enumerate(bad[:60])]), model, ["doc_id"])
    assert all(row[score] >= 0.5 for row in scored.collect())


def test_scores_of_the_table(spark):
    rows = op9_weak_toxicity(spark, TABLES).collect()
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in rows)
    labels = dict(spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "toxic").collect())
    clean = [row for row in rows if labels.get(row.doc_id) == 0]
    assert sum(row.predicted for row in clean) <= 0.1 * len(clean)


def test_nulls_empty_repeats_clashing_columns_and_no_labels(spark, docs):
    rows = [(1, None), (2, ""), (None, "nasty"), (3, "nasty"), (3, "nasty"), (4, "x" * 100_000)]
    data = docs(rows, extra=["score", "text_", "toxic", "votes"])
    labels = labels_of(spark, [(1, 1, 0), (2, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 0)])
    for known in (labels, labels.limit(0)):
        model = toxicity.train(data, known, ANY)
        scored, score = toxicity.score_texts(data, model, data.columns)
        found = scored.collect()
        assert len(found) == 6 and score == "_score" and all(0 <= row[score] <= 1 for row in found)
        assert scored.drop(score).columns == data.columns
    assert toxicity.score_texts(docs([]), model, ["doc_id"])[0].count() == 0
    assert toxicity.labelled_sample(data, labels, ANY, toxicity.Settings()).agg(F.sum("toxic")).first()[0] == 2
