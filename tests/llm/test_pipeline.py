"""Every stage of the pipeline against a plain version of it."""

import importlib
import re
from collections import Counter, defaultdict

import pytest
from llm_fixtures import TABLES, docs  # noqa: F401
from pyspark.sql import functions as F
from test_pii import plain_spans
from test_simhash import naive_components, naive_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from traitloom.llm import toxicity
from traitloom.llm.common import crc_fold
from traitloom.llm.mixing import cyclic_weights, share_targets
from traitloom.llm.packing import WORD_BPE
from traitloom.scratch import cut


def redacted(text):
    marks = sorted(((a, b, kind) for kind, places in plain_spans(text).items() for a, b in places), key=lambda x: (x[0], -x[1], x[2]))
    made, at = "", 0
    for a, b, kind in marks:
        if a >= at:
            made += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return made + text[at:]


def test_stages_in_turn(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    raw = spark.read.parquet(f"{TABLES}/documents.parquet")
    before, kept = raw, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name], _ = cut(stage(spark, before, TABLES), name)
        if name != "pack":
            assert kept[name].columns == columns and kept[name].schema.simpleString() == raw.schema.simpleString()
        before = kept[name]
    rows = {name: df.collect() for name, df in kept.items()}
    model = toxicity.train(raw, spark.read.parquet(f"{TABLES}/labels.parquet"), lambda i: crc_fold(i, 5) != 0)
    scored, score = toxicity.score_texts(raw, model, ["doc_id"])
    assert {r.doc_id for r in rows["toxicity"]} == {r.doc_id for r in scored.where(F.col(score) < 0.5).collect()}
    clean = {r.doc_id: r.text for r in rows["toxicity"]}
    of = naive_components([(i, naive_fingerprint(text)) for i, text in clean.items()])
    assert {r.doc_id: r.text for r in rows["simhash"]} == {i: clean[i] for i in set(of.values())}
    assert len(rows["simhash"]) == len(set(of.values()))
    # texts from which no term was taken are redacted by the base patterns alone
    single = {r.doc_id: r.text for r in rows["simhash"]}
    for r in rows["pii"]:
        assert re.sub(r"\[TERM\]", "", r.text) == r.text and r.text == redacted(single[r.doc_id])
    sizes, taken = defaultdict(int), defaultdict(int)
    copies = Counter(r.doc_id for r in rows["mix"])
    for r in rows["pii"]:
        words = len(r.text.encode().split())
        sizes[r.source] += words
        taken[r.source] += copies[r.doc_id] * words
        assert copies[r.doc_id] <= 3
    targets = share_targets(sizes, cyclic_weights(sizes))
    # what is missing is less than any document that could be taken once more
    fewest = {s: min(copies[r.doc_id] for r in rows["pii"] if r.source == s and r.text.split()) for s in sizes}
    for r in rows["pii"]:
        words = len(r.text.encode().split())
        missing = targets[r.source] - taken[r.source]
        assert -1 <= missing and (words == 0 or copies[r.doc_id] > fewest[r.source] or words > missing - 1)
    whole = Tokenizer.from_file(WORD_BPE)
    lengths = Counter()
    for r in rows["mix"]:
        lengths[r.doc_id] += len(whole.encode(r.text, add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in rows["pack"]:
        packed[r.doc_id] += r.length
    assert packed == lengths


def test_run_is_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mix", "pack"]
    assert corpus_pipeline.run(spark, TABLES).where("length > 4096 OR length < 1").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (2, "", "en", ""), (None, "a@b.cd x", None, "s"), (None, "a@b.cd x", None, "s"),
                                       (3, "w " * 30_000, "en", None), (3, "w " * 30_000, "en", None)]])
def test_odd_rows(spark, docs, rows):
    data = docs(rows, extra=["row", "fp", "at", "score", "size", "copies", "pattern", "rank", "term"])
    for name, stage in corpus_pipeline.STAGES:
        made, many = cut(stage(spark, data, TABLES), name)
        assert name == "pack" or made.columns == data.columns
        data = made
    assert (many == 0) == (not rows)
