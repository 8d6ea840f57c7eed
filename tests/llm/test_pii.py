import hashlib
import re

import pytest
from llm_fixtures import TABLES, docs  # noqa: F401

from traitloom.llm import pii
from traitloom.llm.queries import op10_disclosed_entities

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_d@e.f x@y a.b@c.d@e.f.g@h",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111 5500 0000 0000 0004-1",
    "+1 (555) 123-4567. +49.30.1234 +1234567 +123456789012345678 ++1 22 333 4444",
    "né ü@x.de é 日本 127.0.0.1 x😀 +1 555 000 1111",
    "", "@", "+", "1", "a@b.c", "." * 50, "1 " * 300,
]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return {
        kind: [(m.start(), m.end()) for m in re.finditer(pattern, text or "") if good(kind, m.group())]
        for kind, pattern in PLAIN.items()
    }


def check(row, text):
    want = plain_spans(text)
    listed = ",".join(f"{kind}:{a}:{b}" for kind, places in want.items() for a, b in places)
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(places) for places in want.values()]
    assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    terms = row.spans[len(listed) :].lstrip(",")
    assert row.spans.startswith(listed) and re.fullmatch(r"(term:\d+:\d+,?)*", terms)


def test_whole_table(spark):
    texts = dict(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect())
    rows = op10_disclosed_entities(spark, TABLES).collect()
    assert sorted(row.doc_id for row in rows) == sorted(texts)
    for row in rows:
        check(row, texts[row.doc_id])


def test_tricky_base_spans(docs):
    found = pii.disclosures(docs(list(enumerate(TRICKY))), ["doc_id"])
    for row in found.select("row.doc_id", *pii.PATTERNS).collect():
        want = plain_spans(TRICKY[row.doc_id])
        assert {kind: [(x.start, x.end) for x in row[kind]] for kind in PLAIN} == want


def test_long_runs_stay_linear(docs):
    texts = ["a" * 200_000, "1" * 200_000, "1." * 50_000, "a.b" * 60_000 + "@", "+1" + "(" * 100_000, "1 " * 20_000]
    rows = pii.disclosures(docs(list(enumerate(texts))), ["doc_id"]).collect()
    assert len(rows) == len(texts)


def test_terms_that_give_an_entity_away(docs):
    """A name that only stands next to one address is found; common and lone words are not."""
    filler = [(100 + i, f"the words from number {i} says hello and a note of things for anyone at all") for i in range(60)]
    rows = [(i, f"the note {i} from Kowalska, kowal@ex.org says hello of {i} things") for i in range(4)]
    rows += [(10, "the Kowalska of another text"), (11, "the lone word Nowak, nowak@ex.org of nothing")]
    found = {row.doc_id: row for row in pii.disclosures(docs(filler + rows), ["doc_id"]).select("row.doc_id", "text", "term").collect()}
    for i in range(4):
        assert [rows[i][1][x.start : x.end] for x in found[i].term] == ["Kowalska"]
    assert [rows[4][1][x.start : x.end] for x in found[10].term] == ["Kowalska"]  # names the entity without its address
    assert all(not found[i].term for i in (11, 100))
    safe = {row.doc_id: row.text for row in pii.sanitise(docs(filler + rows)).collect()}
    assert "[EMAIL]" in safe[0] and "Kowalska" not in safe[0] and "[TERM]" in safe[0] and safe[0].startswith("the note 0 from [TERM], [EMAIL] says")
    assert safe[11] == "the lone word Nowak, [EMAIL] of nothing" and safe[10] == "the [TERM] of another text"


def test_a_disclosing_term_is_found_anywhere_in_its_entitys_documents(docs):
    filler = [(100 + i, f"the words from number {i} says hello and a note of things for anyone at all") for i in range(60)]
    rows = [(i, f"the note {i} from Kowalska, kowal@ex.org says hello of {i} things") for i in range(4)]
    far = "kowal@ex.org " + "says hello and a note of things for anyone at all " * 5 + "KOWALSKA, Kowalska"
    found = {row.doc_id: row for row in pii.disclosures(docs(filler + rows + [(10, far)]), ["doc_id"]).select("row.doc_id", "term").collect()}
    assert [far[x.start : x.end] for x in found[10].term] == ["KOWALSKA", "Kowalska"]
    assert all(len(found[i].term) == 1 for i in range(4)) and not found[100].term


def test_overlapping_spans_become_one(docs):
    text = "x 4111111111111111 and 12.34.56.78@host.org end"
    assert [row.text for row in pii.sanitise(docs([(1, text)])).collect()] == ["x [CARD] and [EMAIL] end"]


def test_many_spans_in_one_text(spark, docs):
    """Places, and the sanitised text, as a plain version gives them; ever so many of them take no square of time."""
    text = "".join(f"né {i} a{i}@b.cd, x9{i}.1.2.3 " for i in range(20_000))
    row = pii.disclosures(docs([(1, text)]), ["doc_id"]).select(*pii.PATTERNS).first()
    assert {kind: [(x.start, x.end) for x in row[kind]] for kind in PLAIN} == plain_spans(text)
    safe = re.sub(r"a\d+@b\.cd", "[EMAIL]", text)
    parts = [(m.start(), m.end()) for m in re.finditer(PLAIN["ip"], safe) if good("ip", m.group())]
    for start, end in reversed(parts):
        safe = safe[:start] + "[IP]" + safe[end:]
    assert pii.sanitise(docs([(1, text)])).first().text == safe


def test_terms_that_meet_a_base_span(spark):
    """A term is left out if any base span, also a long one that began before others, shares a place with it."""
    cases = [
        ([(0, 3), (3, 6), (7, 9), (30, 33)], [(3, 7), (8, 20)]), ([(5, 8)], [(0, 20), (1, 2)]), ([(5, 8)], []), ([], [(0, 1)]),
        ([(i * 7 % 1000, i * 7 % 1000 + 3) for i in range(300)], [(i * 11, i * 11 + i % 5) for i in range(1, 90)]),
    ]
    kind = "array<struct<start:int,end:int,value:string>>"
    rows = [([(a, b, "t") for a, b in terms], [(a, b, "b") for a, b in base]) for terms, base in cases]
    data = spark.createDataFrame(rows, f"terms {kind}, base {kind}")
    for (terms, base), row in zip(cases, data.select(pii.outside(data.terms, data.base).alias("free")).collect()):
        want = [(a, b) for a, b in terms if not any(c < b and a < d for c, d in base)]
        assert sorted((x.start, x.end) for x in row.free) == sorted(want)


@pytest.mark.parametrize("extra", [[], ["at", "email", "term", "any", "row", "entity"]])
def test_nulls_empty_repeats_and_clashing_columns(docs, extra):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "none")]
    data = docs(rows, extra=extra)
    safe = pii.sanitise(data)
    assert safe.columns == data.columns
    texts = sorted(str(row.text) for row in safe.collect())
    assert texts == ["", "None", "[EMAIL]", "[EMAIL]", "[EMAIL]", "none"]
    assert pii.sanitise(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = pii.sanitise(docs([(1, "a@b.cd")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
