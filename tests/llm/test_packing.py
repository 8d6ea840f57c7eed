import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_fixtures import TABLES, docs  # noqa: F401

from traitloom.llm.packing import WORD_BPE, TextEncoder, best_fit_packing, encoder, plan_packing, token_pieces

ODD = [
    "it's I'LL <|endoftext|> x<|startoftext|>y",
    "ÀÉ ñandú ß İstanbul ſ ŉ",
    "日本語 текст ΣΑΣ é ́x",
    "a b c 12345 ½ ²",
    "",
    "!!! --- ~~~ @@",
]


def test_ids_are_those_of_the_tokenizer(spark):
    whole = Tokenizer.from_file(WORD_BPE)
    texts = ODD + [row.text for row in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    for text in texts:
        ids = np.frombuffer(encoder(WORD_BPE).encode(text), dtype="<u4")
        assert whole.encode(text, add_special_tokens=False).ids == ids.tolist()


def check(rows, capacity, lengths):
    """Sequences are gapless from 0 and within capacity; returns how many there are."""
    sequences = defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append((row.offset, row.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(row.length for row in rows) == sorted(lengths)
    return len(sequences)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = best_fit_packing(docs).collect()
    whole = Tokenizer.from_file(WORD_BPE)
    want = {}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[doc_id, piece] = (start, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    used = check(rows, 4096, [length for _, length, _ in want.values()])
    assert used <= -(-sum(length for _, length, _ in want.values()) // 4096) + 1


@pytest.mark.parametrize("counts", [{1: 5}, {7: 3, 3: 100}, {10: 2, 6: 5, 5: 5, 4: 7, 1: 9}, {}])
def test_plan_is_best_fit_decreasing(counts):
    plan = plan_packing(counts, 10)
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [i for i, room in enumerate(rooms) if room >= length]
            if fitting:
                rooms[min(fitting, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(10 - length)
    used = set()
    for i, (length, rank, first) in enumerate(zip(plan["length"], plan["rank"], plan["sequence"])):
        last = plan["rank"][i + 1] if i + 1 < len(plan["rank"]) and plan["length"][i + 1] == length else counts[length]
        used |= set(range(first, first + last - rank))
    assert len(used) == len(rooms)


def test_nulls_empty_long_repeats_and_clashing_columns(docs):
    long = "word " * 9000
    rows = [(1, None), (2, ""), (3, long), (None, "a"), (4, "a b"), (4, "a b")]
    found = best_fit_packing(docs(rows, extra=["piece", "rank", "sequence_id"])).collect()
    check(found, 4096, [1, 1, 4096, 4096, 809, 2, 3, 3])
    assert token_pieces(docs([(1, None)])).first().ids == [1]
    assert best_fit_packing(docs([])).count() == 0


def test_every_low_code_point():
    """Controls and all characters below U+0250, alone and between letters, as the tokenizer has them."""
    tokenizer, own = Tokenizer.from_file(WORD_BPE), TextEncoder(WORD_BPE)
    wrong = []
    for code in range(0x250):
        for text in (chr(code), f"a{chr(code)}b", f"A{chr(code)} {chr(code)}9"):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            if np.frombuffer(own.encode(text), dtype="<u4").tolist() != ids:
                wrong.append((hex(code), text))
    assert not wrong
