import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopmetrics.llm.bpe import Bpe, decoded, encoded
from shopmetrics.llm.common import table
from shopmetrics.llm.queries import BYTE_BPE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [
    "", " ", "\n\n  \t x", "it's we'll I'D", "a<|endoftext|>  <|endoftext|>b<|endoftext", "é́ß 日本語 😀👩‍👩‍👧", "\x00\x1c\x85 　 x",
    "12345 ½ ٣", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "�\U0010ffff", "x" * 200_000, "ab" * 3000 + " " * 5000 + "c",
]


@pytest.fixture(scope="module")
def own():
    return Bpe(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_equals_the_library(own, library):
    pick = random.Random(1)
    letters = "abcdeinorst THE'.,\n\t 0123éüñ日本<|>_-" + "".join(map(chr, range(0x0, 0x300)))
    texts = ODD + ["".join(pick.choice(letters) for _ in range(pick.randint(0, 400))) for _ in range(500)]
    for text in texts:
        ids = own.encode(text)
        assert ids == ids_of(library, text)
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == text


def test_every_kind_of_character(own, library):
    for low in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}  " for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert own.encode(text) == ids_of(library, text)


def test_long_texts_are_cut_into_pieces(own, library, monkeypatch):
    import shopmetrics.llm.bpe as bpe

    text = " ".join(f"word{k} \n" for k in range(2000))
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    assert Bpe(BYTE_BPE).encode(text) == ids_of(library, text)


def test_decodes_any_ids(own, library):
    pick = random.Random(2)
    for _ in range(200):
        ids = [pick.randrange(50257) for _ in range(pick.randint(0, 40))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([64, 999_999, 65], "<u4").tobytes()) == library.decode([64, 999_999, 65], skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Bpe("/opt/tokenizers/word_bpe_49k.json")


def test_rows(make_docs, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, None), (3, "twice"), (3, "twice")]
    docs = make_docs(rows).withColumn("a.b", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("decoded", F.lit(3))
    found = sorted(map(tuple, decoded(encoded(docs, BYTE_BPE), BYTE_BPE).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = ids_of(library, text or "")
        want.append((doc_id, len(ids) // 4, bytearray(ids), text or ""))
    assert found == sorted(want, key=str)
    assert decoded(encoded(docs.limit(0), BYTE_BPE), BYTE_BPE).collect() == []


def test_query(spark, library):
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, SF_DIR).collect()}
    docs = table(spark, SF_DIR, "documents").collect()
    assert len(found) == len(docs)
    for row in docs:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), back.encode())]
        assert found[row["doc_id"]] == (len(ids), *digests)
