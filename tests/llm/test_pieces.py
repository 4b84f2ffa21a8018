from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from quire.llm import pieces as P
from tests.llm import edge

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["▁", " ", "  ", " " * 17, " " * 40, "\n", "\r", "\r\n", ";\r", "a", "the", " the", "é", "é", "中", "文字", "🙂", "<s>", "</s>", "<0x41>", "<unk>", "1", "23", "!!", "'s", "\x00", " ", "　", "ｆ", "हिन्दी", "return", "();", "//", "\t", "²", "².", "½"]


def text(r: random.Random) -> str:
    return "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))


@pytest.mark.parametrize("seed", range(20))
def test_ids_and_decoded_text_are_the_librarys(seed):
    r, p = random.Random(seed), P.pieces(PATH)
    for _ in range(100):
        t = text(r)
        ids = LIBRARY.encode(t)
        assert p.encode(t) == ids
        assert p.decode(ids) == LIBRARY.decode(ids)
        n, crc, shown = p.digest(t)
        assert (n, crc) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert shown == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_one_table_holds_the_encodings_of_all_prefixes():
    r, p = random.Random(3), P.pieces(PATH)
    for _ in range(40):
        t = "".join(r.choice(PARTS) for _ in range(12))
        escaped = p.escaped(t)
        table = p.table(escaped) if escaped else []
        for k in range(1, len(t) + 1):
            assert p.read_back(escaped, table, k + 1) == LIBRARY.encode(t[:k])


def test_tables_need_no_cuts():
    """The same ids whether a text is cut into parts or gets one table."""
    r, p = random.Random(5), P.pieces(PATH)
    for _ in range(100):
        t = text(r)
        assert p.part_ids(p.escaped(t)) == p.encode(t)


def test_cuts_keep_to_what_pieces_never_join():
    assert P._cuts({"a\n"}) == P._cuts({"\nb", "xy"}) == "▁*[^▁]+|▁+"
    import re

    assert re.findall(P._cuts({"ab", ".a"}), "▁ab.ab,▁▁x1y\n\n▁") == ["▁ab", ".ab", ",", "▁▁x", "1y", "\n\n", "▁"]
    assert re.findall(P._cuts({"b."}), "▁ab.ab") == ["▁a", "b.a", "b"]


@pytest.mark.parametrize("t", ["x" * 300_000, " " * 100_000, "中文" * 50_000, "á" * 20_000])
def test_long_parts(t):
    assert P.pieces(PATH).encode(t) == LIBRARY.encode(t)


def test_awkward_rows(spark):
    got = P.encode_decode(edge.table(spark), PATH).collect()

    def want(row):
        ids = LIBRARY.encode(row[1] or "")
        return row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted(map(want, edge.ROWS), key=str)
    assert P.encode_decode(edge.empty(spark), PATH).collect() == []
    ids = {r.doc_id: r.ids for r in P.token_ids(edge.table(spark), PATH).collect()}
    assert all(ids[r[0]] == LIBRARY.encode(r[1] or "") for r in edge.ROWS)
