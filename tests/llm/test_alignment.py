from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import alignment as M
from tests.llm import edge

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The contract read literally: both libraries over whole texts, every overlapping pair of tokens."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(M.aligner(A, B).a._alphabet)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        row = None
        if text:
            raw = (" " + text).encode()
            ids_a, ids_b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            parts_a = [bytes(letters[c] for c in ta.id_to_token(i)) for i in ids_a]
            parts_b = [bytes([int(tb.id_to_piece(i)[1:-1], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(parts_a) == raw == b"".join(parts_b):
                spans = []
                for parts in (parts_a, parts_b):
                    at, out = 0, []
                    for x in parts:
                        out.append((at, at + len(x)))
                        at += len(x)
                    spans.append(out)
                ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                links, j = [], 0
                for i, (s, e) in enumerate(spans[0]):
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(ids_b) and spans[1][k][0] < e:
                        links.append((ids_a[i], ids_b[k]))
                        k += 1
                groups, lo = [], 0
                for hi in ends:
                    groups.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, sp, strict=True) if lo <= s < hi) for ids, sp in zip((ids_a, ids_b), spans, strict=True)))
                    lo = hi
                counts.update(set(links))
                row = len(ids_a), len(ids_b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
        found.append((doc_id, row))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((i, 0, 0, 0, 0, 0, 0, "") if r is None else (i, *r[:3], len(r[3]), sum(counts[x] == best[x[0]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for i, r in found), key=str)


MORE = [
    (20, "special <|endoftext|> and <s> </s> <0x41> are plain"),
    (21, "a\r\nb;\r\n\n  c\t\td   e  f \x1c g"),
    (22, "kept? no: ▁ is a space to one of them"),
    (23, "中文 и слово, 🙂🙂 ½ of it’s naïve"),
    (24, " leading and trailing  "),
    (25, "x" * 5000),
    (26, " "),
    (27, "kept? no: ▁ is a space to one of them"),
]


@pytest.mark.parametrize("block", [1, 40, M.BLOCK])
def test_against_the_libraries(spark, block):
    rows = [(r[0], r[1] if r[1] is not edge.LONG else r[1][:3000]) for r in edge.ROWS] + MORE
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, M.align(docs, A, B, block=block).collect()), key=str)
    assert got == plain(rows)


def test_extra_columns_long_texts_and_empty_tables(spark):
    got = {r.doc_id: r for r in M.align(edge.table(spark), A, B).collect()}
    assert got[2].n_a == got[3].n_links == 0 and got[2].groups_sha256 == "" and got[5].n_a > 100_000
    assert M.align(edge.empty(spark), A, B).collect() == []
    assert M.align(edge.table(spark).where("text is null"), A, B).count() == 1


def test_segments_are_cut_only_where_neither_vocabulary_joins():
    al = M.aligner(A, B)
    assert al.segments(" a  b\r\nc\n d  e") == [" a", "  b\r\nc", "\n d  e"]
