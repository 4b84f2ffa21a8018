from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire import scratch
from quire.llm import token_counts, token_orc
from quire.llm.bpe import encoder
from tests.llm import edge

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


PIECES = ["a", "'", "'ll", "'re", " ", "  ", "\n", "\n\n", "the", " world", "1", "23", "!!", "é", "ß", ".", "token", "²", "中", "\x1c", "<|endoftext|>"]


WIDE = ["中", "文字", "Ωμέγα", "Привет", " – ", "—", "“", "”", "’s", "'s", "½", "Ⅷ", "٣", "ł", "€", "\u00a0", "\u2003", "\u0301", "😀", "ª", "ǅ", "\x85", "\x1f", " ", "a", "<|endoftext|>", "<|endof", "हिन्दी"]


@pytest.mark.parametrize("seed", range(60))
def test_every_prefix_count_is_the_librarys(seed):
    r = random.Random(seed)
    text = "".join(r.choice(WIDE if seed >= 25 else PIECES[:17] if seed % 3 else PIECES) for _ in range(25))
    p = encoder(PATH).prefixes(text)
    counts = [len(ids(text[:k])) for k in range(len(text) + 1)]
    assert [p.at(k) for k in range(len(text) + 1)] == counts
    for budget in (0, 1, 4, 11):
        assert p.longest(budget) == max(k for k, c in enumerate(counts) if c <= budget)
        assert encoder(PATH).fitting(text, budget) == (counts[-1], p.longest(budget))


def test_encoding_is_the_librarys():
    r = random.Random(7)
    for _ in range(60):
        text = "".join(r.choice(PIECES + WIDE) for _ in range(40))
        assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids(text)


def test_every_character_class_is_the_librarys():
    points = [p for p in range(0x3000) if not 0xD800 <= p < 0xE000] + list(range(0x10000, 0x10400))
    for lo in range(0, len(points), 64):
        text = "".join(x + chr(p) for p in points[lo : lo + 64] for x in (" ", "a", "1", "!"))
        assert [encoder(PATH)._letters(p) for p in encoder(PATH).pieces(text)] == [p for p, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


def test_a_long_text_of_other_scripts():
    text = "“Naïve” – 中文 и слово, ½ of it’s. " * 4000
    enc = encoder(PATH)
    assert enc.count(text) == len(ids(text))
    n, fits = enc.fitting(text, 512)
    assert n == len(ids(text)) and len(ids(text[:fits])) <= 512 < min(len(ids(text[:e])) for e in range(fits + 1, fits + 40))


def test_counts_of_awkward_rows(spark):
    got = token_counts.token_counts(edge.table(spark), PATH, limit=5).collect()
    want = sorted(((r[0], len((r[1] or "").encode()), len(ids(r[1] or ""))) for r in edge.ROWS), key=str)
    assert sorted(((g.doc_id, g.n_bytes, g.n_tokens) for g in got), key=str) == want
    assert all(g.over_limit == (g.n_tokens > 5) for g in got)
    assert token_counts.token_counts(edge.empty(spark), PATH).collect() == []


def test_orc_round_trip(spark):
    path = scratch.new_path(spark, "test-orc")
    token_orc.write_tokens(edge.table(spark), path, PATH, end_id=2)
    rows = token_orc.read_tokens(spark, path).collect()
    got = sorted(((r.doc_id, tuple(r.ids)) for r in rows), key=str)
    assert got == sorted(((r[0], tuple([*ids(r[1] or ""), 2])) for r in edge.ROWS), key=str)
    digest = token_orc.digests(spark, path).orderBy("start").collect()
    ordered = [d.doc_id for d in digest]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x))
    at = 0
    by_id = {r.doc_id: r.ids for r in rows}
    for d in digest:
        assert d.start == at
        at += d.n_tokens
        assert d.ids_crc32 == zlib.crc32(np.array(by_id[d.doc_id], "<u4").tobytes())
    assert [r.doc_id for r in token_orc.read_tokens(spark, path, [5, 77]).collect()] == [5]


def test_orc_stripes_have_indexes_and_bloom_filters(spark):
    """The footers of the files written: stripes in id order with statistics, row indexes and Bloom filters on doc_id."""
    from pyarrow import orc

    path = scratch.new_path(spark, "test-orc-stripes")
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat(concat('word', id % 7, ' '), 20) as text").repartition(1)
    token_orc.write_tokens(docs, path, PATH, end_id=2)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kinds, rows = set(), 0
    root = jvm.org.apache.hadoop.fs.Path(path)
    for status in root.getFileSystem(conf).listStatus(root):
        if not status.getPath().getName().endswith(".orc"):
            continue
        reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_orc.INDEX_ROWS and len(reader.getStripes()) >= 1
        rows += reader.getNumberOfRows()
        with open(status.getPath().toUri().getPath(), "rb") as f:
            assert orc.ORCFile(f).nstripes == len(reader.getStripes())
        inner = reader.rows()
        for stripe in reader.getStripes():
            for stream in inner.readStripeFooter(stripe).getStreamsList():
                kinds.add((stream.getColumn(), stream.getKind().toString()))
        inner.close()
    assert rows == 6000
    assert {(2, "ROW_INDEX"), (2, "BLOOM_FILTER_UTF8")} <= kinds
    plan = token_orc.read_tokens(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan or "PushedFilters: [In(doc_id, [5])]" in plan


def test_orc_of_an_empty_table(spark):
    path = scratch.new_path(spark, "test-orc-empty")
    token_orc.write_tokens(edge.empty(spark), path, PATH, end_id=2)
    assert token_orc.digests(spark, path).collect() == []
