"""Token ids, their binary segments, and packing, against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from kinledger.llm import op2_binary_ids as o2  # noqa: E402
from kinledger.llm import op4_packing as o4  # noqa: E402
from kinledger.llm.common import written  # noqa: E402
from kinledger.llm.tokens import WordTokenizer, blocks, tokenizer  # noqa: E402

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TOKS = {f: WordTokenizer(public_tokenizers.path(f), remember=50) for f in FILES}
ODD = [None, "", " ", "  ", "a  b", "x\n y", "  hi", "x \n\n y", "tab\tx y ", "it's a <|endoftext|> \x00 z\x00", "é ́ a", "A B\n\nC d", "  x  y", "\x1c x \x85 y", "d 'll 's", "e" * 3000, "中文 字 x"]
LIBRARY = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
ODD += [form.format(t.content) for f in FILES for t in LIBRARY[f].get_added_tokens_decoder().values() for form in ("{}", "see {} here", "a{}b", " {}", "{0}{0} x", "x {}\n", "<{}>")]
ODD += ["<|END", "<|ENDOFTEXT|> a", "<|endoftext |>"]
TEXTS = st.lists(st.text(st.sampled_from("abC's ,.\n\t  é中1\x00\x1c"), max_size=30), max_size=6)


def whole(file, text):
    """Ids by the library as it comes."""
    return LIBRARY[file].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_odd_texts(file):
    ids, at = TOKS[file].ids(pa.array(ODD, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole(file, t) for t in ODD]
    ids, at = TOKS[file].ids(pa.array([], pa.string()))
    assert len(ids) == 0 and at.tolist() == [0]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(FILES))
def test_any_texts(texts, file):
    ids, at = TOKS[file].ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole(file, t) for t in texts]


def test_blocks_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 100, "", "y"])], ["text"])
    parts = list(blocks(batch, "text", 4))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == ["abc", None, "x" * 100, "", "y"] and len(parts) > 1


@given(st.lists(st.integers(0, 1 << 50), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    ef, end = o2.EliasFano.read(memoryview(raw := o2.EliasFano.of(np.array(values, np.uint64)).to_bytes()), 0)
    assert end == len(raw) and ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    bounds = np.cumsum(np.full(10_000, 700))
    assert len(o2.EliasFano.of(bounds).to_bytes()) * 8 / 10_000 < 2 + np.log2(700) + 2


DOCS = "doc_id long, text string, start long"
ROWS = [(8, "see <|endoftext|> here", 9), (5, "beta  gamma", 1), (2, None, 1), (None, "none", 2), (2, "again", 3), (9, "long " * 3000, 4), (5, "beta  gamma", 1), (-3, "", 0)]


def test_segments(spark):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    made = written(o2.write_segments(docs, public_tokenizers.path(FILES[0]), 2, most=50), "segments")
    got = sorted((tuple(r) for r in o2.read_index(made).collect()), key=lambda r: r[1])
    at = 0
    assert [r[0] for r in got] == [None, -3, 2, 2, 5, 5, 8, 9]
    left = defaultdict(list)
    for d, t, _ in ROWS:
        ids = whole(FILES[0], t) + [2]
        left[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for d, start, n, crc in got:
        assert start == at
        left[d].remove((n, crc))
        at += n
    assert not any(left.values())
    first = o2.Segment(bytes(made.orderBy("part", "seq").first().body))
    assert first.doc(0).tolist() == whole(FILES[0], "none") + [2]
    assert o2.read_index(written(o2.write_segments(docs.filter("false"), public_tokenizers.path(FILES[0]), 2), "none")).count() == 0


@given(st.integers(1, 10_000))
def test_cuts(n):
    parts = o4.cuts(n)
    assert sum(parts) == n and all(0 < p <= o4.CAPACITY for p in parts)
    lost = sum(o4.CAPACITY // (o4.CAPACITY // p) - p for p in parts)
    assert lost <= max(2, o4.CAPACITY // 24)


def test_packing(spark):
    docs = spark.createDataFrame(ROWS + [(100 + k, f"w{k} " * (k % 90 + 1), k) for k in range(200)], DOCS).repartition(4)
    rows = o4.packed(docs, public_tokenizers.path(FILES[1])).collect()
    want, got, seqs = defaultdict(list), defaultdict(list), defaultdict(list)
    for d, t, _ in docs.collect():
        want[d].append(whole(FILES[1], t) + [1])
    for r in rows:
        got[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, docs_of in want.items():
        assert sum(r.length for r in got[d]) == sum(map(len, docs_of))
        for ids in docs_of:
            for a in sorted({r.start for r in got[d] if r.doc_tokens == len(ids)}):
                piece = next(r for r in got[d] if r.doc_tokens == len(ids) and r.start == a and r.ids_crc32 == zlib.crc32(np.array(ids[a : a + r.length], "<u4").tobytes()))
                assert piece.length > 0
    pad = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= o4.CAPACITY and {r.padded for r in pieces} == {next(p for p in (1 << k for k in range(12)) if p >= at)}
        pad += pieces[0].padded - at
    assert sorted(seqs) == list(range(len(seqs)))
    assert pad < 0.05 * sum(r.length for r in rows) + 300
    assert o4.packed(docs.filter("false"), public_tokenizers.path(FILES[1])).count() == 0


def test_a_worker_keeps_no_more_than_asked():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array(["one two three four five six", None, "six five four three two one"])
    want = [x.tolist() for x in tokenizer(path, 900_000).ids(texts)]
    assert len(tokenizer(path, 900_000).memo) > 3
    few = tokenizer(path, 3)
    assert [x.tolist() for x in few.ids(texts)] == want and len(few.memo) <= 3
