from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galeledger.llm import hashing, order, repair, token_counts, token_files, token_ids

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

LAST = (1 << 63) - 1
SIGNS = list("abAB éÉñ .,!'’<|>\n\t\r ▁  012") + [
    "<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "'s", "'S", "é", "̸", "=", "ß", "İ", "Σ", "ςa", "日本", "😀", "×", "÷",
    "the ", "THE ", " \n", "\x85", "\x0b", "\x1c", "​", "  ",
]


@pytest.fixture(scope="module")
def strange():
    rnd = random.Random(3)
    made = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    return made + ["", None, " ", "  ", "\n", "▁", "▁ ", "a ", "a \nb"]


def test_counts_equal_the_library(strange):
    model = sentencepiece.SentencePieceProcessor(model_file=public.path(token_counts.MODEL))
    counter = token_counts._Counter(token_counts.MODEL)
    assert counter.at_spaces and counter.at_lines
    _, got = counter.count(pa.array(strange))
    assert got.tolist() == [len(model.encode(t or "")) for t in strange]


def test_ids_equal_the_library(strange):
    model = tokenizers.Tokenizer.from_file(public.path(token_files.MODEL))
    encoder = token_ids.Encoder(token_files.MODEL)
    assert encoder.split
    for low in range(0, len(strange), 40):
        part = strange[low : low + 40]
        ids, size = encoder.encode(pa.array(part))
        ends = np.concatenate([[0], np.cumsum(size)])
        for k, text in enumerate(part):
            wanted = model.encode(text or "", add_special_tokens=False).ids
            assert ids[ends[k] : ends[k + 1]].tolist() == wanted, repr(text)


def test_whole_texts_for_other_pipelines(strange):
    model = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encoder = token_ids.Encoder("byte_bpe_50k.json")
    assert not encoder.split
    ids, size = encoder.encode(pa.array(strange[:200]))
    assert ids.tolist() == [i for t in strange[:200] for i in model.encode(t or "", add_special_tokens=False).ids]


def test_known_pieces_are_forgotten(strange, monkeypatch):
    from galeledger.llm import pieces

    monkeypatch.setattr(pieces, "KNOWN_PIECES", 10)
    counter = token_counts._Counter(token_counts.MODEL)
    whole = counter.count(pa.array(strange))[1]
    parts = [counter.count(pa.array(strange[k : k + 100]))[1] for k in range(0, len(strange), 100)]
    assert np.concatenate(parts).tolist() == whole.tolist()


def test_rarely_used_pieces_are_dropped_first(monkeypatch):
    from galeledger.llm import pieces

    monkeypatch.setattr(pieces, "KNOWN_PIECES", 100)
    encoded = []

    def encode(some):
        encoded.extend(some)
        return np.array([len(x) for x in some for _ in range(2)], np.uint32), np.full(len(some), 2)

    known = pieces.Pieces(encode)
    often = [f"often{i}" for i in range(10)]
    for k in range(30):
        words = often + [f"rare{k}-{i}" for i in range(9)] + ["x" * n for n in (63, 64, 65, 200)]
        data, offsets = hashing.text_bytes(pa.array(words))
        values, size = known.sequences(known.look_up(data, offsets[:-1], offsets[1:]))
        assert values.tolist() == [len(w) for w in words for _ in range(2)] and (size == 2).all()
        assert len(known.names) <= 100 + 23
    assert all(encoded.count(w.encode()) == 1 for w in often)


def test_token_counts(table, odd_rows):
    model = sentencepiece.SentencePieceProcessor(model_file=public.path(token_counts.MODEL))
    docs = table(odd_rows).withColumn("n_tokens", F.lit("x"))
    got = sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str)
    size = [len(model.encode(t or "")) for _, t in odd_rows]
    wanted = [(i, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(odd_rows, size)]
    assert got == sorted(wanted, key=str)
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (50, 2), (1000, 1), (1000, 3), (20000, 50)])
def test_grammar_round_trip(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.integers(0, kinds, n)
    sequence, rules, lengths = repair.compress(ids, 1000)
    assert (repair.expand(sequence, rules, 1000) == ids).all()
    assert (repair.expand(sequence, rules, 1000, lengths) == ids).all()
    assert len(rules) == len(lengths)
    for rule, length in zip(rules, lengths):
        assert len(repair.expand(rule, rules, 1000)) == length
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2))
        assert (repair.decode(sequence, rules, lengths, 1000, a, b) == ids[a:b]).all()


def brute_uses(sequence):
    """Occurrences of each pair that don't overlap, taken from the left."""
    uses, last = {}, {}
    for i, pair in enumerate(zip(sequence, sequence[1:])):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            uses[pair] = uses.get(pair, 0) + 1
            last[pair] = i
        else:
            last[pair] = None
    return uses


@pytest.mark.parametrize("n, kinds", [(3000, 2), (3000, 12), (6000, 400), (500, 1)])
@pytest.mark.parametrize("few", [True, False])
def test_no_pair_is_left_that_pays(n, kinds, few, monkeypatch):
    if few:  # symbols and places that don't fit one number
        monkeypatch.setattr(repair, "_SYMBOL", np.uint64(3))
    ids = np.random.default_rng(n + kinds).integers(0, kinds, n)
    sequence, rules, lengths = repair.compress(ids, 1000)
    assert max(brute_uses(sequence.tolist()).values(), default=0) < repair.LEAST_USES
    assert (repair.expand(sequence, rules, 1000, lengths) == ids).all()
    assert len(sequence) + 3 * len(rules) <= n
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)


def test_grammar_shortens_repetition():
    ids = np.tile(np.arange(40), 200)
    sequence, rules, _ = repair.compress(ids, 100)
    assert len(sequence) + 2 * len(rules) < len(ids) / 8


@pytest.mark.parametrize("ranges, shard", [((8 << 20, 256 << 20), 8 << 20), ((600, 1200), 500), ((1 << 20, 1 << 20), 900)])
def test_token_files_round_trip(spark, table, odd_rows, prose, tmp_path, monkeypatch, ranges, shard):
    monkeypatch.setattr(order, "RANGE_BYTES", ranges)
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard)
    monkeypatch.setattr(hashing, "SLICE_BYTES", shard)
    monkeypatch.setattr(hashing.slices, "__defaults__", ("text", min(shard, 4 << 20)))
    rows = odd_rows + [(i + 100, t) for i, t in prose]
    path = str(tmp_path / "tokens")
    token_files.write_token_files(table(rows).withColumn("shard", F.lit(9)), path)
    model = tokenizers.Tokenizer.from_file(public.path(token_files.MODEL))
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(LAST if i is None else i for i, _ in rows)
    start, made = 0, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(r.ids) and ids[-1] == 2
        made.setdefault(r.doc_id, []).append(ids[:-1].tolist())
        start += len(ids)
    wanted = {}
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        wanted.setdefault(LAST if i is None else i, []).append(ids)
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v) for k, v in wanted.items()}
    first = spark.read.parquet(path).orderBy("part", "shard").first()
    whole = [i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()][: first.n_tokens]
    part = token_files.token_slice(spark, path, first.part, first.shard, 3, min(40, len(whole)))
    assert part.tolist() == whole[3 : min(40, len(whole))]


def test_token_files_of_nothing(spark, table, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(table([]), path)
    assert token_files.read_token_files(spark, path).collect() == []
    assert len(token_files.token_slice(spark, path, 0, 0, 0, 5)) == 0
