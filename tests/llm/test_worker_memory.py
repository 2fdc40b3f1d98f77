"""Python workers hold a few rows at a time, not a whole Arrow batch."""

import random

import pyarrow as pa
import pytest

from odd import docs
from stockfair.llm import bpe, periodic


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_encoder_takes_and_gives_few_rows_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "cat's", "日本", "😀", "12", "--", "<|endoftext|>", "\n", "  ", "naïve", "zz" * 30]
    some = [None, "", "a" * 900, *[" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)]]
    batch = pa.record_batch([pa.array(range(len(some))), pa.array(some, pa.string())], names=["doc_id", "text"])
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 300)
    parts = list(bpe._by_size(batch))
    assert len(parts) > 10 and [t for _, p in parts for t in p] == [t or "" for t in some]
    assert [i for x, _ in parts for i in x.to_pylist()] == list(range(len(some)))
    # a full table of kept stretches, and none at all, change no ids
    whole = bpe.Codec(bpe.default_path()).encode_many([t or "" for t in some])
    for room in (0, 7):
        monkeypatch.setattr(bpe, "CACHE_RUNS", room)
        codec = bpe.Codec(bpe.default_path())
        got = [ids for _, p in parts for m in [codec.encode_many(p)] for ids in map(m.__getitem__, range(len(m)))]
        assert len(codec.cache) <= room
        assert [x.tolist() for x in got] == [whole[k].tolist() for k in range(len(some))]
        assert [codec.decode(x) for x in got] == [t or "" for t in some]
    monkeypatch.undo()
    encoded, trips = by_id(bpe.encode(docs(spark, some))), by_id(bpe.round_trip(docs(spark, some)))
    assert all(encoded[k]["ids"] == whole[k].tolist() and trips[k]["exact"] for k in range(len(some)))


def test_decoder_refuses_unknown_ids():
    codec = bpe.Codec(bpe.default_path())
    assert codec.decode([]) == "" and codec.encode(None) == []
    for bad in ([-1], [len(codec.known)]):
        with pytest.raises(KeyError):
            codec.decode(bad)


def test_runs_are_found_few_rows_at_a_time(monkeypatch):
    some = [None, "", "a b c " * 20, "x " * 400, *["w%d v u" % k for k in range(50)]]
    batch = pa.record_batch([pa.array(range(len(some))), pa.array(some, pa.string())], names=["doc_id", "text"])
    whole = periodic._of_texts(some, 24)
    monkeypatch.setattr(periodic, "BYTES_AT_ONCE", 100)
    parts = list(periodic._slices(batch))
    assert len(parts) > 4 and max(p.num_rows for p in parts) < 20
    assert [r for p in parts for r in periodic._of_texts(p.column(1).to_pylist(), 24)] == whole


def test_period_longer_than_what_the_longest_window_leaves():
    """A text alone in its lot: windows of 1,024 of 1,101 words, a period of 300."""
    (n, runs, rest), = periodic._of_texts([" ".join(f"w{i % 300}" for i in range(1100))], 24)
    assert n == 1100 and [tuple(r.values()) for r in runs] == [(0, 1100, 300)]
    assert rest == " ".join(f"w{i}" for i in range(300))
