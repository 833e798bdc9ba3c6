import random

import pytest

from wareloom.llm import bpe, pieces, token_counts
from wareloom.llm.queries import vocabulary

BITS = ["'s", "'re", "'ll", "'l", "'r", "'ve", "'", "''", " ", "  ", "\n", "\t", "\r\n", "a", "the", "It", "ñ", "日本", "１２", "3", "45", "...", "!?",
        "<|endoftext|>", "<|endof", "<s>", "</s>", "<0x0A>", "\x1c", "\x85", "é", "é", "🙂", "​", "ll", "\x00", "ſ", "²", "Ⅷ", "　", "Hello", "ing"]


def texts(seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(2500)]
    out += ["".join(chr(rng.choice([rng.randint(1, 300), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)]))
                    for _ in range(rng.randint(0, 20))) for _ in range(2500)]
    return [*out, "a" * 5000, "=" * 3000, " " * 4000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), ""]


def library_counts(some):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch(some, add_special_tokens=False)]


def library_ids(some):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")).encode(some, num_threads=1)


def documents(spark, folder):
    return [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def machine():
    return pieces.compiled(open(vocabulary("piece_bpe_32k.model"), "rb").read())


def test_counts_equal_the_library():
    some = texts(1)
    assert token_counts.compiled(open(vocabulary("byte_bpe_50k.json"), "rb").read()).counts(some).tolist() == library_counts(some)


def test_counts_of_documents(spark, folder):
    some = documents(spark, folder)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(some)] + [(None, None, 1), (1, "", 1), (1, "", 1)], "doc_id long, text string, n_tokens int")
    got = token_counts.count(docs, vocabulary("byte_bpe_50k.json")).collect()
    want = [(i, len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip(some, library_counts(some)))]
    assert sorted(map(tuple, got), key=str) == sorted([*want, (None, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False)], key=str)
    assert token_counts.count(docs.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []


def test_chunks_compose_at_any_place():
    split = token_counts.splitter()
    rng = random.Random(3)
    end = len(token_counts.CLASSES) - 1
    import numpy as np

    for n in (1, 511, 512, 513, 5000):
        classes = np.array([rng.randrange(end) for _ in range(n)] + [end], np.uint8)
        state, want = "fresh", np.zeros(n + 1, bool)
        for i, c in enumerate(classes):
            state, out = token_counts.step(state, token_counts.CLASSES[c])
            want[i] |= bool(out & token_counts.HERE)
            if out & token_counts.BEFORE:
                want[i - 1] = True
        assert (split.starts(classes) == want).all()


def test_transducer_equals_merging():
    ranks = {("a", "b"): 0, ("b", "a"): 1, ("ab", "a"): 2, ("a", "a"): 3, ("aa", "b"): 4}
    p = bpe.Pairs({"a", "b"} | {x + y for x, y in ranks}, lambda x, y: ranks.get((x, y)))
    t, rng = bpe.Transducer(p), random.Random(4)
    for _ in range(2000):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        assert t.count(s) == len(p.merge(list(s)))


def test_pieces_equal_the_library(machine):
    some = texts(2)
    assert [machine.encode(t) for t in some] == library_ids(some)


def test_round_trip(machine):
    assert all(machine.decode(machine.encode(t)) == t for t in texts(6) if pieces.META not in t)
    assert machine.decode(machine.encode("a▁b")) == "a b"


def test_pieces_of_documents(spark, folder):
    some = documents(spark, folder)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(some)] + [(None, None, 1), (-1, "", 1)], "doc_id long, text string, token_ids int")
    path = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(docs, path)
    got = {r.doc_id: list(r.token_ids) for r in encoded.collect()}
    assert got == dict(enumerate(library_ids(some))) | {None: [], -1: []}
    assert {r.doc_id: r.text for r in pieces.decode(encoded, path).collect()} == dict(enumerate(some)) | {None: "", -1: ""}
    digests = pieces.encode_digests(docs, path).collect()
    assert all(r.round_trip and r.n_tokens == len(got[r.doc_id]) for r in digests)
    assert pieces.encode(docs.limit(0), path).collect() == []
