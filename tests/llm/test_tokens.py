import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrysql.llm import bpe, pieces, token_counts, token_files
from quarrysql.llm.queries import tokenizer

from .conftest import ODD


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_token_files_round_trip(spark, odd, lib, tmp_path):
    path = f"file://{tmp_path}/store"
    index = token_files.write(odd, path, tokenizer("byte_bpe_50k.json"))
    assert index.agg(F.sum("n_docs")).first()[0] == len(ODD)
    got = sorted((tuple(r) for r in token_files.read(spark, path).collect()), key=lambda r: r[1])
    start = 0
    for (i, t), r in zip(sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert r == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_leftovers_of_failed_attempts_go(spark, odd, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "shard-000000-dead.ids").write_bytes(b"xx")
    token_files.write(odd, f"file://{tmp_path}/store", tokenizer("byte_bpe_50k.json"))
    assert not (tmp_path / "store" / "shard-000000-dead.ids").exists()


def test_empty_tables(empty):
    name = tokenizer("byte_bpe_50k.json")
    assert token_files.query(empty, name).collect() == [] and token_counts.query(empty, name).collect() == []
    assert pieces.query(empty, tokenizer("piece_bpe_32k.model")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(odd, name):
    path = tokenizer(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        want = [len(own.encode(t or "")) for _, t in ODD]
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        want = [len(own.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    got = token_counts.count(odd.withColumn("n_tokens", F.lit(0)), path, limit=100).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=key) == sorted(((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(ODD, want)), key=key)


def test_caches_age_without_harm(lib):
    own = bpe.Encoder(tokenizer("byte_bpe_50k.json"), count=True, most=3)
    import pyarrow as pa

    texts = [f"word{i} and other{i % 7}, words.\nMore{i}" for i in range(60)]
    for t in texts:
        assert own.counts(pa.array([t]))[0] == len(lib.encode(t, add_special_tokens=False).ids)


def test_texts_of_many_lines(lib):
    import pyarrow as pa

    texts = ["\n".join(f"line{i}" for i in range(100_000)), "\n".join("日本語テ" for _ in range(30_000)), "x\n\ny" * 2000, "a  b\tc \n d" * 3000, "no end\n", "\nstart"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.Encoder(tokenizer("byte_bpe_50k.json"), count=True).counts(pa.array(texts)).tolist() == [len(w) for w in want]
    ids, sizes = bpe.Encoder(tokenizer("byte_bpe_50k.json")).encode(pa.array(texts))
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_random_texts_equal_the_library(lib):
    import random

    import pyarrow as pa

    r = random.Random(1)
    parts = ["a", "word", "The", " ", "  ", "\n", "\n\n", ".", ",", "'s", "'", "23", "é", "日本", "\t", "\x1c", "\u00a0", "\r", "-", "x.", "\x85", "<|endoftext|>", "\u3000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(4000)]
    ids, sizes = bpe.Encoder(tokenizer("byte_bpe_50k.json")).encode(pa.array(texts), 2)
    ends = np.cumsum(sizes).tolist()
    for t, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2], t


def test_words_are_asked_once_whatever_follows(lib, monkeypatch):
    import pyarrow as pa

    own, asked = bpe.Encoder(tokenizer("byte_bpe_50k.json")), []
    for name in ("ask", "_ask_words"):
        one = getattr(own, name)
        monkeypatch.setattr(own, name, lambda some, *more, one=one: asked.extend(some) or one(some, *more))
    words = [a + b + c for a in "pqrst" for b in ("aé", "слов", "ou") for c in "klmno"]
    texts = [f"{w}{end} {w}{end}" for w in words for end in ("", ".", ",", ";", "!", "?", ":", ")", "###", "%%%", "'s", ".\nAnd", "\nAnd")]
    ids, sizes = own.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in lib.encode(t, add_special_tokens=False).ids]
    assert len(asked) <= 2 * len(words) + 20


def test_pieces_have_the_same_ids_alone(lib):
    import random

    import pyarrow as pa

    r = random.Random(4)
    white = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    parts = ["a", "The", " ", " ", "  ", "\n", ".", "'s", "'ll", "23", "é", "×", "÷", "ſ", "слово", "日本", "\x00", "—", "“", "ª", "²", "🙂", "א", *white]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(8000)]
    pieces_of, bounds = bpe.cut(pa.array(texts))
    pieces_of = pieces_of.to_pylist()
    assert ["".join(pieces_of[a:b]) for a, b in zip(bounds, bounds[1:])] == texts
    alone = [x.ids for x in lib.encode_batch(pieces_of, add_special_tokens=False)]
    assert [[i for x in alone[a:b] for i in x] for a, b in zip(bounds, bounds[1:])] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def brute(own, text):
    """The best sum of scores over all segmentations."""
    usable = {p: s for p, s, k in zip(own.pieces, own.scores, own.kinds) if k in (pieces.NORMAL, pieces.USER)}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            if (s := usable.get(text[start:end])) is not None:
                best[end] = max(best[end], best[start] + s)
        if text[end - 1] not in usable:
            best[end] = max(best[end], best[end - 1] + own.unknown_score)
    return best[-1]


def test_pieces_are_best_and_read_back():
    own = pieces.processor(tokenizer("piece_bpe_32k.model"))
    for _, t in ODD:
        t = (t or "")[:300]
        ids = own.encode(t).tolist()
        assert own.decode(ids) == t
        if t:
            score = unknown = 0.0
            for i in ids:
                if own.kinds[i] != pieces.BYTE:
                    score += own.scores[i]
            marked = (" " + t).replace(" ", pieces.MARKER)
            single = {p for p, k in zip(own.pieces, own.kinds) if k in (pieces.NORMAL, pieces.USER)}
            unknown = sum(c not in single for c in marked) * own.unknown_score
            assert score + unknown == pytest.approx(brute(own, marked))
    assert own.decode(own.encode("a▁b")) == "a b"
    assert own.decode([own.bytes[0xC3], own.bytes[0x28]]) == "�("


def test_trie_finds_all_words():
    words = {b"a": 1, b"ab": 2, b"abc": 3, "é".encode(): 4, "▁".encode(): 5, "▁▁a".encode(): 6, bytes([255, 1]): 7}
    trie = pieces.Trie(words)
    for word, number in words.items():
        state = 0
        for b in word:
            to = trie.base[state] + b
            assert trie.check[to] == state
            state = to
        assert trie.value[state] == number


def test_small_unigram_model():
    model = pieces.Model(["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab"], [0, -3.0, -2.0, -2.0, -2.5, -3.5, -9.0], [pieces.UNKNOWN] + [pieces.NORMAL] * 6)
    own = pieces.Processor(model)
    assert [own.pieces[i] for i in own.encode("ab")] == ["▁", "ab"] or sum(own.scores[i] for i in own.encode("ab")) == -5.5
    assert own.decode(own.encode("ab ab")) == "ab ab"
    assert own.encode("c").tolist() == [1, 0]


def test_new_chunks_are_segmented_together(monkeypatch):
    import random

    import pyarrow as pa

    r = random.Random(3)
    parts = ["a", "ab", "word", "ntion", "les", " ", "  ", "\n", ".", "▁", "é", "日本", "🙂", "\t", "\x00", "b" * 40]
    texts = [None, "", " ", "\n", " \n ", *("".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(1500)), "x" * 400]
    letters = ["▁", "▁a", "a", "b", "ab", "é", "▁▁"]
    small = lambda more: pieces.Processor(pieces.Model(["<unk>", *letters, *more], [0.0, -2.0, -2.5, -2.0, -2.0, -4.0, -1.0, -4.0, *[-3.0] * len(more)], [pieces.UNKNOWN, *[pieces.NORMAL] * len(letters), *[pieces.NORMAL] * len(more)]))
    for own in (pieces.Processor(pieces.Model.load(tokenizer("piece_bpe_32k.model"))), small([]), small(["b\nb"]), small(["b▁b"])):
        one = own.viterbi
        want = [one((" " * own.prefix + t.replace("▁", " ")).replace(" ", "▁")) if t else [] for t in texts]
        alone = []
        monkeypatch.setattr(own, "viterbi", lambda text: alone.append(text) or one(text), raising=False)
        ids, offsets = own.encode_all(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
        if own.parts:
            # Only long chunks are searched one by one, however many new ones there are.
            assert all(len(t.encode()) > pieces.TOGETHER for t in alone)
        if own.bytes:
            assert own.decode_all(ids, offsets) == [(t or "").replace("▁", " ") for t in texts]
        again = own.encode_all(pa.array(texts[::-1]))
        assert [again[0][a:b].tolist() for a, b in zip(again[1], again[1][1:])] == want[::-1]


def test_long_stretches_of_text():
    own = pieces.processor(tokenizer("piece_bpe_32k.model"))
    for t in ("日本語テキスト" * 4000, "x" * 40_000, "anton\n" * 9000, "\U0001f642é" * 6000):
        ids = own.encode(t)
        assert own.decode(ids) == t
        scored = sum(own.scores[i] for i in ids.tolist() if own.kinds[i] != pieces.BYTE)
        marked = pieces.MARKER + t
        single = {p for p, k in zip(own.pieces, own.kinds) if k in (pieces.NORMAL, pieces.USER)}
        assert scored + sum(c not in single for c in marked) * own.unknown_score == pytest.approx(brute(own, marked))


def test_clashing_columns(spark, odd):
    clash = odd.withColumns({"ids": F.lit(3), "_text": F.lit("y"), "_in_0": F.lit(1), "decoded": F.lit("z")})
    got = pieces.stage(clash, tokenizer("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "_text", "_in_0", "decoded", "ids"]
    back = pieces.decode(got, tokenizer("piece_bpe_32k.model")).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t in ODD) and {r["_text"] for r in back} == {"y"}


def test_pieces_query(odd):
    rows = {(r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_sha256, r.round_trip) for r in pieces.query(odd, tokenizer("piece_bpe_32k.model")).collect()}
    own = pieces.processor(tokenizer("piece_bpe_32k.model"))
    # Not by the chunks that the operator's cache is filled with, but each text in one piece.
    want = set()
    for i, t in ODD:
        ids = own.viterbi((" " + t).replace(" ", pieces.MARKER)) if t else []
        want.add((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert rows == want
    back = pieces.decode(pieces.encode(odd, tokenizer("piece_bpe_32k.model")), tokenizer("piece_bpe_32k.model")).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t in ODD)
