"""The pipeline against plain versions of its stages, which share no code with the operators."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from quarrysql.llm import mixing, pieces, quality_rules, secret_scans
from quarrysql.llm.queries import tokenizer

from .test_documents import base, brute_join, plain_candidates, plain_score
from .test_rules_and_mixing import WORD, measures
from .test_tokens import brute

COMMON = "the of and to in is that it for on".split()


def texts(seed=11):
    """doc_id, text, source: prose, copies, near copies, secrets, what the rules reject, and odd rows."""
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(COMMON) if r.random() < 0.3 else "".join(r.choice("aeiou") + r.choice("bcdlmnrst") for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = []
    for i in range(90):
        text = prose(r.randrange(52, 160))
        if i % 9 == 0:
            w = text.split()
            w.insert(r.randrange(len(w)), r.choice(['token = "' + "%040x" % r.getrandbits(160) + '"', "ghp_" + "".join(r.choice("abcdefGHIJKL0123456789") for _ in range(36)), "AKIA" + "".join(r.choice("ABCDEFGHIJ0123456789") for _ in range(16))]))
            text = " ".join(w)
        rows.append((10 * i + 5, text, "hot" if i % 3 else r.choice(["a", "b", None])))
    for k in range(25):
        i, t, _ = rows[r.randrange(90)]
        w = t.split()
        if k % 2:
            w[-1] = "other"
        rows.append((2000 + k, (" " if k % 4 else "  ").join(w), r.choice(["hot", "a", "c"])))
    rows += [(5, rows[0][1], "hot"), (None, rows[3][1], "a"), (None, prose(80), "b"), (3000, None, "a"), (3001, "", "a"), (3002, "too few words", "b"), (3003, "% # $ * " * 40, "a"), (3004, "one two three " * 60, "b")]
    return rows


def passes(text):
    n, chars, symbols, dup, cover = measures(text)
    if n < 50 or 100 * cover > 50 * n:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stop = sum(w.lower() in quality_rules.STOP_WORDS for w in WORD.findall(text))
    return 2.5 <= chars / n <= 12 and symbols / n <= 0.1 and text.count("!") / n <= 0.1 and stop / n >= 0.05 and dup / len(lines) <= 0.5


def without_secrets(net, text):
    found = [(int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in base(text)]
    for a, b in plain_candidates(text, [x[:2] for x in found]):
        if plain_score(net, text, a, b) >= net.thresholds[b - a > secret_scans.BODY]:
            found.append((a, b, "cnn"))
    out, last = "", 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= last:
            out, last = out + text[last:a] + f"[{kind}]", b
    return out + text[last:]


def mixed(rows):
    """Rows as often as the mix takes them: sources are capped one after the other until none is above."""
    size = {id(r): len(WORD.findall(r[1])) for r in rows}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[id(r)] for r in rows if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in sources if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
    out = []
    for s in sources:
        whole = int(target[s] // total[s])
        need = math.floor(target[s] - whole * total[s] + 0.5)
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{mixing.SEED}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:15]):
            more = min(need, size[id(r)])
            need -= more
            out += [r] * math.floor((whole * size[id(r)] + more) / size[id(r)] + 0.5)
    return out


def write(spark, rows, folder):
    full = [(i, t, "en", s, None if t is None else len(t), 7, "x", "y") for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, ids int, _in_0 string, label string").repartition(3).write.parquet(f"{folder}/documents.parquet")


def test_pipeline_by_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = texts()
    write(spark, rows, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_in_0", "label", "ids"]
    got = out.collect()
    good = sorted((r for r in rows if r[1] and passes(r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    reached = brute_join([(k, r[1]) for k, r in enumerate(good)])
    single = [r for k, r in enumerate(good) if reached[k][1] == k]
    net = secret_scans.train()
    clean = [(i, without_secrets(net, t), s) for i, t, s in single]
    want = mixed(clean)
    assert 60 < len(single) < len(good) < len(rows) and sum("[" in t for _, t, _ in clean) >= 8
    own = pieces.Processor(pieces.Model.load(tokenizer("piece_bpe_32k.model")))
    assert Counter((r.doc_id, r.source, own.decode(r.ids)) for r in got) == Counter((i, s, t) for i, t, s in want)
    assert all(r.n_chars == len(own.decode(r.ids)) for r in got)
    for r in got[:25]:
        marked = (" " + own.decode(r.ids)).replace(" ", pieces.MARKER)
        single_pieces = {p for p, k in zip(own.pieces, own.kinds) if k in (pieces.NORMAL, pieces.USER)}
        assert sum(own.scores[i] for i in r.ids if own.kinds[i] != pieces.BYTE) + sum(c not in single_pieces for c in marked) * own.unknown_score == pytest.approx(brute(own, marked))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    write(spark, [], tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    write(spark, texts(), tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert [re.sub(r"\W", "", name) for name, _ in corpus_pipeline.STAGES] == ["qualityrules", "ngramJaccardjoin", "secretscans", "mixingsourcestotargetweights", "SentencePieceencodinganddecoding"]
