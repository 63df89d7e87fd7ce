"""Byte-level BPE, the Merkle manifest and hard negatives against plain Python, and on edge cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from docgraph.llm import byte_bpe, hard_negatives, manifest

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return byte_bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def plain_merges(piece, ranks):
    """One leftmost pair of the least rank after the other."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        least, k = min((ranks.get(parts[k] + parts[k + 1], math.inf), k) for k in range(len(parts) - 1))
        if least == math.inf:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_pieces_merge_as_by_hand(vocabulary):
    rng = random.Random(1)
    alphabets = [b"ab", b"etaoinshr", b"=-_*", bytes(range(256)), b" \n\t", "äöß中文".encode()]
    pieces = [bytes(rng.choice(a) for _ in range(rng.randrange(1, 70))) for a in alphabets for _ in range(40)]
    pieces += [bytes(rng.choice(a) for _ in range(900)) for a in alphabets] + [b"a" * 2000, b"", b"ab" * 700]
    assert vocabulary.encode_pieces(pieces) == [packed(plain_merges(p, vocabulary.ids)) if p else b"" for p in pieces]


def test_texts_encode_as_by_the_library(vocabulary, library):
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(32, 127)])) for _ in range(300)) for _ in range(200)]
    texts += ["", " ", "don't I'LL we've'S  \n\n x", "<|endoftext|>", "\x00\x1c\x85  x", "word " * 100_000, "z" * 100_000, "=" * 5000]
    got = vocabulary.encode(texts, regex.compile(public_tokenizers.PATTERN), {})
    assert got == [packed(library.encode_ordinary(t)) for t in texts]
    assert [vocabulary.decode(g).decode() for g in got] == texts


def test_memory_of_pieces_may_overflow(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 10)
    texts = [" ".join(f"piece{i}x{k}" for i in range(k)) for k in range(30)] * 2
    kept, pattern = {}, regex.compile(public_tokenizers.PATTERN)
    assert [vocabulary.encode([t], pattern, kept)[0] for t in texts] == [packed(library.encode_ordinary(t)) for t in texts]


def test_a_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(b"YQ== 0\nYg== 1\n")


def test_documents_round_trip(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = byte_bpe.token_digest(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_tokens_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 1), (2, "", None, None, 0), (2, "", None, None, 0), (3, "w " * 200_000, "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = {(r.doc_id, r.n_tokens) for r in byte_bpe.token_digest(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {(1, 0), (None, 2), (2, 0), (3, 200_001)}
    assert byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).count() == 5
    assert byte_bpe.token_digest(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert bytes(byte_bpe.decode(byte_bpe.encode(broken, PATH, public_tokenizers.PATTERN), PATH).first().decoded) == "a�b".encode()


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return joined(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(hashes):
    found = [hashes]
    while len(found[-1]) > 1:
        found.append([joined(*found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


def siblings(tree, place):
    found = []
    for level in tree[:-1]:
        run = level[place // 3 * 3 : place // 3 * 3 + 3]
        found.append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
        place //= 3
    return found


def plain_audit(rows):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels([leaf(*r) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in sources]) if rows else []
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, text, *rest) in enumerate(by_source[s]):
            path, own = siblings(trees[s], i) + siblings(top, k), text
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                own = text.replace("\n", "")
            folded = leaf(doc_id, own, *rest)
            for left, right in path:
                folded = joined(left, folded, right)
            proof = joined(*[left + right for left, right in path])
            out.append((doc_id, leaf(doc_id, text, *rest), trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def same_rows(got, expected):
    return sorted(map(str, got)) == sorted(map(str, expected))


def audited(df):
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return [tuple(r[c] for c in columns) for r in manifest.audit_tampered(df).collect()]


@pytest.mark.parametrize("block", [manifest.BLOCK, 9])
def test_manifest(spark, monkeypatch, block):
    monkeypatch.setattr(manifest, "BLOCK", block)
    monkeypatch.setattr(manifest, "DEPTH", round(math.log(block, 3)))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = audited(docs)
    assert same_rows(got, plain_audit([tuple(r) for r in docs.collect()]))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    rows = [(None, "x\ny", "en", "a", 3)] * 3 + [(None, "z", "en", "a", 3), (7, None, None, "a", None), (7, None, None, "a", None), (7, "q\n", None, "a", None)]
    rows += [(i, f"{i}\n{i}", "é", None, i) for i in (-1, -64, -65, 63, 64, 2**62, 2**63 - 1, -(2**63))] + [(5, "", "", "", 0), (9, "lone\n", "", "é", 1)]
    rows += [(i % 5, f"t{i % 7}", None, "ties", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = docs.select("*", *[F.lit("clash").alias(c) for c in ("of", "idx", "own", "leaf", "path", "root", "word", "bit", "total", "hash")])
    assert same_rows(audited(clashing), plain_audit(rows))
    assert audited(docs.where("false")) == []
    for some in (rows[-61:-60], rows[6:7] + rows[-61:-60] + rows[-62:-61]):
        assert same_rows(audited(spark.createDataFrame(some, DOCS)), plain_audit(some))


def plain_negatives(rows):
    own = {}
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        key, row = i if i is not None else object(), (i, label, [math.floor(256 * x) for x in vector])
        own[key] = min(own.get(key, row), row, key=lambda r: r[1:])
    out, order = [], lambda t: (-t[0], t[1] is None, t[1] or 0)
    for i, label, vector in own.values():
        if i is None or i % 100:
            continue
        scored = sorted([(sum(a * b for a, b in zip(vector, v)), j, m) for j, m, v in own.values() if j is None or j != i], key=order)
        for best, j, _ in [t for t in scored if t[2] == label][:5]:
            near = [t for t in scored if t[2] != label and 30 * best <= 100 * t[0] <= 90 * best][:10]
            out += [(i, j, k + 1, t[1], best, t[0]) for k, t in enumerate(near)]
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(df):
    columns = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return [tuple(r[c] for c in columns) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()]


def test_hard_negatives(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    got = mined(df)
    assert got and same_rows(got, plain_negatives([tuple(r) for r in df.collect()]))


def test_hard_negatives_of_odd_rows(spark):
    rng = random.Random(3)
    vector = lambda n: [rng.choice([0.0, 0.1, -0.2, 0.5, 1.0]) for _ in range(n)]
    rows = [(i, vector(rng.choice([8, 8, 5, 0])), rng.choice([0, 1, 2, None])) for i in [*range(400)] + [None] * 20]
    rows += [(500, None, 1), (600, [1.0, None], 1), (601, [math.nan], 1), (602, [math.inf], 0), (700, [-1.0], 1)] + rows[:50]
    df = spark.createDataFrame(rows, VECTORS)
    clashing = df.select("*", *[F.lit("clash").alias(c) for c in ("vector", "code", "part", "chunk", "score", "rank", "positives")])
    got = mined(clashing)
    assert got and same_rows(got, plain_negatives(rows))
    assert mined(df.where("false")) == [] and mined(df.where("vec_id = 100")) == [] and mined(df.where("vec_id % 100 <> 0")) == []
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [1e9, 1.0], 1)], VECTORS))


def test_intervals_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    rows = rng.integers(-300, 300, (2000, 50))
    rows[7] = 0
    turn = hard_negatives.rotation(50)
    assert np.allclose(turn.T @ turn, np.eye(50))
    low, high = hard_negatives.Queries(rows[:40], turn).bounds(*hard_negatives.encode_rows(rows, turn))
    exact = rows[:40] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    tenth = hard_negatives._nth_largest(low, 10)
    assert (high >= tenth[:, None]).mean() < 0.5
