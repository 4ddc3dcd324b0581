import hashlib
import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from barloom.llm import alignment  # noqa: E402
from barloom.llm import queries as Q  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain_groups(texts):
    """Groups of tokens of each text, by the tokenizers themselves and a walk over both lists of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(BYTES)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = alignment._byte_of()
    out = []
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a = [(i, len(bytes(byte_of[c] for c in a_model.id_to_token(i)))) for i in a_model.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in b_model.encode(text or ""):
            piece = b_model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
        groups = []
        if text and b"".join(raw for _, raw in b) == spaced:
            b = [(i, len(raw)) for i, raw in b]
            left, right, at_a, at_b = [], [], 0, 0
            ends_b, at = set(), 0
            for _, n in b:
                at += n
                ends_b.add(at)
            queue = list(b)
            for i, n in a:
                left.append(i)
                at_a += n
                while queue and at_b + queue[0][1] <= at_a:
                    at_b += queue[0][1]
                    right.append(queue.pop(0)[0])
                if at_a in ends_b:
                    groups.append((left, right))
                    left, right = [], []
        out.append(groups)
    return out


def brute(rows):
    """Counts of every row, for ``(doc_id, text)`` rows."""
    found = plain_groups([text for _, text in rows])
    linked = [Counter((a, b) for left, right in groups for a in left for b in right) for groups in found]
    held = Counter(pair for pairs in linked for pair in pairs)
    high = {}
    for (a, _), n in held.items():
        high[a] = max(high.get(a, 0), n)
    out = []
    for (doc_id, _), groups, pairs in zip(rows, found, linked, strict=True):
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append(
            (
                doc_id,
                sum(len(left) for left, _ in groups),
                sum(len(right) for _, right in groups),
                len(groups),
                sum(pairs.values()),
                sum(m for p, m in pairs.items() if held[p] == high[p[0]]),
                sum(m * held[p] for p, m in pairs.items()),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return out


def order(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in Q.op13_alignment(spark, sf_dir).collect()]
    assert order(got) == order(brute(docs))


@pytest.mark.parametrize("block", [1, 1 << 22])
def test_odd_rows(spark, odd_docs, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "LISTED", 12)
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in alignment.link_profile(odd_docs, BYTES, PIECES).collect()]
    want = brute(docs)
    assert order(got) == order(want)
    assert sum(w[1] == 0 for w in want) == 3  # null, empty, and the mark of a space in the text


def test_empty_table(spark, odd_docs):
    assert alignment.link_profile(odd_docs.limit(0), BYTES, PIECES).count() == 0
    assert alignment.token_groups(odd_docs.limit(0), BYTES, PIECES).count() == 0


def test_parts_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    pool = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'re", "0", "12", "²", "ß", "…", "“", "漢", "😀", "\x1c", "\x85", "\xa0", "　", "<s>", "<0x0A>", "the", " the", "\r\n", "ǅ", "́", "\x00", "½", "\ufeff"]
    texts = [" " + "".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    aligner = alignment.Aligner(BYTES, PIECES)
    for text in texts:
        parts = alignment.slices(text, rng.randint(1, 20))
        assert "".join(parts) == text
        assert [i for p in parts for i in aligner.bytes.encode(p).tolist()] == aligner.bytes.whole(text)
        assert [i for p in parts for i in aligner.pieces.encode(p).tolist()] == aligner.pieces.model.encode(text[1:])


@pytest.mark.parametrize("unit", [" ", "\n", "x", "é", "x y", "漢"])
def test_very_long_runs(unit):
    aligner = alignment.Aligner(BYTES, PIECES)
    x = aligner.align(["a" + unit * 1_000_000 + "b", "short one"])
    assert int(x.byte_bounds[1]) == 3 + len(unit.encode()) * 1_000_000
    keys, times = alignment.linked_pairs(x, aligner.n_a, aligner.n_b)
    assert int(times.sum()) == int((x.counts()[0] * x.counts()[1]).sum())
    assert x.cuts[-1] == x.byte_bounds[-1]


def test_ranks_of_bitsets():
    rng = random.Random(2)
    import numpy as np

    for size in (0, 1, 63, 64, 65, 1000):
        places = np.array(sorted(rng.sample(range(size + 1), rng.randint(0, size))), np.int64)
        bits = alignment.Bits.of(places, size)
        assert bits.places().tolist() == places.tolist()
        at = np.arange(size + 1)
        assert bits.rank(at).tolist() == [int((places < i).sum()) for i in at.tolist()]


def test_groups_cover_their_bytes(spark, odd_docs):
    aligner = alignment.Aligner(BYTES, PIECES)
    for r, s in zip(alignment.token_groups(odd_docs, BYTES, PIECES).collect(), odd_docs.collect(), strict=True):
        raw = (" " + (s.text or "")).encode()
        for g in r.groups:
            piece = raw[g.byte_start : g.byte_end]
            assert b"".join(aligner.bytes.raw[i] for i in r.a_ids[g.a_start : g.a_end]) == piece
            assert b"".join(aligner.pieces.raw[i] for i in r.b_ids[g.b_start : g.b_end]) == piece
        assert not r.groups or r.groups[-1].byte_end == len(raw)
