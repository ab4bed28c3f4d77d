import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from helpers import SF, odd, texts_of
from tidemark.llm import pieces, token_links
from tokenizers import Tokenizer

FILES = [pieces.model_bytes(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def sides():
    return token_links.Sides(*FILES)


def plain(text, a, b):
    """Ids, overlapping pairs of places, and groups, by the libraries alone and one text at a time."""
    shown = {c: x for x, c in {**{i: chr(i) for r in ((33, 127), (161, 173), (174, 256)) for i in range(*r)}}.items()}
    rest = [x for x in range(256) if x not in shown.values()]
    shown |= {chr(256 + k): x for k, x in enumerate(rest)}
    none = [], [], set(), ""
    if not text:
        return none
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])]
    raw_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids[0]]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return none
    at, cut = [], []
    for raw in (raw_a, raw_b):
        ends = [0]
        for x in raw:
            ends.append(ends[-1] + len(x))
        at.append(list(zip(ends, ends[1:])))
        cut.append(set(ends))
    pairs, j = set(), 0
    for i, (lo, hi) in enumerate(at[0]):
        while at[1][j][1] <= lo:
            j += 1
        k = j
        while k < len(at[1]) and at[1][k][0] < hi:
            pairs.add((i, k))
            k += 1
    groups, seen = [], [0, 0]
    for end in sorted((cut[0] & cut[1]) - {0}):
        own = []
        for s in (0, 1):
            first = seen[s]
            while seen[s] < len(at[s]) and at[s][seen[s]][1] <= end:
                seen[s] += 1
            own.append(",".join(map(str, ids[s][first:seen[s]])))
        groups.append("|".join(own))
    return *ids, pairs, ";".join(groups)


def brute(texts):
    a = Tokenizer.from_str(FILES[0].decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=FILES[1])
    found = [plain(t, a, b) for t in texts]
    linked = [Counter((x[0][i], x[1][j]) for i, j in x[2]) for x in found]
    docs = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    return [(len(x[0]), len(x[1]), x[3].count("|"), len(x[2]), sum(n for p, n in c.items() if docs[p] == most[p[0]]),
             sum(n * docs[p] for p, n in c.items()), hashlib.sha256(x[3].encode()).hexdigest() if x[3] else "")
            for x, c in zip(found, linked)]


ODD_TEXTS = ["", None, " ", "a", "  two  spaces ", "▁ is the mark", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x01\x7f", "é漢😀👩‍👩‍👧 ſ", "tab\tnew\n\nline\r",
             "don't we'll 123456 ١٢٣", "﻿bom", "x" * 5000, " " * 3000, "é  nbsp", "".join(map(chr, range(300))), "same", "same"]


@pytest.mark.parametrize("most", [token_links.PAIRS, 40])
def test_brute_force(spark, most):
    """All columns; with one slice of the counts, and with many."""
    rand = random.Random(3)
    words = "the of and dogs unbelievable Straße naïve 漢字 2024 :-) don't  \n ÅÅ".split(" ")
    texts = ODD_TEXTS + [" ".join(rand.choice(words) for _ in range(rand.randrange(1, 60))) for _ in range(80 if most > 40 else 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in token_links.digests(docs, *FILES, most=most).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_given_texts(spark):
    texts = texts_of(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in token_links.digests(docs, *FILES).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    ids = sorted(texts)
    assert [got[i] for i in ids] == brute([texts[i] for i in ids])


def test_long_texts_are_cut_where_nothing_joins(sides, monkeypatch):
    assert sides.fast is not None and sides.b_cut
    rand = random.Random(5)
    text = "".join(rand.choice(["word", " word", "  ", " ", "A b", "\n", "é ", "don't", " 12 "]) for _ in range(4000))
    whole = sides.encode([text, text + " tail"])
    monkeypatch.setattr(token_links.stretches, "__defaults__", (50,))
    assert len(token_links.stretches(text)) > 20
    for one, other in zip(whole, sides.encode([text, text + " tail"])):
        assert one[0].tolist() == other[0].tolist() and one[1].tolist() == other[1].tolist()
    a = Tokenizer.from_str(FILES[0].decode())
    assert whole[0][0].tolist() == a.encode(" " + text, add_special_tokens=False).ids


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "unbelievable dogs"), (2, None)], "doc_id long, text string")
    one, none = sorted(token_links.align(docs, *FILES).collect(), key=lambda r: r.doc_id)
    assert one.a_ends[-1] == len(one.a_ids) and one.b_ends[-1] == len(one.b_ids) and len(one.a_ends) == len(one.b_ends)
    assert sum(one.times) >= max(len(one.a_ids), len(one.b_ids))
    assert none.a_ids == none.b_ids == none.pairs == none.a_ends == []


def test_odd_rows(spark):
    docs = odd(spark, "pairs string, times int, _row int, n_a double, a long")
    got = token_links.digests(docs, *FILES, keep=("doc_id", "score") if "score" in docs.columns else ("doc_id",)).collect()
    assert len(got) == docs.count()
    assert [r.n_a for r in got if r.doc_id in (2, 3)] == [0, 0] and all(r.groups_sha256 == "" for r in got if r.doc_id in (2, 3))
    assert max(r.n_a for r in got if r.doc_id == 5) > 20_000
    assert token_links.digests(docs.limit(0), *FILES).count() == 0
