import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment as A
from tidemark.llm.token_counts import byte_symbols, vocabulary_path

VOCABULARY, MODEL = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
PARTS = [*" \n\té'中文😀.,12", "<|endoftext|>", "</s>", "<0x41>", "the ", "token", "izer ", "  ", "▁", "ﬁ", "​", "Straße ", "word. "]


def tokens_by_hand(texts):
    level, pieces = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    level.encode_special_tokens = True
    back = {c: b for b, c in byte_symbols().items()}
    out = []
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a = [(i, bytes(back[c] for c in level.id_to_token(i))) for i in level.encode(spaced.decode(), add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text or ""):
            name = pieces.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode()))
        same = text and b"".join(t for _, t in a) == spaced == b"".join(t for _, t in b)
        out.append((a, b) if same else ([], []))
    return out


def by_hand(texts):
    found = []
    for a, b in tokens_by_hand(texts):
        ends_a, ends_b = np.cumsum([len(t) for _, t in a]).tolist(), np.cumsum([len(t) for _, t in b]).tolist()
        links = [(a[i][0], b[j][0]) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y]
        groups, i, j = [], 0, 0
        for end in [e for e in ends_a if e in ends_b]:
            left, right = [], []
            while i < len(a) and ends_a[i] <= end:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and ends_b[j] <= end:
                right.append(str(b[j][0]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        found.append((len(a), len(b), groups, links))
    counts = Counter(x for *_, links in found for x in links)
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (n_a, n_b, len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "", sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
        for n_a, n_b, groups, links in found
    ]


def aligned(spark, docs):
    return A.scored(A.align(docs, VOCABULARY, MODEL), VOCABULARY, MODEL)


def test_alignment_by_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 30))) for _ in range(300)]
    texts += [None, "", " ", "a", "the token", "the token", "Hello wörld. " * 40, "x" * 3_000, "two  blanks", "\x00"]
    rows = [(i if i % 50 else None, t, "k", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_a int")
    got = aligned(spark, docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    want = sorted(((r[0], *w) for r, w in zip(rows, by_hand(texts))), key=str)
    assert sorted((tuple(r[c] for c in ["doc_id", *NAMES]) for r in got.collect()), key=str) == want
    # some texts are kept by both tokenizers, some are not
    kept = [w[1] > 0 for w in want]
    assert any(kept) and not all(kept)
    assert aligned(spark, docs.limit(0)).count() == 0


def test_slices_and_bound(spark, monkeypatch):
    texts = [f"a line of text number {i}. " * (1 + 40 * (i == 7)) for i in range(20)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    whole = sorted(map(tuple, aligned(spark, docs).collect()))
    monkeypatch.setattr(A, "SLICE_BYTES", 64)
    assert sorted(map(tuple, aligned(spark, docs).collect())) == whole
    # a linked pair is an end of one another, so there are no more than the bytes of both vocabularies
    pairs = A.link_counts(A.align(docs, VOCABULARY, MODEL)).collect()
    a, b = A.byte_entries(VOCABULARY), A.byte_pieces(MODEL)
    assert all(a[r["a"]].endswith(b[r["b"]]) or b[r["b"]].endswith(a[r["a"]]) for r in pairs)
    assert len(pairs) < A.most_pairs(VOCABULARY, MODEL) < 1_500_000
