"""Token alignment against loops over bytes with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from forecourt.llm.op12 import tokenizer_files
from forecourt.llm.token_alignment import SPACE, AlignmentRules, ByteLevelTokenizer, PieceTokenizer, align_tokens

WORDS = "the of alpha beta naïve straße 数据 данные tokenisation 1234 http://x.y é don't €5 🙂 .. -- <|endoftext|> <s> </s> <0x41>".split()


def texts():
    rng = random.Random(2)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    out += [None, "", " ", "  two  spaces ", "\n\tline\r\n", f"a{SPACE}b", "ﬁ ½ Å", "x\x00y", "x" * 3000, "Ａ", out[3], out[3]]
    return [*enumerate(out), (3, out[3]), (None, out[4])]


def tokens(tokenizer, text):
    """(ids, bytes) of one text, none where the bytes are not a space and the text."""
    if not text:
        return [], []
    ids = tokenizer.encode([text])[0]
    spelled = [tokenizer.entries[i].as_py() for i in ids]
    return (ids, spelled) if b"".join(spelled) == f" {text}".encode() else (None, None)


def ranges(spelled):
    at, out = 0, []
    for s in spelled:
        out.append((at, at + len(s)))
        at += len(s)
    return out


def brute_force(rows, a, b):
    documents, holders = [], Counter()
    for doc_id, text in rows:
        (ids_a, bytes_a), (ids_b, bytes_b) = tokens(a, text), tokens(b, text)
        if ids_a is None or ids_b is None:
            ids_a, bytes_a, ids_b, bytes_b = [], [], [], []
        at_a, at_b = ranges(bytes_a), ranges(bytes_b)
        links = [(x, y) for x, p in zip(ids_a, at_a) for y, q in zip(ids_b, at_b) if p[0] < q[1] and q[0] < p[1]]
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, low = [], 0
        for end in ends:
            sides = [",".join(str(i) for i, (s, e) in zip(ids, at) if low <= s and e <= end) for ids, at in ((ids_a, at_a), (ids_b, at_b))]
            groups.append("|".join(sides))
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        documents.append((doc_id, len(ids_a), len(ids_b), len(groups), links, digest))
        holders.update(set(links))
    highest = defaultdict(int)
    for (x, _), n in holders.items():
        highest[x] = max(highest[x], n)
    return sorted(
        ((i, n, m, g, len(ls), sum(holders[x] == highest[x[0]] for x in ls), sum(holders[x] for x in ls), d) for i, n, m, g, ls, d in documents),
        key=str,
    )


@pytest.fixture(scope="module")
def files():
    return tokenizer_files()


@pytest.mark.parametrize("rules", [AlignmentRules(), AlignmentRules(encode_bytes=200, packet_bytes=700)])
def test_alignment_like_brute_force(spark, files, rules):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ("packet", "pairs", "n_a", "held", "count")))
    found = align_tokens(docs, *files, rules)
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(rows, ByteLevelTokenizer(files[0]), PieceTokenizer(files[1]))
    some = {r["doc_id"]: r for r in found.collect()}
    assert some[0]["n_links"] > some[0]["n_groups"] > 0
    assert tuple(some[30])[1:] == (0, 0, 0, 0, 0, 0, "") and some[35]["n_a"] == 0


def test_no_rows_and_only_empty_texts(spark, files):
    schema = "doc_id long, text string"
    assert align_tokens(spark.createDataFrame([], schema), *files).count() == 0
    rows = align_tokens(spark.createDataFrame([(1, None), (2, "")], schema), *files).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_special_tokens_are_plain_text(files):
    a, b = ByteLevelTokenizer(files[0]), PieceTokenizer(files[1])
    for text in ("<|endoftext|>", "<s>x</s>", "<unk>"):
        assert tokens(a, text)[0] and len(tokens(a, text)[0]) > 1 and len(tokens(b, text)[0]) > 1
