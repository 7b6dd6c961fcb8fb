"""The source audit against plain Python integers, and its trees against sums over all terms."""

import os
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import source_audit
from forecourt.llm.op11 import SQL, op11_source_audit
from forecourt.llm.segment_trees import Forest, shares
from forecourt.llm.source_audit import AuditRules, source_divergence
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=3, top=200):
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(SMALL))
        groups[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang, held in documents.items():
        kept = [t for t, n in held.items() if n >= least]

        def parts(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        mine = {s: n for (one, s), n in groups.items() if one == lang}
        p = {s: parts(n) for s, n in mine.items()}
        q = parts(sum(mine.values(), Counter()))
        listed = defaultdict(list)
        for a, b in permutations(mine, 2):
            listed[a, "pair"].append((b, sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept)))
        for s, n in mine.items():
            listed[s, "term"] = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[t] and p[s][t] > q[t]]
        for (s, part), items in listed.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def cases():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Émile", "ÉMILE", "don't", "x1y", "K", "k", "ſ"]
    rows = []
    for i in range(120):
        source = None if i % 11 == 0 else f"s{min(i % 9, 5)}"
        text = " ".join(rng.choice(words, rng.integers(1, 80)))
        rows.append((text.upper() if i % 7 == 0 else text, "en" if i % 3 else "de", source))
    rows += [(None, "en", "empty"), ("", "fr", "a"), ("1 2 3", "fr", "b"), ("only here", "it", "x"), ("only here", None, None)]
    return [*rows, rows[4], rows[4], rows[5]]


def table_of(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return docs.select("*", *(F.lit(1).alias(c) for c in ("n", "term", "docs", "block", "total", "rank", "kept")))


@pytest.mark.parametrize("rules", [AuditRules(), AuditRules(top_terms=3, block_terms=16, tile_sources=2)])
def test_audit_like_brute_force(spark, rules):
    rows = cases()
    found = source_divergence(table_of(spark, rows), rules)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, top=rules.top_terms)
    assert found.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"


def test_handing_counts_on_early_changes_nothing(spark, monkeypatch):
    rows = cases()
    monkeypatch.setattr(source_audit, "HELD_TERMS", 20)
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 7)
    assert sorted(map(tuple, source_divergence(table_of(spark, rows)).collect())) == brute_force(rows)


def test_empty_table_and_groups_without_terms(spark):
    docs = table_of(spark, cases())
    assert source_divergence(docs.limit(0)).count() == 0
    bare = source_divergence(spark.createDataFrame([(None, "en", "a"), ("1", "en", "b")], docs.select("text", "lang", "source").schema))
    assert sorted(map(tuple, bare.collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_trees_share_equal_subtrees_and_price_like_sums():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.3, (6, 100)) * rng.integers(1, 1000, (6, 100))
    counts[3] = counts[1]
    forest = Forest(counts)
    assert forest.roots[3] == forest.roots[1] and len(set(forest.roots)) == 5
    assert all(len(set(zip(a, b))) == len(a) for a, b in zip(forest.left, forest.right))
    for a in range(6):
        for b in range(6):
            n, m = int(counts[a].sum()), int(counts[b].sum()) + 7
            p = [1 + 10**9 * (int(c) + 1) // (n + 100) for c in counts[a]]
            q = [1 + 10**9 * (int(c) + 1) // (m + 100) for c in counts[b]]
            want = sum((x - y) ** 2 // y for x, y in zip(p, q)), sum((x - y) ** 2 // x for x, y in zip(p, q))
            assert forest.price(forest.roots[a], forest.roots[b], n, m, 100) == want


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**9, 3 * 10**13, 89 * 10**12])
    total = 9 * 10**13
    assert shares(counts, total, 5).tolist() == [1 + 10**9 * (c + 1) // (total + 5) for c in counts.tolist()]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_query_equals_sql(spark):
    assert difference(spark, connect(SF_DIR), op11_source_audit, SQL, SF_DIR) is None
