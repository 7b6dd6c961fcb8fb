"""The operators on training data against brute force, SQL and public libraries, on small tables."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forecourt.llm import chat_format, components, jaccard_join, lattice_dedup, pii
from forecourt.llm.byte_bpe import Encoder, Vocabulary, encode_and_decode, encode_texts
from forecourt.llm.decontamination import DecontaminationRules, find_leaks
from forecourt.llm.e8 import nearest_points
from forecourt.llm.language_id import held_out, predict_languages, train_language_model
from forecourt.llm.line_dedup import dedup_lines
from forecourt.llm.op9 import vocabulary
from forecourt.llm.queries import QUERIES, SQL
from forecourt.llm.substring_dedup import dedup_substrings
from forecourt.llm.url_filter import judge_urls, url_rules
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def some_text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows(rng):
    """Nulls, empty and long texts, copies, near copies, repeated rows and a null id."""
    base = [some_text(rng, n) for n in (3, 10, 60, 200, 3000)]
    near = base[3].split()
    near[100] = "other"
    rows = list(enumerate([*base, base[2], base[3], " ".join(near), "head " + base[2] + " tail", None, "", " \t\n "]))
    return [*rows, rows[2], (None, base[1])]


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n_words", F.lit("x")).withColumn("writer", F.lit(1)).withColumn("class", F.lit(2)).withColumn("matches", F.lit(3))


@pytest.fixture(scope="module")
def rows():
    return awkward_rows(random.Random(4))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table_of(spark, rows)


def as_list(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_substrings_like_brute_force(spark, docs, rows):
    n = 35
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + n]) for _, w in texts for k in range(len(w) - n + 1))
    want = []
    for i, w in texts:
        gone = [any(seen[tuple(w[k : k + n])] > 1 for k in range(max(0, j - n + 1), min(j, len(w) - n) + 1)) for j in range(len(w))]
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    assert as_list(dedup_substrings(docs, n).collect()) == as_list(want)
    assert dedup_substrings(docs.limit(0)).count() == 0


def test_window_that_repeats_inside_one_text(spark):
    words = [f"w{i}" for i in range(40)]
    one = spark.createDataFrame([(1, " ".join([*words, *words]))], "doc_id long, text string")
    assert dedup_substrings(one).first()["n_removed"] == 80


def brute_groups(rows, n=4, num=85, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    roots = components.Roots()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                roots.join(i, j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = roots.root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, len(sets[i]), None if d is None else least[roots.root(i)]) for i, (d, _) in enumerate(rows)]


def test_jaccard_like_brute_force(spark, docs, rows):
    assert as_list(jaccard_join.ngram_jaccard_groups(docs).collect()) == as_list(brute_groups(rows))
    assert jaccard_join.ngram_jaccard_groups(docs.limit(0)).count() == 0


def test_jaccard_near_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for base in range(6):
        words = some_text(rng, 20 + 15 * base).split()
        for copy in range(12):
            mine = list(words)
            for _ in range(rng.randrange(4)):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(9)}"
            rows.append((100 * base + copy, " ".join(mine)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_list(jaccard_join.ngram_jaccard_groups(df).collect()) == as_list(brute_groups(rows))


def test_pipeline_keeps_one_of_five_word_copies(spark):
    rng = random.Random(12)
    rows = []
    for base in range(12):
        words = some_text(rng, 24 + 3 * base).split()
        cut = (len(words) - 4) // 5 + base % 2
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(words[:-cut]))]
    kept = {d for d, _, least in brute_groups(rows, 5, 80, 100) if d == least}
    assert kept != {d for d, _, least in brute_groups(rows) if d == least}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, df, "").collect()} == kept


def test_segments_outnumber_differences():
    bands = jaccard_join.Bands(85, 100)
    bands.grow(50_000)
    for band, high in enumerate(bands.high[:60]):
        segments, spare = bands.segments(band)
        assert segments - spare > 2 * high * 15 / 185
    assert all(a + 1 == b for a, b in zip(bands.high, bands.low[1:]))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_two_levels_name_connected_nodes(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 9), (5, 6)], "a long, b long")
    found = {r.node: r.component for r in components.two_levels(links).collect()}
    assert found == {2: 1, 3: 1, 4: 2, 9: 1, 6: 5}
    assert components.two_levels(links.limit(0)).collect() == []


def test_lines(spark):
    block = "\n".join(f"line {i}" for i in range(40))
    rows = [(1, "start\n" + block), (2, "other\nbegin\n" + block), (3, None), (4, ""), (5, "a\nb"), (5, "a\nb"), (None, "solo")]
    out = dedup_lines(table_of(spark, rows)).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by_id[1].n_removed == 0 and by_id[2].n_removed > 20
    assert by_id[2].n_lines == 42 and len(by_id[2].text.split("\n")) == 42 - by_id[2].n_removed
    assert by_id[3].text is None and by_id[3].n_lines == 0 and by_id[4].text == "" and by_id[4].n_lines == 1
    assert [r.text for r in out if r.doc_id == 5] == ["a\nb"] * 2
    assert dedup_lines(table_of(spark, rows).limit(0)).count() == 0
    plan = dedup_lines(table_of(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_short_runs_between_unlike_lines(spark):
    rng = random.Random(11)
    runs = [[some_text(rng, 60 // n + 1) for _ in range(n)] for n in range(2, 9) for _ in range(6)]
    own = lambda: [some_text(rng, 9) for _ in range(rng.randrange(1, 4))]
    rows, left = [], {}
    for i, run in enumerate(runs):
        for copy in range(3):
            before, after = own(), own()
            rows.append((1000 * copy + i, "\n".join([*before, *run, *after])))
            left[1000 * copy + i] = rows[-1][1] if copy == 0 else "\n".join([*before, *after])
    rows += [(9000, "a\n\n\nb"), (9001, "c\n\n\nd"), (9002, "same line\nx"), (9003, "same line\ny")]
    out = dedup_lines(table_of(spark, rows)).collect()
    assert {r.doc_id: r.text for r in out} == left | dict(rows[-4:])
    assert all(r.n_removed == len(runs[r.doc_id % 1000]) for r in out if 1000 <= r.doc_id < 9000)


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, some_text(rng, 30), None if i else "right answer") for i in range(12)] + [(50, None, None), (51, "", None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string, answer string")
    swapped = items[3][1].split()
    swapped[4], swapped[20] = "changed", "also"
    rows = [(1, some_text(rng, 90) + " " + items[1][1].upper() + " " + some_text(rng, 50)), (2, " ".join(swapped)), (3, some_text(rng, 400)), (4, None), (5, "")]
    rows += [(6, items[0][1]), (7, items[0][1] + " the right answer"), (1, rows[0][1])]
    out = find_leaks(table_of(spark, rows), benchmark).collect()
    found = sorted((r.doc_id, m.item_id) for r in out for m in r.matches)
    assert found == [(1, 1), (1, 1), (2, 3), (7, 0)] and len(out) == len(rows)
    assert find_leaks(table_of(spark, rows), benchmark.limit(0)).filter(F.size("matches") > 0).count() == 0


def test_leaks_of_every_length_from_many_items(spark):
    rng = random.Random(6)
    common = [f"w{int(rng.paretovariate(0.6))}" for _ in range(20_000)]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    items = [(i, prose(4 + i % 67)) for i in range(600)]
    rows, planted = [], set()
    for doc, (item, text) in enumerate(items[::6]):
        words = text.split()
        if len(words) > 16 and doc % 2:  # a word replaced, one left out, one put in
            words[5], words[9] = "other", "put in"
            del words[13]
        rows.append((doc, f"{prose(rng.randrange(60, 150))} {' '.join(words)} {prose(rng.randrange(60, 150))}"))
        planted.add((doc, item))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), DecontaminationRules(rank=8)).collect()
    assert planted <= {(r.doc_id, m.item_id) for r in out for m in r.matches}


def test_urls(spark):
    urls = ["http://A.b.NET/x", "http://net/", "http://xnet/", "http://a.net", "http://q.example.net/en/1?x=http://a", "nothing", None, "ftp://c.example.com/de/", "http://c.example.com/de", "://", "http://q.example.net/en/1?x=http://a"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    rules = url_rules(spark, [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block")])
    out = {r.page_id: (r.host, r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    assert out[0] == ("a.b.net", "net/", "block") and out[1][1] == "net/" and out[2][1] is None and out[3][1] is None
    assert out[4] == out[10] == ("q.example.net", "example.net/en/", "allow") and out[5] == ("", None, "allow") == out[6]
    assert out[7][2] == "block" and out[8][2] == "allow" and out[9] == ("", None, "allow") and len(out) == len(urls)


def test_chat_events():
    m = chat_format.Messages()
    for event in [("message", "user", "hi", None), ("delta", "assistant", "a", None), ("delta", "assistant", "b", None), ("edit", "user", "ho", 0), ("edit", "user", "x", 9), ("regenerate", "assistant", "c", None), ("odd", "user", "z", None)]:
        m.fold(*event)
    assert m.turns == [["user", "ho"], ["assistant", "c"]]


def test_chat_round_trip():
    rng = random.Random(3)
    for _ in range(300):
        m = chat_format.Messages()
        m.turns = [[rng.choice(["user", "assistant", "a\nb", ""]), "".join(rng.choice(["<|", "|>", "\\", "n", "\n", "<|im_end|>\n", "é", "<"]) for _ in range(8))] for _ in range(4)]
        text, spans = m.render()
        assert chat_format.read_turns(text) == [tuple(t) for t in m.turns]
        assert "".join(chat_format.unescape(text[s:e]) for s, e in spans) == "".join(t for r, t in m.turns if r == "assistant")


def test_bpe_like_the_library(spark, docs, rows):
    import tiktoken

    ranks, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x250), 10, 32, 0x4E2D, 0x1F600])) for _ in range(40)) for _ in range(300)]
    texts += ["", " " * 700, "a" * 2000, "ab" * 900, "<|endoftext|>", "I'm  you'll\n\n x", *("x" * n for n in range(505, 520))]
    ids, n = Encoder(Vocabulary(ranks), pattern).encode(texts)
    ends = np.cumsum(n)
    for text, end, k in zip(texts, ends, n):
        assert ids[end - k : end].tolist() == library.encode_ordinary(text)
    out = encode_and_decode(docs, ranks, pattern).collect()
    assert Counter(bytes(r.decoded) for r in out) == Counter((t or "").encode() for _, t in rows)
    assert all(len(r.ids) == 4 * r.n_tokens for r in out) and encode_texts(docs.limit(0), ranks, pattern).count() == 0


def brute_spans(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        odd, even = [int(d) for d in digits[-1::-2]], [2 * int(d) for d in digits[-2::-2]]
        if 14 <= len(digits) <= 19 and (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_like_the_patterns():
    rng = random.Random(0)
    texts = ["".join(rng.choice("a1.@+-2 ()5%0_é") for _ in range(rng.randrange(120))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "+1 (499) 555-6503", "x@y.z.", "1.1.1.1.1.1.1.1", "", "@" * 500, "300.1.1.1"]
    for text in texts:
        assert pii.base_spans(text) == brute_spans(text)


def test_pii_field(spark, rows):
    rng = random.Random(1)
    texts = [f"{some_text(rng, 5)} +1 (49{i % 10}) 555-65{i:02d} word 4111 1111 1111 1111 m{i}@mail.com 10.0.0.{i}" for i in range(60)]
    docs = table_of(spark, [*enumerate(texts), (None, None), (None, "")])
    model = pii.train_pii_model(docs)
    out = pii.detect_pii(docs, model).collect()
    assert len(out) == 62 and all(r.spans.startswith(r.base_spans[:5]) for r in out)
    for base, spans in pii.find_pii(texts, model):
        assert set(base) <= set(spans)
    # A part of a number that repeats elsewhere takes its label over the skip edge.
    text = "+1 (499) 555-6503 and many words in between and then 555-6503 again"
    (base, spans), = pii.find_pii([text], model)
    assert [text[s:e] for s, e, _ in set(spans) - set(base)] == ["555-6503"]
    empty = pii.train_pii_model(docs.limit(0))
    assert pii.find_pii(["3 and 4"], empty) == [([], [])]


def test_language(spark):
    rng = random.Random(6)
    kinds = {"x": "bal dor min tup".split(), "y": "kesh vrol zint quaf".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i, k in enumerate("xy" * 100)]
    docs = held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = train_language_model(docs.filter(~F.col("held_out")))
    odd = spark.createDataFrame([(900, None, "x"), (901, "", "x"), (902, "123 --", None), (903, "é", None)], "doc_id long, text string, lang string")
    out = predict_languages(docs.drop("held_out").union(odd), model, ("doc_id", "lang")).collect()
    assert all(r.lang_pred == r.lang for r in out if r.doc_id < 900) and all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in sorted(out, key=lambda r: r.doc_id)[-4:-1]] == ["und"] * 3
    assert next(r for r in out if r.doc_id == 903).lang_pred in ("x", "y")
    nothing = train_language_model(docs.limit(0))
    assert {r.lang_pred for r in predict_languages(docs, nothing).collect()} == {"und"}


def test_lattice_points_are_nearest():
    points = np.random.default_rng(0).normal(size=(200, 8))
    near, far = nearest_points(points)
    whole = near / 2
    assert ((whole.sum(axis=2) % 2) == 0).all() and (np.diff(far, axis=1) >= 0).all()
    assert (far[:, 0] <= 1 + 1e-9).all()  # the lattice's covering radius is 1


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    vectors = [base[i % 20] + rng.normal(scale=0.12 * (i % 3), size=16) for i in range(120)]
    rows = [(i, v.tolist(), int(i % 20 > 9)) for i, v in enumerate(vectors)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None] * 16, 1), (505, vectors[0].tolist(), None), (None, vectors[0].tolist(), 0), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    units = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (units @ units.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(120, dtype=bool)
    roots = components.Roots()
    for a, b in zip(*np.nonzero(near)):
        roots.join(int(a), int(b))
    out = lattice_dedup.near_vectors(df).collect()
    assert len(out) == 128
    for r in out:
        if r.vec_id is not None and r.vec_id < 500:
            assert (r.n_links, r.component_id, r.kept) == (near[r.vec_id].sum(), roots.root(r.vec_id), roots.root(r.vec_id) == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id
    assert lattice_dedup.near_vectors(df.limit(0)).count() == 0
    rules = lattice_dedup.LatticeRules(block_rows=4)  # cells split over many comparisons
    split = lattice_dedup.near_vectors(df, rules).collect()
    assert as_list(split) == as_list(out)


@given_tables
@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], SQL[name], SF_DIR) is None


@given_tables
def test_pipeline_runs_over_all_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert 0 < len(out) <= docs.count() and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"
    lines = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(lines[i].encode()).hexdigest() for i, r in out.items())
