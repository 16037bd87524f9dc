"""N-gram Jaccard join, collocations, fill-in-middle: brute force, oracles, odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daylark.llm import collocation, fillmiddle, groupjoin, registry

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "One two", "en"), (5, "one TWO", "en"), (5, "one TWO", "en"), (None, "one two", "fr"), (None, "alone here", "fr"),
    (6, "a b c d e", "de"), (7, "A B C D E", None), (8, "a b c d e f", "de"), (9, "äöü Ä ß é x\x1cy " * 30, "de"), (10, "w " * 30_000, "en"),
]
ODD_SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = SPACE.findall(lower(text))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """doc_id per row index -> (set size, smallest id reachable)."""
    sets = [shingles(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            s = len(sets[x] & sets[y])
            if s and 100 * s >= 80 * (len(sets[x]) + len(sets[y]) - s):
                root[find(x)] = find(y)
    least = {}
    for x, row in enumerate(rows):
        if row[0] is not None:
            least[find(x)] = min(row[0], least.get(find(x), row[0]))
    return sorted(((row[0], len(sets[x]), least.get(find(x))) for x, row in enumerate(rows)), key=repr)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def clusters(seed=3):
    """Chains of edited copies, copies of one original at many distances, short texts, and a passage in most documents."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(4):
        text = [word() for _ in range(rng.choice((12, 90, 240, 900)))]
        for step in range(14):
            rows.append(edited(text, 1 + step % 4 * len(text) // 60, rng))
            if step % 3 == 0:
                text = rows[-1]
    for _ in range(80):
        rows.append([word() for _ in range(rng.randrange(1, 120))] + passage[: rng.randrange(40, 61)])
    rows += [r[: max(1, len(r) - 2)] for r in rows[::5]]
    rng.shuffle(rows)
    return [(k, " ".join(r), "en") for k, r in enumerate(rows)]


def joined(spark, rows):
    found = groupjoin.jaccard_components(spark.createDataFrame(rows, ODD_SCHEMA).repartition(3))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(groupjoin, "HOT", 3)
    monkeypatch.setattr(groupjoin, "BLOCK", 4)
    rows = clusters(seed)
    want = components(rows)
    assert 3 < len({c for _, _, c in want}) < len(rows) - 20
    assert joined(spark, rows) == want


def test_jaccard_without_groups_finds_all_links_by_the_bound(spark, monkeypatch):
    """With no votes possible every node is a group of its own, so that all links have to pass the matrix."""
    monkeypatch.setattr(groupjoin, "VOTES", 99)
    rows = clusters(5)
    assert joined(spark, rows) == components(rows)


def test_links_of_a_block_grow_with_its_labels(spark):
    """40 sets that all link, and none of them tied: a spanning forest of their 780 pairs."""
    sets = spark.createDataFrame([(k, [*range(100), 1000 + k]) for k in range(40)], "node long, tokens array<long>")
    rows = sets.select(F.lit(0).cast("long").alias("g"), "node", F.col("node").alias("label"))
    found = groupjoin.opened(rows, rows, sets, 80).collect()
    root = list(range(40))
    for a, b in found:
        root = [root[b] if x == root[a] else x for x in root]
    assert len(set(root)) == 1 and len(found) == 39


def test_jaccard_odd_rows_and_empty_table(spark):
    assert joined(spark, ODD) == components(ODD)
    assert joined(spark, []) == []
    clash = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, node long, id long")
    assert [tuple(r) for r in groupjoin.jaccard_components(clash).collect()] == [(1, 1, 1)]


def test_tokens_in_several_nodes_over_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(1)
    rows = [(rng.randrange(60), rng.randrange(4), 9) for _ in range(200)] + [(100, k, 9) for k in range(9)] + [(101, 5, 9)] * 9
    nodes = {}
    for t, v, _ in rows:
        nodes.setdefault(t, set()).add(v)
    want = sorted((t, v, 9) for t, vs in nodes.items() if len(vs) > 1 for v in vs)
    try:
        for n in ("1", "2", "7", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(map(tuple, groupjoin.in_several(spark.createDataFrame(rows, "token long, node long, n long")).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def mined(rows, least, top=2000, longest=4):
    out = []
    langs = {}
    for _, text, lang in rows:
        langs.setdefault(lang or "und", []).append(text)
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for k in range(1, longest + 1):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            around = [x for x in f if len(x) > len(g) and f[x] >= least and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1))]
            if not any(100 * f[x] >= 80 * a for x in around):
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def prose(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "times", "square", "é", "𝔸", "￿", "a"]
    text = lambda: "".join(rng.choice(words) + rng.choice((" ", " ", " ", "\t", ". ", "\n", ", ")) for _ in range(rng.randrange(60)))
    fixed = ["new york times square. ", "in spite of all ", "of the New York "]
    return [(k, text() + rng.choice(fixed) * rng.randrange(4), rng.choice(("en", "de", None))) for k in range(120)]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_collocations_equal_brute_force(spark, most):
    rows = prose() + ODD
    docs = spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)
    for least, top, longest in ((4, 50, 4), (12, 2000, 4), (5, 20, 3)):
        found = sorted(map(tuple, collocation.collocations(docs, least=least, top=top, longest=longest, most=most).collect()))
        assert found == mined(rows, least, top, longest) and found


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None)], [(1, "a b c", "en")]):
        found = collocation.collocations(spark.createDataFrame(rows, ODD_SCHEMA))
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, [big, big], [big, big], 2)], "a long, heads array<long>, tails array<long>, k int")
    got = row.select(collocation.best_cut(4).alias("x")).first()["x"]
    assert got["score"] == 1_000_000 and got["cut"] == 1


def test_squeezed_keeps_neighbours():
    import numpy as np

    cases = [[1, 2, -1, -2, 3, 4], [-1, 5, -2], [], [1], [1, -1, 2, 3], [-2, -2, 7, 8, -1]]
    pairs = lambda x: [(a, b) for a, b in zip(x, x[1:]) if a >= 0 and b >= 0]
    for case in cases:
        out = collocation.squeezed(np.array(case, np.int64)).tolist()
        assert pairs(out) == pairs(case) and len(out) <= len(case)
        assert out or not pairs(case)


def middle(doc_id, text, percent=100, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, n, "spm", a, b, f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", a, b, f"<P>{a}<S>{c}<M>{b}"


UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"}


@pytest.mark.parametrize("unit,percent", [("line", 100), ("line", 40), ("word", 100)])
def test_fill_in_middle_equals_brute_force(spark, unit, percent):
    rng = random.Random(2)
    signs = ["a", "b\n", "\n", "\r", "<", "<P", ">", "𝔸", "é ", "S>", " ", "\x85"]
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randrange(40))), "en") for k in range(300)]
    rows += [(400, "x<P>y", "en"), (401, "<", "en"), (402, "\n", "en"), (403, "a\n\n", "en"), *ODD]
    made = fillmiddle.transformed(spark.createDataFrame(rows, ODD_SCHEMA), unit=unit, percent=percent)
    assert made.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
    got = made.select("doc_id", "n", "form", "prefix", "middle", "output", fillmiddle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: repr(tuple(r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((middle(i, t, percent, UNITS[unit]) for i, t, _ in rows), key=key)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, _ in rows)


@pytest.mark.parametrize("unit", list(fillmiddle.GRAMMARS))
def test_pieces_join_to_the_text(spark, unit):
    texts = ["", "\n", "One. Two!  Three\n\nFour\n\n\nFive", " lead", "trail \n", "a\r\nb", "x" * 5000 + "\n\n. " * 3000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(fillmiddle.pieces(F.col("text"), unit).alias("p")).collect()
    assert ["".join(r["p"]) for r in got] == texts and all("" not in r["p"] for r in got) and len(got[2]["p"]) > 1


@pytest.mark.parametrize("name", ["op12_phrase_collocations", "op13_fill_in_middle"])
def test_queries_equal_their_oracle(same_as_oracle, name):
    same_as_oracle(registry.queries()[name], registry.oracle_sql()[name])
