"""The ten corpus operators against brute force, with nulls, empty and long texts, ties and clashing columns."""

import gzip
import hashlib
import itertools
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from daylark.llm import components, exact_dedup, langid, lmscore, mixing, quality, registry, secrets, simhash, sptok, toxicity, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
# columns whose names the operators use inside
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, digest string, bytes string,"
    " topic string, n_tokens long, row string, rank long, bucket int, __n int"
)
LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(30_000))
TEXTS = [
    None, "", "", "Same Text here", "same text HERE", "same text here", "É is not é", "é is not é", LONG, LONG + " end", "   ", "\n\t",
    "x" * 5000, "a b", "a b", "one two three four five",
]


def frame(spark, texts, ids=None, langs=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [
        (i, t, (langs or [None])[k % len(langs or [None])], (sources or [None])[k % len(sources or [None])], 0, 9, "k", "d", "b", "t", 1, "r", 2, 3, 4)
        for k, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    ids = [*range(len(TEXTS) - 2), None, 3]
    return frame(spark, TEXTS, ids, ["en", None, "de"], ["s", None]).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().lower().decode()


# ---- 1 exact dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256_bytes, lambda t: F.substring(F.sha2(t.cast("binary"), 256).cast("binary"), 1, 1)])
def test_exact_groups(docs, digest):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    got = exact_dedup.exact_duplicates(docs, digest=digest).collect()
    want = Counter()
    for r in rows:
        own = groups[lower(r.text)]
        first = max((i for i in own if i is not None), default=None)
        want[r.doc_id, first, len(own), r.doc_id == first] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_keeps_smallest_and_drops_the_rest(docs):
    kept = exact_dedup.drop_duplicates(docs, keep="smallest")
    assert kept.columns == docs.columns
    assert {lower(r.text) for r in kept.collect()} == {lower(r.text) for r in docs.collect()}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_drop_keeps_one_row_of_each_text(spark, docs, keep):
    texts = ["same", "same", "alone one", "alone two", "same", "again", "again", "nobody", "nobody", "Same"]
    ids = [None, 5, None, 5, 7, 8, 8, None, None, 9]
    for rows in (docs, frame(spark, texts, ids)):
        groups = {}
        for r in rows.collect():
            groups.setdefault(lower(r.text), []).append(r.doc_id)
        pick = max if keep == "largest" else min
        want = Counter((t, pick((i for i in own if i is not None), default=None)) for t, own in groups.items())
        got = exact_dedup.drop_duplicates(rows, keep=keep)
        assert got.columns == rows.columns
        assert Counter((lower(r.text), r.doc_id) for r in got.collect()) == want


def test_two_batches_equal_one(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    texts = [f"text {k % 37} {'x' * (k % 3)}" for k in range(240)]
    rows = frame(spark, texts).repartition(4).cache()
    parts = [rows.where(F.col("doc_id") % 4 == k).cache() for k in range(4)]
    want = {r.doc_id: tuple(r)[1:4] for r in exact_dedup.exact_duplicates(rows).collect()}
    path = f"file://{tmp_path}/index"
    before = None
    for k, part in enumerate(parts):
        index = exact_dedup.DigestIndex(spark, path)  # opened anew for each batch
        seen = part if before is None else before.unionByName(part)
        got = exact_dedup.exact_duplicates(part, index=index, before=before).collect()
        whole = {r.doc_id: tuple(r)[1:4] for r in exact_dedup.exact_duplicates(seen).collect()}
        assert {r.doc_id: tuple(r)[1:4] for r in got} == {i: whole[i] for i in (r.doc_id for r in got)}
        before = seen
        assert index.runs and all(level > 0 for level, _ in index.runs)
    assert whole == want and max(level for level, _ in index.runs) == 3  # 2 + 2 runs, merged twice
    entries = spark.read.parquet(f"{path}/{index.runs[-1][1]}")
    assert entries.columns == ["digest", "id", "n"] and entries.agg(F.sum("n")).first()[0] == 240
    bits = spark.read.parquet(f"{path}/filter-{index.runs[-1][1]}")
    size = bits.first().buckets
    every = entries.select("digest")
    others = frame(spark, [f"unseen {k}" for k in range(2000)]).select(exact_dedup.sha256_bytes(F.col("text")).alias("digest"))
    assert exact_dedup.passes(every, bits.drop("buckets"), size).count() == every.count()
    assert exact_dedup.passes(others, bits.drop("buckets"), size).count() < 200
    with pytest.raises(ValueError, match="earlier"):
        exact_dedup.exact_duplicates(parts[0], index=index)


def test_hot_digests_and_text_ids(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    monkeypatch.setattr(simhash, "HOT", 3)
    test_exact_groups(docs, exact_dedup.sha256_bytes)
    test_exact_groups(docs, lambda t: F.substring(F.sha2(t.cast("binary"), 256).cast("binary"), 1, 1))
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumn("__gone", F.lit(1))
    groups = {}
    for r in named.collect():
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.drop_duplicates(named, keep=keep)
        assert got.columns == named.columns
        assert Counter((lower(r.text), r.doc_id) for r in got.collect()) == Counter((x, pick((i for i in own if i), default=None)) for x, own in groups.items())
    assert simhash.drop_near_duplicates(named).count() == len({brute_print(r.text) for r in docs.collect()})


def test_exact_oracle(same_as_oracle):
    same_as_oracle(registry.queries()["op1_exact_dedup"], registry.oracle_sql()["op1_exact_dedup"])


# ---- 2 toxicity


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    words = ["the", "sun", "rain", "walk", "tree", "house", "you", "river", "stone", "cloud"]
    texts, marks = [], []
    for k in range(900):
        bad = k % 4 == 0
        own = [rng.choice(words) for _ in range(30)]
        if bad:
            own[rng.randrange(30)] = rng.choice(["Blockhead", "dolt!", "numpty"])
        texts.append(" ".join(own))
        marks.append(int(bad))
    found = toxicity.score_toxicity(frame(spark, texts), spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"))
    held = [r for r in found.collect() if r.held_out]
    assert len(held) > 200 and all(0 <= r.score <= 1 for r in held)
    assert sum(r.predicted == marks[r.doc_id] for r in held) / len(held) > 0.98


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, none).collect()
    assert len(rows) == len(TEXTS) and {r.score for r in rows} == {0.0}
    assert toxicity.score_toxicity(empty, none).count() == 0


def brute_features(lexicon, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0.0] * 11
    size, own = len(text.encode()), [lexicon.of_word(w.encode()) for w in words]
    hits = [k for k, (a, _, b, _) in enumerate(own) if a > 0 or b > 0]
    weights = [own[k][0] + own[k][2] for k in hits]
    second = [k for k, x in enumerate(own) if x[3] > 0]
    near = sum(any(abs(k - j) <= toxicity.NEAR_WORDS for j in second) for k in hits)
    marks = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    return [
        100 * len(hits) / len(words), min(len(hits), 20), 100 * sum(weights) / len(words), max(weights, default=0.0), near / max(1, len(hits)),
        sum("A" <= c <= "Z" for c in text) / size, marks / size, (text.count("!") + text.count("?")) / len(words),
        100 * sum(x[1] for x in own) / len(words), min(20, sum(x[2] > 0 for x in own)), math.log1p(len(words)),
    ]


def test_toxicity_features_against_recount(spark):
    rng = random.Random(22)
    lexicon = toxicity.Lexicon({"dolt": 2.0, "numpty": 3.5})
    bits = ["the", "You", "dolt!", "d0lt", "n*umpty", "NUMPTY", "rain", "été", "your", "??", "!", "x" * 300]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "  ", "dolt " * 5000]
    for r in toxicity.featurize(frame(spark, texts), lexicon, ["doc_id"]).collect():
        assert list(r)[1:] == pytest.approx(brute_features(lexicon, texts[r.doc_id]), rel=1e-5, abs=1e-6)


def test_lexicon_against_its_bound(spark):
    rng = random.Random(23)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(" ".join(rng.sample(words, 6) + (["vile"] if rng.random() < (0.7 if k % 5 == 0 else 0.02) else [])), int(k % 5 == 0)) for k in range(400)]
    rate, counts = sum(m for _, m in rows) / len(rows), {}
    for text, m in rows:
        for w in set(text.split()):
            counts.setdefault(w, [0, 0])[m] += 1
    tried, want = sum(sum(c) >= 3 for c in counts.values()), {}
    for w, (clean, toxic) in counts.items():
        share = toxic / (toxic + clean)
        bound = (toxic + clean) * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0)) if share else 0
        odds = math.log((toxic + 0.5) / (sum(m for _, m in rows) + 1)) - math.log((clean + 0.5) / (len(rows) - sum(m for _, m in rows) + 1))
        if sum((clean, toxic)) >= 3 and share > rate and bound > math.log(tried) and odds > 1:
            want[w] = odds
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert found.weights == pytest.approx(want) and "vile" in want


def test_fitted_toxicity_over_odd_rows(spark):
    rng = random.Random(24)
    texts = [" ".join(rng.choice(["sun", "rain", "walk", "tree"]) for _ in range(20)) + (" blockhead" if k % 3 == 0 else "") for k in range(400)]
    marks = [int(k % 3 == 0) for k in range(400)]
    odd = [None, "", " ", "x" * 50_000, "blockhead " * 3000, texts[0]]
    ids = [*range(400), 1000, 1001, 1002, 1003, 1004, None]
    rows = toxicity.score_toxicity(frame(spark, texts + odd, ids), spark.createDataFrame([*enumerate(marks), (3, 0), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(rows) == 406 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[1004] > 0.9 and max(scores[1001], scores[1000], scores[1002]) < 0.5 and scores[None] == scores[0] > 0.9


def test_obfuscated_words_are_revealed():
    lexicon = toxicity.Lexicon({"idiot": 3.0})
    assert all(lexicon.of_word(w)[2] == 3.0 for w in (b"1d1ot", b"id*iot,", b"idiiiiot!", b"I.D.I.O.T"))
    assert lexicon.of_word(b"Idiot.") == (3.0, 0.0, 0.0, 0.0) and lexicon.of_word(b"YOU")[3] == 1.0


# ---- 3 language id


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        scores = rng.normal(size=(5, 1, 3)).astype(np.float32)
        def total(path):
            return sum(scores[t, 0, s] for t, s in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        path = langid.viterbi(scores, 1.5)[:, 0]
        assert total(path) == pytest.approx(max(map(total, itertools.product(range(3), repeat=5))), abs=1e-5)


def test_languages_spans_and_undetermined(spark, docs, empty):
    english, german = "the cat sat on that mat with this hat and then it ran", "der hund lief durch den wald und dann schlief er auf dem gras"
    rng = random.Random(3)
    texts = [" ".join(rng.choices((english if k % 2 else german).split(), k=25)) for k in range(80)]
    train = frame(spark, texts, langs=["de", "en"])
    model = langid.train(train)
    mixed = [german + " " + german + " " + english, "42 !!", None, "the " * 20_000]
    rows = {r.doc_id: r for r in langid.identify(frame(spark, mixed), ["doc_id"], model, with_spans=True).collect()}
    assert [rows[k].lang_pred for k in range(4)] == ["de", "und", "und", "en"]
    assert [s.lang for s in rows[0].spans] == ["de", "en"] and mixed[0][rows[0].spans[0].start : rows[0].spans[0].end] == f"{german} {german}"
    assert langid.identify(docs, ["doc_id"], model).count() == len(TEXTS)
    untrained = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(docs, ["doc_id"], untrained).collect()} == {"und"}
    assert langid.identify(empty, ["doc_id"], model).count() == 0


def test_script_narrows_candidates():
    model = langid.Model(["el", "en"], {}, {}, np.array([-1.0, -1.0]), {"Latin": np.array([False, True]), "Greek": np.array([True, False])})
    score, count = model.describe(["λόγος".encode(), b"word", b"123", "wordλόγος".encode()])
    assert count.tolist() == [1, 1, 0, 2] and score[:, 2].tolist() == [5, 4, 4, 5]
    assert score[0][0] > score[0][1] and score[1][1] > score[1][0] and score[3][0] > score[3][1]


def test_pieces_hold_every_letter_and_trigram_once():
    rng = random.Random(15)
    for word in (b"Don't", "ÉCOLE".encode(), b"a1b2", b"--", b"x" * 26, b"x" * 27, "Straße,".encode(), b"A"):
        assert langid.pieces_of(word) == [p for p, _, _ in langid.pieces(word.decode())]
    for _ in range(300):
        word = "".join(rng.choice(["a", "b", "É", "ж", "日", "-", "7", "क", "ि"]) for _ in range(rng.randrange(1, 90)))
        runs, last = [], None
        for c in word:
            if c in "-7":
                continue
            script = {"ж": 1, "日": 2, "क": 3, "ि": 3}.get(c, 0)
            if script != last or not runs:
                runs.append("")
            last = script
            runs[-1] += c.lower()
        runs = [r for r in runs if r.strip("ि")]
        want = Counter(f"^{r}$"[k : k + 3] for r in runs for k in range(len(r)))
        found = langid.pieces(word)
        assert Counter(g for p, _, _ in found for g in langid.grams(p)) == want
        assert sum(langid.letters(p) for p, _, _ in found) == sum(map(len, runs))
        assert langid.pieces_of(word.encode()) == [p for p, _, _ in found]
        assert all(a < b and word[a] not in "-7" for _, a, b in found)


def brute_language(model, text):
    """The prediction, its score and spans, from the definitions."""
    items = []
    for word in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        for piece, a, b in langid.pieces(word[0]):
            raw = model.words.get(piece)
            if raw is None:
                raw = sum(model.grams.get(piece[k : k + 3], model.unseen) for k in range(len(piece) - 2))
            score = np.maximum(raw - raw.max(), langid.FLOOR)
            allowed = model.scripts.get(langid.script_of(piece.lstrip("^")[0]))
            if allowed is not None and allowed.any() and not allowed.all():
                score = np.where(allowed, score, langid.RULED_OUT)
                score = score - score.max()
            items.append((score, langid.letters(piece), word.start() + a, word.start() + b))
    if not items:
        return "und", 0.0, []
    states = range(len(model.languages))
    best = [(items[0][0][s], [s]) for s in states]
    for score, *_ in items[1:]:
        best = [max(((best[q][0] - (langid.SWITCH if q != s else 0) + score[s], best[q][1] + [s]) for q in states), key=lambda x: x[0]) for s in states]
    path = max(best, key=lambda x: x[0])[1]
    share = np.bincount(path, [i[1] for i in items], len(model.languages)) / sum(i[1] for i in items)
    total = sum(i[0] for i in items)
    win = int(share.argmax())
    spans = [(items[own[0]][2], items[own[-1]][3], model.languages[s]) for s, own in ((s, [k for k, _ in g]) for s, g in itertools.groupby(enumerate(path), key=lambda x: x[1]))]
    return model.languages[win], share[win] / np.exp(np.clip(total - total[win], -60, 60)).sum(), spans


def test_prediction_against_brute_force(spark):
    rng = random.Random(16)
    own = {"de": "der hund lief durch wald schlief gras über", "en": "the cat sat on that mat with this hat", "ja": "日本語のテキストです", "ru": "это русский текст слово"}
    def sentence(lang, n):
        return ("" if lang == "ja" else " ").join(rng.choice(own[lang].split() if lang != "ja" else list(own[lang])) for _ in range(n))
    langs = [rng.choice(list(own)) for _ in range(160)]
    model = langid.train(frame(spark, [sentence(x, 25) for x in langs], langs=langs))
    assert model.languages == ["de", "en", "ja", "ru"]
    texts = [" ".join(sentence(rng.choice(list(own)), rng.randrange(1, 12)) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    texts += [sentence("en", 3).replace(" ", "") + sentence("ja", 3000), "".join(sentence("de", 20).split()) * 40, "x" + sentence("ru", 400).replace(" ", ""), None, "12 --", ""]
    rows = {r.doc_id: r for r in langid.identify(frame(spark, texts), ["doc_id"], model, with_spans=True).collect()}
    for k, text in enumerate(texts):
        lang, score, spans = brute_language(model, text)
        assert rows[k].lang_pred == lang and rows[k].score == pytest.approx(score, abs=1e-4)
        assert [tuple(s) for s in rows[k].spans] == spans
    assert rows[60].lang_pred == "ja" and rows[61].lang_pred == "de" and rows[62].lang_pred == "ru"


def test_trained_model_over_odd_rows(spark, docs):
    model = langid.train(frame(spark, ["one two three four", "same text here", "wort und satz hier", "text gleich da"] * 20, langs=["en", "en", "de", "de"]))
    for r in langid.identify(docs, ["doc_id", "text"], model).collect():
        lang, score, _ = brute_language(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


# ---- 4 WARC


def test_warc_oracle(same_as_oracle):
    same_as_oracle(registry.queries()["op4_warc"], registry.oracle_sql()["op4_warc"])


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/\n", "x" * 300_000), (2, None, "x" * 300_000), (3, "u", None), (4, "u", ""), (None, "u", "null id"), (5, "u", "é\r\n\r\nü"), (5, "u", "é\r\n\r\nü")],
        "page_id long, url string, html string",
    )
    path = warc.archive_pages(pages, f"file://{tmp_path}/w")
    rows = warc.read_records(spark, path).collect()
    by_id = {(r.record_id, r.record_type): r for r in rows}
    assert len(rows) == 7 and bytes(by_id["urn:page:5", "response"].payload).decode() == "é\r\n\r\nü"
    assert by_id["urn:page:1", "revisit"].refers_to == "urn:page:2" and by_id["urn:page:3", "revisit"].refers_to == "urn:page:4"
    assert by_id["urn:page:1", "revisit"].target_uri == "http://a/%0A" and by_id["urn:page:1", "revisit"].http_length == 300_000
    assert all(r.payload_sha1 == r.payload_digest and r.payload_length == r.http_length for r in rows if r.record_type == "response")
    responses = warc.read_records(spark, path, "record_id string, record_type string").where("record_type = 'response' and record_id like 'urn:page:5%'")
    assert responses.count() == 2


def test_warc_reads_plain_members_and_no_files(spark, tmp_path):
    row = {"record_id": "r", "record_type": "response", "target_uri": "u", "payload": b"body", "refers_to": None}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.warc.gz").write_bytes(gzip.compress(warc.record(row)) + gzip.compress(warc.record(row | {"record_id": "s"})))
    assert [r.record_id for r in warc.read_records(spark, f"file://{tmp_path}/p").collect()] == ["r", "s"]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(spark, warc.archive_pages(none)).count() == 0


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    def page(k):
        return spark.createDataFrame([(k, "u", f"page {k}")], "page_id long, url string, html string")
    def ids():
        return sorted(r.record_id for r in warc.read_records(spark, path, "record_id string").collect())
    warc.archive_pages(page(1), path)
    warc.archive_pages(page(2), path)
    assert ids() == ["urn:page:1", "urn:page:2"]
    (tmp_path / "a" / "part-0.warc.gz").write_bytes(b"left by a lost task")
    warc.archive_pages(page(3), path, mode="overwrite")
    assert ids() == ["urn:page:3"]
    warc.archive_pages(page(4), path)
    assert ids() == ["urn:page:3", "urn:page:4"]
    with pytest.raises(Exception, match="not a page"):
        page(5).withColumn("html", F.raise_error(F.lit("not a page")).cast("string")).selectExpr(
            "'r' record_id", "'response' record_type", "url target_uri", "cast(null as string) refers_to", "cast(html as binary) payload"
        ).write.format("warc").mode("append").save(path)
    assert ids() == ["urn:page:3", "urn:page:4"]
    with pytest.raises(Exception, match="pyarrow.fs"):
        warc.archive_pages(page(6), "viewfs://nowhere/x")


def test_warc_skips_payloads(tmp_path):
    plain = warc.record({"record_id": "r", "record_type": "response", "target_uri": "u", "payload": bytes(random.Random(1).randbytes(200_000)), "refers_to": None})
    data = warc.member(plain)
    (tmp_path / "x").write_bytes(data * 2)
    with open(tmp_path / "x", "rb") as file:
        one = warc.Member(file, 0)
        one.until(b"\r\n\r\n")
        assert len(one.plain) < 40_000 and one.next() == len(data)


# ---- 5 quality rules


def brute_repeats(words, n=8):
    seen = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    hit = {j for k in range(len(words) - n + 1) if seen[tuple(words[k : k + n])] > 1 for j in range(k, k + n)}
    return len(hit)


def test_repeated_words_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 40))]
        assert quality.repeated_words(words) == brute_repeats(words)


def test_base_counts(spark):
    text = "Zeile eins *#\nZeile eins *#\n\n\nÜber |" + " ok" * 30
    r = quality.judge(frame(spark, [text]), ["doc_id"]).first()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), 5, 1)
    assert r.n_repeat_words == brute_repeats(words) and r.base_failed and not r.kept


def test_repeats_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(quality, "_POWERS", np.zeros(8, np.uint64))  # all windows have one hash
    rng = random.Random(17)
    for _ in range(50):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 40))]
        assert quality.repeated_words(words) == brute_repeats(words)


def brute_verdict(text):
    """Whether a rule rejects, from each rule's statement in words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeats = len(words), brute_repeats(words)
    size = lambda parts: sum(len(x.encode()) for x in parts)
    upper, alpha, chars = sum(unicodedata.category(c) == "Lu" for c in text), sum(map(str.isalpha, text)), sum(map(len, words))
    failed = n < 20 or repeats > 0.3 * n
    rejected = (
        len(re.findall(r"[#*$%&|<>]", text)) > 0.3 * n or size(lines) - size(set(lines)) > 0.3 * len(text.encode()) or upper > 20 and upper > 0.5 * alpha
        or text.count("!") + text.count("?") > 0.3 * n or n and not 2 <= chars / n <= 25 or alpha < 0.5 * chars
        or max(Counter(words).values(), default=0) > 0.3 * n or sum(a == b for a, b in zip(words, words[1:])) > 0.3 * n
    )
    return n, chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed, not failed and not rejected


def test_verdicts_against_brute_force(spark, docs):
    rng = random.Random(18)
    bits = ["Word", "été", "LOUD", "and", "so", "on", "#", "|", "!", "?", "\n", "\nthe same line here\n", "7", "a", "x" * 60, "ÄÖÜ"]
    texts = []
    for _ in range(400):
        own, share = rng.sample(bits, rng.randrange(1, 5)), rng.choice([0, 0.2, 0.5])
        words = [rng.choice(own) if rng.random() < share else "wort" + chr(97 + rng.randrange(26)) * rng.randrange(1, 9) for _ in range(rng.randrange(0, 70))]
        texts.append(rng.choice([" ", "  "]).join(words))
    for rows in (frame(spark, texts), docs):
        got = quality.judge(rows, ["doc_id", "text"]).collect()
        assert [tuple(r)[2:] for r in got] == [brute_verdict(r.text) for r in got]
        assert rows is docs or {r.kept for r in got} == {r.base_failed for r in got} == {True, False} and any(not r.kept and not r.base_failed for r in got)
        assert Counter(map(tuple, quality.keep_good(rows).select("doc_id", "text").collect())) == Counter((r.doc_id, r.text) for r in got if r.kept)


def test_quality_oracle(same_as_oracle):
    same_as_oracle(registry.queries()["op5_quality_rules"], registry.oracle_sql()["op5_quality_rules"])


def test_costs_are_measured_where_the_base_passes(spark):
    seen = quality.measure(frame(spark, ["short"] * 5 + [" ".join(f"w{k}" for k in range(40))] * 3 + [" ".join(f"v{k}#" for k in range(60))]))
    assert {x[0] for x in seen.values()} == {4} and seen["symbols"][1] == 1 and all(x[2] > 0 for x in seen.values())


def test_verdict_does_not_depend_on_order(docs, empty):
    reverse = quality.judge(docs, ["doc_id"], rules=quality.RULES[::-1])
    assert Counter(map(tuple, quality.judge(docs, ["doc_id"]).collect())) == Counter(map(tuple, reverse.collect()))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs, ["doc_id"]).where("kept").count()
    assert quality.judge(empty, ["doc_id"]).count() == 0


def test_rules_by_rejections_per_second():
    a, b, c = (quality.Rule(n, None) for n in "abc")
    assert quality.ordered((a, b, c), {"a": (100, 10, 1.0), "b": (100, 10, 0.1), "c": (100, 90, 1.0)}) == (b, c, a)


# ---- 6 language-model scores


def test_lm_base_against_brute_force(docs):
    import zlib

    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update([*lower(r.text).encode().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 4)) for r in lmscore.score_texts(docs).collect()))
    want = []
    for r in rows:
        tokens = [*lower(r.text).encode().split(), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want.append((len(tokens), sum(counts[t] > 0 for t in tokens), n, held(r.doc_id), round(base, 4)))
    assert got == sorted(want)


MASK, GOLD = 2**32 - 1, 0x9E3779B1


def brute_units(alphabet, text):
    out = []
    for b in text + b"\xff":
        r = int(alphabet.rank[b])
        out += [r] if r < 63 else [63, (r - 63) // 64, (r - 63) % 64]
    return out


def brute_contexts(alphabet, units, t):
    """Hashes of the six contexts of unit ``t``, by whole numbers."""
    out, mix = [], 0
    for back in range(1, 7):
        mix = (mix + (units[t - back] if t >= back else 0) + 1) * GOLD & MASK
        if back != 5:
            out.append(mix)
    spaces = {int(alphabet.rank[b]) for b in b" \t\n\x0b\x0c\r"} - set(range(63, 256))
    word = 0
    for u in units[t - t % 2048 : t]:
        word = 0 if u in spaces else (word + u + 1) * GOLD & MASK
    return [*out, word]


def brute_rows(bits, contexts):
    first, rows = 0, []
    for h, b in zip(contexts, bits):
        rows.append((first + (h >> (32 - b))) * 8)
        first += 1 << b
    return rows


def brute_halves(alphabet, bits, units, t):
    contexts, high, low = brute_contexts(alphabet, units, t), units[t] >> 3, units[t] & 7
    return (brute_rows(bits, contexts), high), (brute_rows(bits, [(h + high + 1) * GOLD & MASK for h in contexts]), low)


def brute_score(model, counts, text):
    """log10 probability of a text and its end, one decision after another."""
    units, total = brute_units(model.alphabet, text), 0.0
    for t in range(len(units)):
        if t % 2048 == 0:
            weights, refine = model.weights.astype(float), model.refine.astype(float)
        for half, (rows, part) in enumerate(brute_halves(model.alphabet, model.bits, units, t)):
            seen = [(n > 0) + (n > 3) for n in (int(counts[r : r + 8].sum()) for r in rows[-2:])]
            gate, node = 3 * seen[0] + seen[1], 1
            for place in range(3):
                x = [float(model.odds[r + node]) for r in rows]
                mixed = min(8, max(-8, sum(weights[place, gate, k, half] * x[k] for k in range(6))))
                bucket = (half * 3 + place) * 17 + int(mixed + 8.5)
                bit, p = part >> (2 - place) & 1, 1 / (1 + math.exp(-mixed))
                chance = (p + refine[bucket]) / 2
                total += math.log10(chance if bit else 1 - chance)
                refine[bucket] += (bit - refine[bucket]) * 0.02
                for k in range(6):
                    weights[place, gate, k, half] += (bit - p) * 0.01 / 256 * x[k]
                node = 2 * node + bit
    return total


@pytest.fixture(scope="module")
def mixing_model():
    rng = random.Random(19)
    words = [b"amber", b"birch", "cède".encode(), b"dogwood", b"elm,", b"42"]
    texts = [b" ".join(rng.choice(words) for _ in range(rng.randrange(0, 700))) for _ in range(12)]
    alphabet = lmscore.Alphabet(np.bincount(np.frombuffer(b"\xff".join(texts), np.uint8), minlength=256) + 9 * (np.arange(256) > 230))
    bits = (8, 11, 11, 12, 12, 12)
    places = lmscore.Places(bits)
    counts = np.zeros(places.entries, np.int32)
    lmscore.add_counts(counts, places, texts, alphabet)
    model = lmscore.fresh(alphabet, bits, lmscore.log_odds(counts).ravel())
    model.weights *= np.random.default_rng(20).uniform(0.5, 1.5, model.weights.shape).astype(np.float32)
    return model, counts, texts


def test_lm_counts_against_brute_force(mixing_model):
    model, counts, texts = mixing_model
    want, total = np.zeros_like(counts), 0
    for text in texts:
        units = brute_units(model.alphabet, text)
        total += len(units)
        for t in range(len(units)):
            for rows, part in brute_halves(model.alphabet, model.bits, units, t):
                for r in rows:
                    want[r + part] += 1
    assert (counts == want).all() and counts.sum() == 12 * total
    row = int(np.flatnonzero(counts.reshape(-1, 8).sum(axis=1) > 20)[0])
    leaves, odds = counts.reshape(-1, 8)[row], lmscore.log_odds(counts)[row]
    for node in range(1, 8):
        depth = node.bit_length()
        under = [sum(leaves[k] for k in range(8) if (k | 8) >> (3 - depth) == node * 2 + side) for side in (0, 1)]
        assert odds[node] == round(16 * max(-127 / 16, min(127 / 16, math.log((under[1] + 0.05) / (under[0] + 0.05)))))


def test_lm_scores_against_brute_force(mixing_model):
    model, counts, texts = mixing_model
    odd = [b"", b"amber", texts[0][:500], b"unheard of \xf0\x9f\x98\x80\n\n\tbirch \x00\x01", b"z" * 2050 + b" elm, 42", b"elm, birch " * 800, texts[3] + b" " + texts[4]]
    got = model.log10(odd)
    for k, text in enumerate(odd):
        assert got[k] == pytest.approx(brute_score(model, counts, text), rel=2e-4, abs=1e-3)
    assert model.log10(odd[::-1])[::-1] == pytest.approx(got, rel=1e-12)  # neighbours don't matter


def test_lm_probabilities_sum_to_one(mixing_model):
    model, _, _ = mixing_model
    for before in (b"", b"am", b"amber bir"):
        units = brute_units(model.alphabet, before)[:-1]
        contexts = np.array([brute_contexts(model.alphabet, units, len(units))], np.uint32).T
        total = sum(math.exp(lmscore.Coder(model, 1, 0.0).code([(1, contexts, np.array([u], np.uint32))])[0]) for u in range(64))
        assert total == pytest.approx(1, abs=1e-3)


def test_lm_codes_a_unit_with_one_look_up(mixing_model):
    model, _, texts = mixing_model
    odds, paths = model.odds.reshape(-1, 8), model.paths.view(np.int8).reshape(-1, 4, 4)
    for half in range(8):
        nodes = [1, 2 + (half >> 2), 4 + (half >> 1), 0]
        assert (paths[:, half >> 1] == odds[:, nodes]).all()

    class Table:
        calls = 0

        def take(self, *args, **kwargs):
            self.calls += 1
            return model.paths.take(*args, **kwargs)

    owner, group = next(lmscore.blocks(texts, model.alphabet))
    coder, group = lmscore.Coder(model, len(owner), 0.01), list(group)
    coder.paths = table = Table()
    coder.code(group)
    assert table.calls == len(group) and coder.learnt().shape == (*model.weights.shape, len(owner))


def test_lm_prefers_seen_words_and_takes_any_text(spark, docs, empty):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["amber", "birch", "cedar", "dogwood"]) for _ in range(40)) for _ in range(60)]
    odd = ["zzqx kjwv qqqq " * 10, "amber birch cedar " * 10, "w" * 20_000, None]
    import zlib

    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 7 == 2]
    ids = [*(k for k in range(500) if k not in held), *held]
    ids = [*ids[:60], *held[:4]]
    rows = {ids.index(r.doc_id): r for r in lmscore.score_texts(frame(spark, texts + odd, ids)).collect()}
    assert rows[61].bits_per_byte < rows[60].bits_per_byte and len(rows) == 64 and rows[60].held_out and all(math.isfinite(r.score) and r.score <= 0 for r in rows.values())
    assert lmscore.score_texts(empty).count() == 0
    assert all(r.score < 0 for r in lmscore.score_texts(docs).collect())


def test_lm_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, seven = ({r.doc_id: (r.score, r.base_score) for r in lmscore.score_texts(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == seven.keys() and max(abs(one[k][0] - seven[k][0]) for k in one) < 1e-9
    assert max(abs(one[k][1] - seven[k][1]) for k in one) < 1e-6


# ---- 7 secrets


def test_secret_patterns_against_brute_force(spark):
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([-A-Za-z0-9+/_.=]+)"""
    rng = random.Random(7)
    parts = ["token=", "API_KEY : '", "pass", "word=", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef0123", "é", " ", "\n", "secret", "\"", "x.y", "PASSWD=", "ſecret=abcdefgh", "apikey:", "toKen"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(500)] + [None, "", "token=" + "k9" * 40_000]
    for r in secrets.find_secrets(frame(spark, texts), ["doc_id"]).collect():
        text = texts[r.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(want))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == [x for x in base.split(",") if x]


def test_fillers_explain_only_themselves():
    secret = "q7Zr2LmX9vKd4TbW8nHs3PfY"
    for filler in ("abcdef", "0000", "1234567", "xxxx", "example", "dummy"):
        assert secrets.is_random(secret[:9] + filler + secret[9:]) and secrets.is_random(filler + secret)
    assert secrets.is_random(secret[:6] + "abcdef" + secret[12:])
    for plain in ("abcdef1234567890abcdef1234567890", "xxxxxxxxxxxxxxxxxxxxxxxx", "example-example-example-1", "changeme0000changeme0000", "00000000000000000000000000a1"):
        assert not secrets.is_random(plain), plain
    long = secret * 3000
    assert secrets.is_random(long) and secrets._known.cache_info().currsize <= 50_000


def test_window_entropy_against_recount():
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice("abcXYZ019") for _ in range(rng.randrange(10, 40)))
        def entropy(part):
            return -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values())
        peak = max((entropy(text[k : k + 10]) for k in range(len(text) - 9)), default=0.0)
        assert secrets.windows_peak(text, 10, 0) == pytest.approx(peak)


def test_random_strings_and_allow_list(spark, docs, empty):
    assert secrets.is_random("q7Zr2LmX9vKd4TbW8nHs3PfY") and not secrets.is_random("antidisestablishmentarianism")
    assert not secrets.is_random("123e4567-e89b-12d3-a456-426614174000") and not secrets.is_random("2024-01-01-12-00-00-000000")
    r = secrets.find_secrets(frame(spark, ["é q7Zr2LmX9vKd4TbW8nHs3PfY"]), ["doc_id"]).first()
    assert r.spans == "entropy:2:26" and r.n_hex == 0
    assert secrets.find_secrets(docs, ["doc_id"]).count() == len(TEXTS) and secrets.find_secrets(empty, ["doc_id"]).count() == 0


def test_tokens_with_prefix_or_in_a_path(spark):
    token, mixed = "3ax6xnjp29jd6fds4gc373sgvjxteol0", "q7Zr2LmX9vKd4TbW8nHs3PfY"
    planted = {
        f"key-{token}": f"key-{token}", f"see https://a.b/hook/{token} now": token, f"{token}.json": token, f"0000-{token}": token,
        f"token={'a' * 8}:{mixed}": mixed, f"AKIA{'B1' * 10}/{mixed}": mixed, "x k3v-9q2z_7m4t/1w8p5b x": "k3v-9q2z_7m4t/1w8p5b",
        f"http://example.com/{mixed}/index.html": mixed,
    }
    for (text, secret), (base, more) in zip(planted.items(), secrets.scan_batch(list(planted))):
        at = text.index(secret)
        assert any(a <= at and at + len(secret) <= b for a, b, _ in more), text
        assert not any(a < y and x < b for a, b, _ in more for x, y, _ in base)
    plain = ["/usr/lib/python3.13/site-packages/pyspark", "docs/2024-01-15-meeting-notes-q3.html", "release-notes-v2.3.1-2024-01-15-final", "token=q7Zr2LmX9vKd4TbW8nHs3PfY"]
    assert all(not more for _, more in secrets.scan_batch(plain))


# ---- 8 SentencePiece


def test_encoding_equals_the_library(spark, empty):
    rng = random.Random(9)
    bits = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "😀", "ing", "　", "日本", "<s>", "\x00"]
    texts = [*TEXTS, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300))]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in sptok.encode_texts(frame(spark, texts), ["doc_id"], MODEL, with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = model.encode(text or "")
        assert rows[k].ids == ids and rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert sptok.encode_texts(empty, ["doc_id"], MODEL).count() == 0


def test_each_chunk_is_segmented_once_and_ids_go_to_their_places(spark, monkeypatch):
    texts = ["alpha beta  alpha gamma" + " " * 3 + "z" * 300, "beta " * 40 + "rare", None, "", "z" * 300 + " alpha", *["same rare words"] * 30]
    rows = sptok.stored(frame(spark, texts).repartition(5), "texts-test").withColumn("number", F.col("doc_id") + 7)
    want = Counter(c for t in texts for c in sptok.chunks(t or ""))
    monkeypatch.setattr(sptok, "HEAD_CHUNKS", 3)
    head = sptok.frequent(rows, MODEL)
    assert 0 < len(head) <= 3 and all(want[c] >= 30 for c in head)
    found = sptok.segmented(sptok.holes_of(rows, spark.sparkContext.broadcast(head)), MODEL).collect()
    assert Counter(r.chunk for r in found if r.fresh) == Counter(set(want) - set(head))  # one time each
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    places = {(r.number - 7, k): (r.chunk, r.ids) for r in found for k in np.frombuffer(r.places, "<u4").tolist()}
    assert places.keys() == {(d, k) for d, t in enumerate(texts) for k, c in enumerate(sptok.chunks(t or "")) if c not in head}
    lone = model.encode(" a")[:1]
    assert all(sptok.chunks(texts[d])[k] == c and np.frombuffer(ids, "<u2").tolist() == (model.encode(c) if c else lone) for (d, k), (c, ids) in places.items())


def test_ids_that_do_not_match_the_holes_are_an_error():
    known, fix = np.array([5, 65535, 6], "<u2"), {"places": np.array([1], "<u4").tobytes(), "ids": np.array([8, 9], "<u2").tobytes()}
    assert sptok.filled(known, 65535, [fix]).tolist() == [5, 8, 9, 6]
    for bad in (None, [], [fix, {**fix, "places": np.array([2], "<u4").tobytes()}]):
        with pytest.raises(ValueError):
            sptok.filled(known, 65535, bad)
    with pytest.raises(ValueError):
        sptok.filled(known[:1], 65535, [fix])


@pytest.mark.parametrize("head", [0, 3])
def test_encoding_by_holes_equals_the_library(spark, monkeypatch, head):
    monkeypatch.setattr(sptok, "HEAD_CHUNKS", head)
    monkeypatch.setattr(sptok, "HELD_CHUNKS", 7)
    rng = random.Random(head)
    bits = ["a", "the", " ", "  ", "▁", "\n", "é", "😀", "日本", "<s>", "q" * 70]
    texts = [*TEXTS, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(120))]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in sptok.encode_texts(frame(spark, texts).repartition(4), ["doc_id"], MODEL, with_ids=True).collect()}
    assert [rows[k].ids for k in range(len(texts))] == [model.encode(t or "") for t in texts]


def test_rows_are_packed_to_half_on_their_way_and_all_arrive_in_order(spark, monkeypatch):
    monkeypatch.setattr(sptok, "HELD_BYTES", 1 << 20)
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=8)) for _ in range(40)) for _ in range(1500)]
    rows = sptok.stored(frame(spark, texts).repartition(2), "texts-test").withColumn("number", F.col("doc_id"))
    holes = sptok.holes_of(rows, spark.sparkContext.broadcast({})).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.number, k, r.chunk) for r in holes for k in np.frombuffer(r.places, "<u4").tolist()) == sorted(
        (d, k, c) for d, t in enumerate(texts) for k, c in enumerate(t.split())
    )
    assert all(a.chunk <= b.chunk for a, b in itertools.pairwise(holes) if a.task == b.task)
    batch = pa.RecordBatch.from_pylist([{"number": r.number, "chunk": r.chunk, "places": r.places} for r in sorted(holes, key=lambda r: r.number)])
    sent = list(sptok.packed(pa.Table.from_batches([batch]), np.arange(len(batch)) % 16))
    assert len(sent) == 16 and sum(len(data) for _, data in sent) < 12 * len(batch)  # 24 bytes a row before


# ---- 9 SimHash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(prints):
    root = list(range(len(prints)))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(prints))]


def test_near_duplicates_against_brute_force(spark, docs, empty):
    rng = random.Random(10)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = list(TEXTS)
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(400)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    prints = [brute_print(t) for t in texts]
    rows = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [rows[k].fp & (2**64 - 1) for k in range(len(texts))] == prints
    assert [rows[k].component_id for k in range(len(texts))] == brute_components(prints)
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_near_drop_keeps_one_row_of_each_component(spark, docs, empty):
    texts = ["same words here", "same words here", "quite another text", "a third one of these", "Same words HERE", "twice read", "twice read", "no id", "no id"]
    ids = [None, 5, None, 5, 7, 8, 8, None, None]
    for rows in (docs, frame(spark, texts, ids)):
        all_rows = rows.collect()
        component = dict(zip(sorted({brute_print(r.text) for r in all_rows}), itertools.count()))
        prints = list(component)
        for a, b in itertools.combinations(prints, 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                old, new = component[b], component[a]
                component = {p: new if c == old else c for p, c in component.items()}
        groups = {}
        for r in all_rows:
            groups.setdefault(component[brute_print(r.text)], []).append(r.doc_id)
        want = Counter((g, min((i for i in own if i is not None), default=None)) for g, own in groups.items())
        got = simhash.drop_near_duplicates(rows)
        assert got.columns == rows.columns
        assert Counter((component[brute_print(r.text)], r.doc_id) for r in got.collect()) == want
    assert simhash.drop_near_duplicates(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_dense_grid_points_lose_no_link():
    rng = np.random.default_rng(11)
    start = int(rng.integers(0, 2**63))
    near = {start}
    while len(near) < 700:
        x = start
        for b in rng.integers(0, 64, 3):
            x ^= 1 << int(b)
        near.add(x)
    fps = np.array(sorted([*near, *rng.integers(0, 2**63, 300).tolist()]), np.uint64)
    keys = simhash.grid_points(fps)
    flat, owner = keys.ravel(), np.repeat(fps, keys.shape[1])
    order = np.argsort(flat, kind="stable")
    edges = simhash.links(flat[order], owner[order], 4)
    assert (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= 4).all()
    at = {int(x): k for k, x in enumerate(fps)}
    root = list(range(len(fps)))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in edges.tolist():
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    assert [find(k) for k in range(len(fps))] == brute_components([int(x) for x in fps])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


# ---- 10 mixing


def brute_rake(cells, targets, sweeps=200):
    share = cells / cells.sum()
    for _ in range(sweeps):
        for axis, t in enumerate(targets):
            own = share.sum(axis=tuple(k for k in range(3) if k != axis))
            shape = [1, 1, 1]
            shape[axis] = -1
            share = share * (t / own).reshape(shape)
    return share


def test_raking_against_brute_force(spark):
    rng = np.random.default_rng(12)
    tokens = rng.integers(1, 1000, (3, 2, 2))
    names = (["a", "b", ""], ["x", "y"], ["t", "u"])
    rows = [(names[0][i], names[1][j], names[2][k], int(tokens[i, j, k])) for i in range(3) for j in range(2) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {m: mixing.target_shares(cells, m, None, 0.5) for m in mixing.MARGINS}
    shares = []
    for axis in range(3):
        own = tokens.sum(axis=tuple(k for k in range(3) if k != axis)) ** 0.5
        shares.append(own / own.sum())
    want = brute_rake(tokens.astype(float), shares)
    for r in mixing.rake(cells, targets).collect():
        at = tuple(n.index(v) for n, v in zip(names, (r.source, r.lang, r.topic)))
        assert r.share == pytest.approx(want[at], abs=1e-5)


def test_mixture_meets_targets_and_budget(spark):
    rng = random.Random(13)
    texts = [" ".join(["word"] * rng.randrange(20, 60)) for _ in range(3000)]
    sources = ["big"] * 8 + ["small", "tiny"]
    rows = mixing.mixture(frame(spark, texts, langs=["en"], sources=sources), targets={"source": {"big": 0.5}}, budget=0.2).collect()
    total = sum(r.n_tokens for r in rows)
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert expected == pytest.approx(0.2 * total, rel=1e-3)
    big = sum(r.n_tokens * r.probability for r in rows if r.source == "big")
    assert big / expected == pytest.approx(0.5, abs=0.01)
    assert sum(r.n_tokens for r in rows if r.sampled) == pytest.approx(expected, rel=0.15)


def test_cells_in_arrays_and_in_spark_agree(spark):
    rng = np.random.default_rng(14)
    rows = [(s, l, t, int(n)) for s in "abcd" for l in ("x", "", "z") for t in "tuv" for n in [rng.choice([0, 3, 40, 700, 9000])]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    for targets, budget in (({"source": {"a": 0.6, "d": 0.1}}, 0.6),):
        small = {tuple(r[m] for m in mixing.MARGINS): r for r in mixing.small_rates(cells.toArrow(), targets, 0.7, budget).to_pylist()}
        large = mixing.large_rates(cells, targets, 0.7, budget).collect()
        assert len(small) == len(large) == len(rows)
        for r in large:
            own = small[r.source, r.lang, r.topic]
            assert own["probability"] == pytest.approx(r.probability, abs=1e-6) and own["weight"] == pytest.approx(r.weight, abs=1e-6)
    whole = mixing.small_rates(cells.toArrow(), {"lang": {"x": 0.5}, "topic": {}}, 0.7, 1.0).to_pylist()
    assert all(r["probability"] == pytest.approx(1) for r, n in zip(whole, (c.tokens for c in cells.collect())) if n)


def test_sampling_by_hash_against_brute_force(docs):
    """Every row: its cell's tokens counted again, and the draw made again from the hash of its id or text."""
    rows = mixing.mixture(docs, budget=0.5).collect()
    tokens = Counter()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")
        assert r.n_tokens == len(words) and r.topic == ("note" if len(words) < 100 else "long")
        assert r.sampled == (r.u < r.probability) and 0 <= r.u < 1
        tokens[r.source, r.lang, r.topic] += len(words)
    assert len({(r.row.doc_id, r.u) for r in rows if r.row.doc_id is not None}) == len({r.row.doc_id for r in rows if r.row.doc_id is not None})
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert expected == pytest.approx(0.5 * sum(tokens.values()), rel=1e-6)


def test_full_cells_leave_the_margins_whole(spark):
    words = {"big": 400, "small": 60, "tiny": 12}
    rows = [(s, l, t, n) for k, s in enumerate(words) for j, l in enumerate(("x", "y")) for i, t in enumerate(("t", "u")) for n in [words[s] * (9, 2)[j] * (5, 1 + k)[i]]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    total, budget = sum(r[3] for r in rows), mixing.BUDGET
    asked = {m: mixing.target_shares(cells, m, None, mixing.TEMPERATURE) for m in mixing.MARGINS}
    reach = {m: mixing.within_reach(cells, m, t, budget) for m, t in asked.items()}
    got = mixing.rake(cells, reach, budget=budget).collect()
    given = {r: min(r.share, r.tokens / total / budget) for r in got}
    assert any(r.share > r.tokens / total / budget for r in got)
    for axis, m in enumerate(mixing.MARGINS):
        want = {r[m]: r.share for r in asked[m].collect()}
        held = set()  # by hand: values that ask for more than they have are held, the others share the rest
        own = {v: sum(r[3] for r in rows if r[axis] == v) / total / budget for v in want}
        while True:
            rest = (1 - sum(own[v] for v in held)) / sum(w for v, w in want.items() if v not in held)
            more = {v for v in want if v not in held and want[v] * rest > own[v]}
            if not more:
                break
            held |= more
        for v in want:
            assert sum(g for r, g in given.items() if r[m] == v) == pytest.approx(own[v] if v in held else want[v] * rest, abs=1e-5)


def test_mixture_takes_any_row(docs, empty):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.sample_mixture(docs).columns == docs.columns
    assert mixing.mixture(empty).count() == 0 and mixing.sample_mixture(empty).count() == 0


def test_working_tables_can_be_released(spark, docs):
    from daylark.llm import common

    kept = common.stored(docs.select("doc_id"), "some")
    assert kept.count() == len(TEXTS)
    path = common._MADE[-1].removeprefix("file://")
    common.release(spark)
    import os

    assert not os.path.exists(path) and not common._MADE


def test_roman_numerals_and_circled_letters_do_not_shout(spark):
    """They are upper case but no letters: such a text has no more capitals than the letters that it has."""
    quiet = " ".join(["Ⅳ Ⓐ Ⅷ"] * 4 + [f"wort{k} ding{k} haus{k}" for k in range(20)])
    loud = " ".join(["ÄÖÜ"] * 4 + [f"WORT{k} ÜBER{k} HAUS{k}" for k in range(20)])
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([(1, quiet), (2, loud)], "doc_id long, text string"), ["doc_id"]).collect()}
    assert found == {1: brute_verdict(quiet)[-1], 2: brute_verdict(loud)[-1]} and not found[2]
    marks = quality.Document("ⅣⒶⅧ Ab")
    assert (marks.n_upper, marks.n_letters) == (1, 2)
