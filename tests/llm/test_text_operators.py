"""Text operators against brute force, on rows with nulls, empty and long texts, repeats and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from alertsieve.llm import common, decontaminate, jaccard, language, licenses, lm_scoring, quality, sentencepiece_fst, token_counts, token_output, url_rules
from alertsieve.llm.common import lower_words
from alertsieve.llm.pieces import Cutter, PieceModel

BASE = "the quick brown fox jumps over the lazy dog and then it runs far away from all of them until night falls over the quiet hills again".split()
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def texts() -> list[str | None]:
    near = BASE * 2 + "something else was said about nothing much in a very long talk at noon today".split()
    edited = near.copy()
    edited[-1] = "yesterday"
    long = [f"w{i % 977}x{i % 13}" for i in range(20_000)]
    return [
        None, "", " \n\t ", "one", "one two three", "ONE two three", " ".join(near), " ".join(near), " ".join(edited), "\n".join(near[::-1]), " ".join(long), "a b a b a b a b a b",
        "line\nline\n\n line\nline", "é ÉÉ ß 漢字 😀 x y\x0bz", "### $$$ %% word | word", "<|endoftext|> 'tis  double  space\r\nend ",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", None, "de", "en"]
    rows = [(i, t, langs[i % 4], "s" if i % 3 else None, 1, "x", "y", 0.5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, s string, f string, row double")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_quality_counts(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts()):
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), i
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).collect() == []


def test_quality_thresholds_follow_the_source(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    marks = " ".join(f"word{i}##" for i in range(60))
    rows = [(i, clean, "en", "a") for i in range(150)] + [(500 + i, marks, "en", "b") for i in range(150)] + [(900, marks, "en", "a"), (901, clean, "en", "c")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900] and got[500] and got[0]
    assert got[901]  # its source is small, so its language's fences hold


def test_quality_fences(spark):
    """Against exact quantiles, and the same from any partitioning"""
    rng = np.random.default_rng(5)
    sizes = {("en", "a"): 900, ("en", "b"): 40, ("en", None): 1, (None, "a"): 300, ("fr", "c"): 0}
    data = [(la, so, *map(float, rng.gamma(2, 1 + n % 7, 5) * (rng.random(5) < 0.9)), True) for (la, so), n in sizes.items() for _ in range(n)] + [("fr", "c", *[9.0] * 5, False)]
    frame = spark.createDataFrame(data, "_lang string, _source string, " + ", ".join(f"{m} double" for m in quality.FENCES) + ", good boolean")
    got = {(r._lang, r._source): r._limit for r in quality.group_limits(frame, F.col("good"), 4.0, 16).collect()}
    again = {(r._lang, r._source): r._limit for r in quality.group_limits(frame.repartition(7), F.col("good"), 4.0, 16).collect()}
    assert got == again and set(got) == set(sizes)

    def fence(values, m, side, spread):
        q1, q3 = np.quantile(values, [0.25, 0.75], method="inverted_cdf")
        return np.array([q1 - 4 * max(q3 - q1, spread) if side == "both" else np.nan, q3 + 4 * max(q3 - q1, spread)])

    for (la, so), n in sizes.items():
        for i, (m, (side, spread)) in enumerate(quality.FENCES.items()):
            pick = lambda f: [r[2 + i] for r in data if r[-1] and f(r)]  # noqa: B023, E731
            groups = [pick(lambda r: True), pick(lambda r: r[0] == la), pick(lambda r: r[:2] == (la, so))]  # noqa: B023
            want = fence(groups[0], m, side, spread)
            for g in groups[1:]:
                want = (len(g) * fence(g, m, side, spread) + 16 * want) / (len(g) + 16) if g else want
            assert abs(got[la, so][m]["high"] - want[1]) < 0.06 * want[1]
            assert (got[la, so][m]["low"] is None) if side == "upper" else abs(got[la, so][m]["low"] - want[0]) < 0.06 * abs(want[0])


def test_licenses_with_several_notices(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, two), (3, f"{two} {one}"), (4, "none of it")], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs, licenses.template_table(spark, [("own", one), ("own", two), ("own", one)])).collect()))
    assert got == [(1, "own", 1.0), (2, "own", 1.0), (3, "own", 1.0)]


def brute_components(texts, k, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = lower_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(texts(), 4, 85)
    assert jaccard.jaccard_components(empty).collect() == []


def test_jaccard_repeated_rows_link_no_more(spark):
    """Rows that repeat an id and its text, in several partitions, don't add to an overlap"""
    rows = []
    for i, edits in enumerate((6, 7, 8, 9, 10, 12, 14)):
        text = [f"p{i}w{j}" for j in range(300)]
        other = text.copy()
        for e in range(edits):
            other[20 + e * 20] = f"edit{i}x{e}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    frame = spark.createDataFrame(rows + rows[::2] + rows[::2], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert got == brute_components([t for _, t in rows], 4, 85)
    assert jaccard.jaccard_components(frame).count() == len(rows) * 2


@pytest.mark.parametrize("most", [0, 1, 100, 150, 1000])
def test_most_frequent_fills_its_room(spark, most):
    counts = spark.createDataFrame([(i, 2 if i < 200 else 1000 + i) for i in range(210)], "h long, n long")
    got = {r.h for r in common.most_frequent(counts, "n", most).collect()}
    assert len(got) <= most and len(got) >= min(210, most) - 5
    assert most < 10 or set(range(200, 210)) <= got


def test_jaccard_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(220):
        w = [f"t{j}" for j in range(90)]
        for j in rng.integers(0, 90, rng.integers(0, 5)):
            w[j] = f"u{rng.integers(0, 40)}"
        rows.append(" ".join(w[: 90 - int(rng.integers(0, 8))]))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame, k=k, percent=percent).collect()}
        assert got == brute_components(rows, k, percent)


def test_language(spark, docs, empty):
    rng = np.random.default_rng(1)
    parts = {"en": "the and ing tion er th wh".split(), "de": "sch ung ein der zu ge keit".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(20)), lang) for i in range(200) for lang in [("en", "de")[i % 2]]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame.where("doc_id < 100"), landmarks=30)
    got = language.predict(frame.where("doc_id >= 100"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.lang_score <= 1 for r in got)
    odd = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.predict(docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] in ("en", "de")
    none = language.fit(empty)
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


def test_presence_kernel_matches_sets():
    flags = language.presence(["abcab", "", None, "a" * 5000])
    assert flags[1].sum() == flags[2].sum() == 0
    grams = {"abcab"[i : i + n] for n in range(1, 5) for i in range(6 - n)}
    assert abs(flags[0].sum() - len(grams)) <= 1  # hashing may merge two
    assert flags[3].sum() == 4


def test_leaks(spark, docs, empty):
    item = " ".join(f"alpha{i} beta{i}" for i in range(15))
    edited = item.split()
    for i in (3, 11, 20):
        edited[i] = "other"
    edited.insert(7, "inserted")
    host = " ".join(f"filler{i}" for i in range(300))
    rows = [(100, f"{host} {item.upper()}!! {host}"), (101, host + "\n" + " ".join(edited)), (102, host), (103, None), (104, ""), (105, " ".join(item.split()[:6]) + " " + host), (106, item), (106, item)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "", "z"), (4, "completely unrelated words stand here alone", "z")], "item_id long, text string, score string")
    for portion in (8 << 20, 40):
        got = [(r.doc_id, r.item_id, round(r.score, 2)) for r in decontaminate.leaks(frame, items, portion_bytes=portion).collect()]
        assert sorted({g[:2] for g in got}) == [(100, 1), (101, 1), (106, 1)] and len(got) == 4
        assert dict((g[0], g[2]) for g in got)[100] == 1.0
    assert decontaminate.leaks(empty, items).collect() == [] and decontaminate.leaks(frame, items.limit(0)).collect() == []


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment_matches_the_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        assert decontaminate.align(a, b)[0] == brute_alignment(a, b)


def test_leaks_of_edited_copies(spark, monkeypatch):
    """Lone edited copies, groups of them and copies without any equal 3-gram, against the table of the whole text."""
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary[: 40 * (1 + i % 10)], n)) for i, n in enumerate([15, 15, 20, 20, 24, 30, 40, 57, 3, 1])]

    def edited(text, share):
        out = []
        for w in text.split():
            kind = rng.integers(0, 3) if rng.random() < share else 3
            out += {0: [], 1: ["x" + w], 2: [w, "y" + w], 3: [w]}[int(kind)]
        return out

    rows = []
    for i, item in enumerate(items):
        for share in (0.1, 0.15, 0.2, 0.25, 0.25, 0.35):
            for _ in range(1 + 3 * (i % 2)):  # lone copies of one item, groups of the next
                before, after = (list(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(2))
                rows.append(" ".join([*before, *edited(item, share), *after]))
    fifth = items[2].split()
    fifth[::5] = [f"z{i}" for i in range(4)]
    third = items[2].split()
    third[2::3] = [f"z{i}" for i in range(6)]
    spread = [w for v in items[5].split() for w in (v, "z")]
    rows += [" ".join(fifth), " ".join(third), " ".join(spread), *[items[2]] * 3, " ".join(items)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    score = lambda a, b: brute_alignment(np.array(a.split()), np.array(b.split()))
    scores = {(d, i): score(a, t) for d, t in enumerate(rows) for i, a in enumerate(items)}
    for threshold in (0.5, 0.7):
        want = {k: s for k, s in scores.items() if s >= threshold}
        for sums in (1 << 20, 1):
            monkeypatch.setattr(decontaminate, "BLOCK_SUMS", sums)
            got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(frame, tests, threshold=threshold).collect()}
            assert got == want
    assert (len(rows) - 7, 2) in got  # a fifth replaced


def test_sentence_pieces(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded = sentencepiece_fst.encode(docs, PIECES)
    back = {r.doc_id: r for r in sentencepiece_fst.decode(coded, PIECES).collect()}
    for i, t in enumerate(texts()):
        assert back[i].piece_ids == library.encode(t or ""), i
        assert back[i].decoded == (t or "")
    assert coded.columns == [*docs.columns, "piece_ids"]
    assert sentencepiece_fst.encode(empty, PIECES).collect() == []


def test_token_counts(docs, empty):
    model = PieceModel.read(PIECES)
    normal, cut = model.normal(), Cutter(model)
    least = min(model.scores[i] for i in normal.values()) - 10

    def brute(unit):
        best = [(0.0, 0)]
        for i in range(1, len(unit) + 1):
            paths = [(best[j][0] + model.scores[normal[unit[j:i]]], -(-best[j][1] + 1)) for j in range(i) if unit[j:i] in normal]
            if unit[i - 1] not in normal:
                paths.append((best[i - 1][0] + least, best[i - 1][1] - len(unit[i - 1].encode())))
            best.append(max(paths))
        return -best[-1][1]

    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs, PIECES).collect()}
    kept = {}
    for i, t in enumerate(texts()):
        units = cut(t)
        assert got[i] == (len(units), sum(kept.setdefault(u, 0) or kept.update({u: brute(u)}) or kept[u] for u in units)), i
    assert token_counts.count_tokens(empty, PIECES).collect() == []


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 4095, 4096, 4097, 20_000):
        for top in (1, 2, 1000, 60_000, 2**32, 2**63):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            offsets, packed, escapes = token_output.pack(ids)
            assert (token_output.unpack(n, offsets, packed, escapes) == ids).all()
            for k in range(len(offsets)):
                assert (token_output.unpack(n, offsets, packed, escapes, k) == ids[k * token_output.BLOCK : (k + 1) * token_output.BLOCK]).all()


def test_pieces_of_whole_documents(spark):
    """Against the library, with tables that are emptied often and units composed in small lots"""
    import sentencepiece

    from alertsieve.llm import sentencepiece_fst as fst

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = fst.Transducer(PieceModel.read(PIECES))
    machine.pairs = fst.Table(10)
    rows = [r.text for r in common.read(spark, "/root/testdata/sf0.001", "documents").select("text").collect()] + ["a" * 3000, "漢字" * 500 + "x", "\x01\x02 \u0301\u0301b", "zzzzq" * 400, "  ", ""]
    for many in (400_000, 50):
        fst.CHARACTERS = many
        machine.units.clear()
        got = [np.frombuffer(x, np.int32).tolist() for x in machine.encode(rows)]
        assert got == library.encode(rows, num_threads=1)
        fst.CHARACTERS = 400_000


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = sorted(tuple(r) for r in token_output.read_shards(token_output.write_shards(docs, BPE)).collect())
    start = 0
    for (doc, at, n, crc), t in zip(got, texts(), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())), doc
        start += n
    assert token_output.read_shards(token_output.write_shards(empty, BPE)).collect() == []


def test_urls(spark):
    hosts, paths = ["org", "a.org", "b.a.org", "c.b.a.org", "com", "x.com", "", "orgx", "a..org", "A.ORG", "org.", "com:80"], ["", "/", "/a", "/a/", "/a/b", "/b", "/é"]
    rng = np.random.default_rng(3)
    pick = lambda x: x[rng.integers(0, len(x))]
    rules = [(pick(hosts[:9]), pick(paths), pick(["allow", "block"])) for _ in range(25)]
    urls = [None, "", "x", "://", "http://"] + [f"http{pick(['', 's'])}://{pick(hosts)}{pick(paths)}{pick(['', '?q=/a', '#/a', '/c'])}" for _ in range(300)]
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, None, "z")], "page_id long, url string, host string")
    got = [tuple(r) for r in url_rules.judge(frame, url_rules.rule_table(spark, rules)).collect()]
    assert len(got) == len(urls) + 1
    final = {}
    for h, p, v in rules:
        final[h.lower(), p] = max(v, final.get((h.lower(), p), ""))
    for i, host, path, rule, verdict in got:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[i] or "")
        h, p = (m[1].lower(), m[2]) if m else ("", "")
        fit = max(((len(a) + len(b), len(a), a, b, v) for (a, b), v in final.items() if (h == a or (a and h.endswith("." + a))) and p.startswith(b)), default=None)
        assert (host, path, rule, verdict) == (h, p, fit[2] + fit[3] if fit else None, fit[4] if fit else "allow"), urls[i]
    assert url_rules.judge(frame.limit(0), url_rules.rule_table(spark, rules)).collect() == []
    assert {r.verdict for r in url_rules.judge(frame, url_rules.rule_table(spark, []), default="block").collect()} == {"block"}


@pytest.mark.parametrize("most", [400_000, 3])
def test_licenses(spark, docs, empty, most):
    long = " ".join(f"clause{i} of{i % 7} text{i % 11}" for i in range(60))
    templates = [("short", "All rights reserved."), ("mit", "Released under the MIT License."), ("long", long), ("none", " ."), ("mit", "Released under the MIT License.")]
    cut = long.split()
    cut[50] = "changed"
    rows = [(200, "some words ALL RIGHTS, reserved and more"), (201, f"x y z {' '.join(cut)} tail"), (202, "all rights were reserved"), (203, None), (204, "released under\nthe mit license"), (204, "released under\nthe mit license")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = sorted((r.doc_id, r.license) for r in licenses.scan(frame, licenses.template_table(spark, templates), most_values=most).collect())
    assert got == [(200, "short"), (201, "long"), (204, "mit")]
    if most > 3:
        assert licenses.scan(empty, licenses.template_table(spark, templates)).collect() == []
        assert licenses.scan(frame, licenses.template_table(spark, [])).collect() == []


def test_lm_scores(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{min(int(rng.zipf(1.5)), 50)}" for _ in range(40)), i % 5 > 0) for i in range(300)] + [(900 + i, t, False) for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n boolean")
    got = {r.doc_id: r for r in lm_scoring.score(frame, frame["n"], hot=30).collect()}
    count = Counter(w for _, t, on in rows if on for w in [*lower_words(t), b"\n"])
    total, distinct = sum(count.values()), len(count)
    for i, t, on in rows:
        tokens = [*lower_words(t), b"\n"]
        r = got[i]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (on, len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens))
        assert np.isfinite(r.score) and r.score < 0
    held = [r for r in got.values() if r.doc_id < 300 and not r.learned]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score(empty, empty["n"] > 0).collect() == []


def test_lm_scores_equal_a_direct_model(spark):
    """From any partitioning; against the same model as one dense loop over the tokens"""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{min(int(rng.zipf(1.6)), 40)}" for _ in range(30)), i % 4 > 0) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n boolean")
    got = [{r.doc_id: r.score for r in lm_scoring.score(frame.repartition(p), F.col("n"), hot=25).collect()} for p in (1, 8)]
    assert got[0] == pytest.approx(got[1], rel=1e-5)
    texts_ = frame.where("n").select(F.col("text").alias("_text"))
    words = lm_scoring.build_vocabulary(texts_, lm_scoring.count_words(texts_), 25)
    coded = {}
    for i, t, on in rows:
        tokens, edges = lm_scoring.tokens_of(common.pa.array([t]))
        places = words.look_up(tokens)
        classes = lm_scoring.class_of(words, places)
        coded[i] = (places, classes, lm_scoring.features(lm_scoring.histories(words, places, classes, edges)))
    weights = np.zeros((lm_scoring.BUCKETS, lm_scoring.CLASSES))
    weights[0] = words.class_bias()
    share = lambda at: (lambda e: e / e.sum())(np.exp(weights[at].sum(axis=0)))
    learned = [(c, at) for i, _, on in rows if on for c, at in zip(coded[i][1], coded[i][2])]
    observed = np.zeros_like(weights)
    for c, at in learned:
        observed[at, c] += 1
    for _ in range(lm_scoring.ROUNDS):
        expected = np.zeros_like(weights)
        for c, at in learned:
            expected[at] += share(at)
        weights += lm_scoring.RATE / 4 * (observed - expected) / (np.maximum(observed, expected) + 4)
    inner, rare = words.word_shares()
    count = Counter(w for _, t, on in rows if on for w in t.split())
    for i, t, on in rows[:40]:
        places, classes, at = coded[i]
        want = sum(np.log10(share(x)[c]) for c, x in zip(classes, at))
        for p, w in zip(places, [*t.split(), None]):
            want += inner[p] if p >= 0 else np.log10(count[w] + 1) - rare
        assert got[0][i] == pytest.approx(want, rel=1e-4)


def test_lm_probabilities_sum_to_one():
    words = lm_scoring.Vocabulary(np.arange(1, 7, dtype=np.uint64), np.array([9, 5, 4, 3, 2, 2]), np.arange(6), np.array([0, 1, 12, 12, 13, 30]), 30, 11)
    shares, rare = words.word_shares()
    rare_words = 30 - 25 + 11 - 6 + 1  # their counts plus one each, and the unknown event
    assert 10**rare == pytest.approx(rare_words)
    weights = np.random.default_rng(0).normal(size=(lm_scoring.BUCKETS, lm_scoring.CLASSES)).astype(np.float32)
    p = lm_scoring.class_shares(weights, np.array([[0, 5, 6, 7]]))[0]
    assert p.sum() == pytest.approx(1, abs=1e-5)
    for c in (0, 1, 12, 13, 30):
        assert (10 ** shares[words.classes == c]).sum() == pytest.approx(1)


def test_lm_histories_tell_all_hot_words_apart():
    n = 5000
    words = lm_scoring.Vocabulary(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(40), np.full(n, 2), np.arange(n), np.full(n, lm_scoring.OTHER), 2 * n, n)
    places = np.repeat(np.arange(n), 2)
    edges = np.arange(0, 2 * n + 1, 2)  # texts of two tokens
    found = lm_scoring.histories(words, places, lm_scoring.class_of(words, places), edges)
    assert len(np.unique(found[1::2])) > 0.99 * n and len(np.unique(found[::2])) == 1
    assert len(np.unique(lm_scoring.features(found)[1::2, 1])) > n / 2  # they share buckets by chance only
