"""Fitted operators: held-out accuracy, monotone grades, recall against brute force, odd rows; the pipeline."""

import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quayside.llm import latent_decontamination as latent
from quayside.llm import string_kernel
from quayside.llm.latent_decontamination import contaminated, lcs
from quayside.llm.ordinal_quality import of_quality, ordinal_quality, ratings_of, train
from quayside.llm.simhash_bytes import near_duplicates
from quayside.llm.string_kernel import Model, strings_of, toxicity

SMALL, MIDDLE, LARGE = (f"/root/testdata/{x}" for x in ("sf0.001", "sf0.01", "sf0.1"))
LABELS = "doc_id long, quality int, toxic int, text string"


def prose(rng, words=60):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "der"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(5)
    rows, grades = [], []
    for i in range(400):
        text, grade = prose(rng), i % 3
        if grade == 0:
            text = " ".join(x.upper() + "!!" for x in text.split())
        elif grade == 1:
            text = " ".join(x + "***" if j % 3 else x for j, x in enumerate(text.split()))
        rows.append((i, text))
        grades.append((i, grade))
    return rows, grades


def test_grades_are_ordered_and_held_out_rows_are_right(spark, docs_of, rated):
    rows, grades = rated
    ratings = spark.createDataFrame([*grades, (None, 1), (3, None), (0, 2)], "doc_id long, grade int")
    found = {x.doc_id: x for x in ordinal_quality(docs_of(rows), ratings).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([round(found[i].expected_grade) == i % 3 for i in held]) > 0.9
    assert all(found[i].kept == (found[i].tail_probability >= 0.5) for i in found)


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    rows = [(np.array([k, 4 + i % 5]), np.array([1.0, 0.1])) for i in range(90) for k in [i % 4]]
    model = train(rows, np.array([i % 4 for i in range(90)]), 4, rounds=150)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(rng.normal(size=20))
    assert (np.diff(tails, axis=1) <= 0).all()


def test_quality_of_odd_rows_and_missing_ratings(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], LABELS)
    found = ordinal_quality(docs_of(odd_rows), ratings_of(none)).collect()
    assert len(found) == len(odd_rows) and all(x.kept and x.tail_probability == 1 for x in found)
    some = spark.createDataFrame([(1, 0, 0, "x"), (6, 1, 0, "x"), (7, 1, 1, "x"), (8, 0, 0, "x"), (9, 1, 0, None), (9, None, None, None)], LABELS)
    assert ordinal_quality(docs_of(odd_rows), ratings_of(some)).count() == len(odd_rows)
    kept = of_quality(docs_of(odd_rows), ratings_of(some))
    assert kept.schema == docs_of([]).schema
    assert ordinal_quality(docs_of([]), ratings_of(some)).count() == 0


def test_kernel_prefers_gapped_and_stretched_strings():
    model = Model(string_kernel.Landmarks.of(["moron"]), np.ones(1, np.float32), 0.0)
    values = dict(zip(["moron", "moorron", "mxoron", "kalomi", "mo", "a" * 50 + "moron" + "b" * 50], model.strings(
        ["moron", "moorron", "mxoron", "kalomi", "mo", "a" * 50 + "moron" + "b" * 50]).tolist()))
    assert values["moron"] >= 1  # a repeated subsequence counts more
    assert values["moorron"] > 0.3 and values["mxoron"] > 0.15 and values["kalomi"] < 0.02 and values["mo"] < 0.1
    assert values["a" * 50 + "moron" + "b" * 50] > 10 * values["kalomi"]  # found in a long string by its windows
    assert strings_of(["m-o.r_o*n", "i", "d", "i", "o", "t", "..."])[-1] == "idiot" and strings_of(["m-o.r_o*n"]) == ["moron"]


def plain_kernel(a, b):
    """The same by listing all subsequences of three signs with their gaps."""
    def spread(x):
        x, out = ("\x02", *x, "\x03"), {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, len(x)):
                    out.setdefault((x[i], x[j], x[k]), []).append(0.6 ** (k - i - 2))
        size = sum(w * w for ws in out.values() for w in ws) ** 0.5
        return {t: sum(ws) / size for t, ws in out.items()}
    p, q = spread(a), spread(b)
    return max(0.0, sum(w * q.get(t, 0.0) for t, w in p.items())) ** 3


def test_kernel_equals_listed_subsequences():
    rng = random.Random(6)
    words = ["moron", "mo", "a", "aaaa", "straße", "x" * 20, *("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 20))) for _ in range(60))]
    found = string_kernel.kernel(words, string_kernel.Landmarks.of(words))
    plain = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.median(np.abs(found - plain)) < 1e-5 and np.abs(found - plain).max() < 0.05 * plain.max()   # buckets may be shared


def test_landmarks_come_from_all_strings():
    many = [f"{'abcdefghij'[i // 300]}word{i:04d}" for i in range(3000)] + ["zzzzyyyxxx" * 5]
    chosen = string_kernel.varied(many, 5000, apart=1e9)
    assert set(many[:3000]) <= set(chosen) and len(chosen) > 3000   # windows of the long one too


def test_toxicity_on_held_out_rows(spark, docs_of):
    rng = random.Random(9)
    insults, rows, labels = ["grubworm", "slimetoad", "dunghead"], [], []
    for i in range(900):
        text = [prose(rng, 12) for _ in range(5)]
        if i % 6 == 0:
            for _ in range(2):
                x = rng.choice(insults)
                text[rng.randint(0, 4)] += " " + (x if i % 18 else ".".join(x))
        rows.append((i, ". ".join(text)))
        labels.append((i, 1, int(i % 6 == 0), "t"))
    found = {x.doc_id: x for x in toxicity(docs_of(rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in found if found[i].held_out} == set(held)
    assert np.mean([found[i].predicted == int(i % 6 == 0) for i in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in found.values())


def test_toxicity_of_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(1, 1, 1, "t"), (4, 1, 0, "t"), (6, 1, None, "t"), (None, 0, 1, "t")], LABELS)
    found = toxicity(docs_of(odd_rows), labels).collect()
    assert len(found) == len(odd_rows) and all(x.score == 0 and x.predicted == 0 for x in found)
    assert toxicity(docs_of([]), labels).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_lcs_equals_the_table_method():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert lcs(a, b) == plain_lcs(a, b)


def test_matches_include_every_planted_passage(spark):
    docs, items = (spark.read.parquet(f"{MIDDLE}/{x}.parquet") for x in ("documents", "benchmark"))
    listed = [(x.item_id, " ".join(w.decode() for w in latent.plain_words(x.text.encode()))) for x in items.collect()]
    truth = set()
    for x in docs.collect():
        text = " " + " ".join(w.decode() for w in latent.plain_words((x.text or "").encode())) + " "
        truth |= {(x.doc_id, i) for i, t in listed if f" {t} " in text}
    found = {(x.doc_id, x.item_id) for x in contaminated(docs, items).collect()}
    assert truth and len(truth & found) >= 0.9 * len(truth)
    assert len(found - truth) <= 0.02 * len(found)


@pytest.fixture(scope="module")
def full_block():
    """As many items as a block holds, each in one document: every other one word for word, the rest with words left out."""
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    items = [(i, some(40)) for i in range(latent.ITEM_BLOCK)]
    rows = [(1000 + i, " ".join(some(90) + [w for j, w in enumerate(x) if i % 2 == 0 or j % 9 != 4] + some(70))) for i, x in items]
    clean = [(5000 + i, " ".join(some(200))) for i in range(100)]
    return [(i, " ".join(x)) for i, x in items], rows, clean


def test_every_item_of_a_full_block_is_found(spark, docs_of, full_block):
    items, rows, clean = full_block
    found = contaminated(docs_of(rows + clean), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(1000 + i, i) for i, _ in items}
    assert min(x.cosine for x in found if x.item_id % 2 == 0) > 0.5


@pytest.fixture(scope="module")
def listed_block(spark):
    """A full block of given texts: the items of sf0.1 and spans of its documents, with the verbatim pairs by brute force."""
    rng = random.Random(7)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{LARGE}/documents.parquet").where("doc_id % 5 = 0").orderBy("doc_id").collect()]
    words = [[w.decode() for w in latent.plain_words((t or "").encode())] for _, t in rows]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{LARGE}/benchmark.parquet").orderBy("item_id").collect()]
    for own in rng.sample([x for x in words if len(x) >= 90], latent.ITEM_BLOCK - len(items)):
        at = rng.randrange(len(own) - 60)
        items.append((10**6 + len(items), " ".join(own[at : at + 60])))
    plain = [(i, f" {' '.join(w.decode() for w in latent.plain_words(t.encode()))} ") for i, t in items]
    truth = {(d, i) for (d, _), own in zip(rows, words) for text in [f" {' '.join(own)} "] for i, t in plain if t in text}
    return items, rows, truth


def test_recall_of_a_full_block_of_given_texts(spark, docs_of, listed_block):
    items, rows, truth = listed_block
    assert len(items) == latent.ITEM_BLOCK
    found = contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(truth) >= 312 and truth <= {(x.doc_id, x.item_id) for x in found}
    # by the cosine alone
    assert len(truth & {(x.doc_id, x.item_id) for x in found if x.cosine is not None}) >= 0.99 * len(truth)


def paraphrase(words, kind, rng, others):
    """Words left out, swapped with their neighbour, replaced, or with others between them."""
    if kind == 0:
        return [w for w in words if rng.random() > 0.17]
    if kind == 1:
        out = list(words)
        for i in range(len(out) - 1):
            if rng.random() < 0.2:
                out[i], out[i + 1] = out[i + 1], out[i]
        return out
    if kind == 2:
        return [rng.choice(others) if rng.random() < 0.17 else w for w in words]
    return [x for w in words for x in ([w] if rng.random() > 0.25 else [w, rng.choice(others)])]


def test_recall_of_paraphrases_in_the_latent_space(spark):
    """Planted paraphrases against the rule over whole documents; the cosine alone has to bring them."""
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{LARGE}/documents.parquet").where("doc_id % 20 = 0").orderBy("doc_id").collect()]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{LARGE}/benchmark.parquet").orderBy("item_id").collect()]
    rng, plain = random.Random(4), [latent.plain_words(t.encode()) for _, t in items]
    hosts = [x for x in (latent.plain_words((t or "").encode()) for _, t in docs) if 60 < len(x) < 500]
    others = [w for x in hosts for w in x]
    answers = [set(latent.plain_words([x for x in latent._SENTENCE.split(t.encode()) if latent.plain_words(x)][-1])) for _, t in items]
    asked = latent.Items([i for i, _ in items], plain, answers, [], {})
    rows, truth = list(docs), set()
    for n in range(2 * len(items)):
        host, number = hosts[n % len(hosts)], n % len(items)
        at = rng.randrange(len(host))
        words = host[:at] + paraphrase(plain[number], n % 4, rng, others) + host[at:]
        rows.append((10**7 + n, b" ".join(words).decode()))
        if latent.check(asked, number, words, np.arange(len(words))):
            truth.add((10**7 + n, items[number][0]))
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    near = {(x.doc_id, x.item_id) for x in found if x.cosine is not None}
    assert len(truth) > 1.8 * len(items) and len(truth & near) >= 0.98 * len(truth)


def test_the_latent_space_decides(spark, docs_of):
    """Words that occur together share directions: a passage is near an item by words that the item does not hold."""
    rng = random.Random(2)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(40)]
    docs = [(i, " ".join(rng.choice(topics[i % 40]) for _ in range(64))) for i in range(1500)]
    texts = [[w.encode() for w in rng.sample(topics[t], 6)] for t in range(40) for _ in range(8)]
    frequency, total = latent.document_frequency(docs_of(docs))
    terms = latent.Terms.of(texts, frequency, total)
    spaces = latent.latent_spaces(docs_of(docs).select("text"), texts, terms)
    assert [x.loadings.shape[1] for x in spaces] == [latent.RANK] and len(spaces[0].owner) == len(texts) > latent.RANK
    reader, apart, own = latent.Reader(terms), [], []
    for number, item in enumerate(texts):
        # The words of the topic that the item lacks, as far as other items know them: no word in common.
        others = [w.encode() for w in topics[number // 8] if w.encode() not in item]
        for words, to in ((others, apart), (item, own)):
            for _, cosine in latent.similar(reader.passages(words), spaces[0]):
                to.append(float(cosine[0, number]))
    assert min(own) > 0.5 and sum(x > 0.05 for x in apart) > len(apart) / 2   # plain TF-IDF gives zero for every one


def test_the_basis_is_fitted_on_every_passage(spark, docs_of, odd_rows, monkeypatch):
    """Sums of the products of all passages against brute force, with repeated words, rows without an id and more pairs
    than a task holds."""
    rng = random.Random(8)
    texts = [(i if i % 7 else None, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice((0, 1, 15, 16, 17, 31, 32, 33, 48, 49, 200)))))
             for i in range(400)]
    rows = odd_rows + texts
    items = [[b"w%d" % i for i in range(40)], [b"word", b"same", b"text"]]
    frequency, total = latent.document_frequency(docs_of(rows))
    terms = latent.Terms.of(items, np.minimum(frequency, 3), total)
    size = len(terms.row_of)
    want, heavy = np.zeros((size, size)), 0.0
    for _, text in rows:
        words = latent.plain_words((text or "").encode())
        weights = latent.Terms.weights(terms, words, np.array([terms.row_of.get(x, -1) for x in words], np.int64)).astype(float)
        for start in range(0, max(1, len(words) - latent.WINDOW + latent.STRIDE), latent.STRIDE) if words else ():
            vector, stop = np.zeros(size), min(len(words), start + latent.WINDOW)
            for x, w in zip(words[start:stop], weights[start:stop]):
                if x in terms.row_of:
                    vector[terms.row_of[x]] += w
            norm = max(np.sqrt(np.square(weights[start:stop]).sum()), 1e-6)
            heavy += sum((w / norm) ** 2 for x, w in zip(words[start:stop], weights[start:stop]) if x in terms.row_of)
            vector /= norm
            want += np.outer(vector, vector)
    monkeypatch.setattr(latent, "GROUP_WORDS", 500)
    for held in (1 << 20, 100):
        monkeypatch.setattr(latent, "HELD_PAIRS", held)
        pairs, mass = latent.shared_passages(docs_of(rows).select("text").repartition(3), terms)
        got = np.zeros((size, size))
        for i, j, v in pairs.collect():
            assert got[i, j] == 0
            got[i, j] = v
        assert np.allclose(got, want, rtol=1e-5) and np.isclose(mass, heavy, rtol=1e-5) and mass > 1


@pytest.fixture()
def fitted(spark, monkeypatch, tmp_path):
    """Numbers of documents that the basis is fitted on, and a folder with a benchmark."""
    seen, fit = [], latent.latent_spaces

    def spaces(docs, items, terms):
        seen.append(docs.count())
        return fit(docs, items, terms)

    monkeypatch.setattr(latent, "latent_spaces", spaces)
    spark.createDataFrame([(1, "w1 and w2 of the item")], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return seen, str(tmp_path)


MANY = [(i if i % 5 else None, f"w{i} a text of w{i % 50}") for i in range(2500)]


def test_no_document_is_left_out_of_the_fit(spark, docs_of, fitted):
    """Also of more than two thousand, and without an id."""
    contaminated(docs_of(MANY), spark.read.parquet(f"{fitted[1]}/benchmark.parquet")).count()
    assert fitted[0] == [len(MANY)]


def test_the_stage_fits_the_basis_on_all_its_documents(spark, docs_of, fitted):
    corpus_pipeline.decontamination(spark, docs_of(MANY), fitted[1]).count()
    assert fitted[0] == [len(MANY)]


def test_words_are_read_without_an_object_for_each(odd_rows):
    """Words, hashes and document frequencies of whole texts against the plain reading, with words of every length."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcXYZ019é\u4e2d") for _ in range(n))
    texts = [(t or "").encode() for _, t in odd_rows] + [b"", b" .,\t", b"a", " ".join(some(n) for n in range(1, 90)).encode()]
    texts += [" ".join(some(rng.choice((1, 1, 2, 3, 7, 8, 12, 33))) for _ in range(n)).encode() + b"." * (n % 3) for n in (1, 16, 400, 2)]
    plain = [latent.plain_words(x) for x in texts]
    words = latent.Words(texts)
    assert words.sizes.tolist() == list(map(len, plain)) and len(words) == sum(map(len, plain))
    assert [words.word(i) for i in range(len(words))] == [w for x in plain for w in x]
    assert words.hashes.tolist() == [xxhash.xxh64_intdigest(w, latent.SEED) for x in plain for w in x]
    assert words.buckets().tolist() == [latent.bucket(w) for x in plain for w in x]
    assert sorted(words.distinct().tolist()) == sorted(latent.bucket(w) for x in plain for w in set(x))
    assert len(latent.Words([])) == len(latent.Words([]).distinct()) == 0


def test_only_texts_with_a_candidate_are_taken_apart(monkeypatch):
    """One that holds the item's rarest word, or a passage near the item."""
    item = [b"w%d" % i for i in range(12)]
    terms = latent.Terms.of([item], np.zeros(latent.DF_BUCKETS, np.int64), 1000)
    items = latent.Items(["a"], [item], [set()], [], latent.anchors_of([item], terms))
    texts = [b"nothing of it", b"", b"Before, " + b" ".join(item) + b" after", b"words only"]
    taken, plain = [], latent.plain_words
    monkeypatch.setattr(latent, "plain_words", lambda x: taken.append(x) or plain(x))
    anchored = np.isin(np.arange(len(terms.row_of)), list(items.anchors))
    assert [x[:5] for x in latent.matches(items, latent.Reader(terms), anchored, texts)] == [(2, "a", None, 1.0, 1.0)]
    assert taken == [texts[2]]


def test_texts_read_together_are_read_like_single_ones():
    rng = random.Random(6)
    texts = [[b"w%d" % rng.randrange(90) for _ in range(n)] for n in (1, 15, 16, 17, 32, 33, 47, 48, 49, 64, 65, 300, 2)]
    terms = latent.Terms({b"w%d" % i: i for i in range(30)}, np.ones(latent.DF_BUCKETS, np.float32), np.zeros(latent.DF_BUCKETS, bool))
    for least in (0.0, 0.6):
        heads, (starts, norms, places, rows, weights) = latent.Reader(terms).passages_of(texts, least)
        passage, place = (np.searchsorted(heads, x, side="right") - 1 for x in (starts, places))
        for i, words in enumerate(texts):
            one = latent.Reader(terms).passages(words, least)
            together = (starts[passage == i] - heads[i], norms[passage == i], places[place == i] - heads[i], rows[place == i], weights[place == i])
            assert all(np.array_equal(a, b) for a, b in zip(one, together))
            if not least:   # by the definition
                begins = np.arange(0, max(1, len(words) - latent.WINDOW + latent.STRIDE), latent.STRIDE)
                assert one[0].tolist() == begins.tolist()
                assert np.allclose(one[1], [np.sqrt(len(words[b : b + latent.WINDOW])) for b in begins])
    runs = list(latent.groups_of([[b"x"] * n for n in (40, 0, latent.GROUP_WORDS, latent.GROUP_WORDS + 1, 3, 4)]))
    assert [(x.start, x.stop) for x in runs] == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_item_below_the_cosine_is_found_word_for_word(spark, docs_of):
    rng = random.Random(2)
    some = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    rows = [(i, " ".join(some(40) + ["one", "two"] + some(40))) for i in range(60)] + [(100, " ".join(some(40) + ["two", "one"]))]
    found = contaminated(docs_of(rows), spark.createDataFrame([(1, "One two.", "none")], "item_id int, text string, answer string")).collect()
    assert {x.doc_id for x in found} >= set(range(60)) and all(x.lcs_share == 1 for x in found if x.doc_id < 60)


@pytest.mark.parametrize("between", [10, 400])
def test_any_stretch_may_convict(between):
    """The longest common subsequence lacks the answer, a shorter one elsewhere has it; in one group and in two."""
    item, fill = [b"i%d" % i for i in range(20)], [b"x%d" % i for i in range(between)]
    words = item[:12] + fill + [b"y"] * 40 + item[:11] + [b"answer"] + [b"z"] * 40
    places = np.array([0, 40 + len(fill) + 12])
    asked = latent.Items(["a"], [item], [{b"answer"}], [], {})
    found = latent.check(asked, 0, words, places)
    assert found is not None and found[:2] == (11 / 20, 1.0)
    asked.answers[0] = {b"other"}
    assert latent.check(asked, 0, words, places) is None
    assert latent.check(asked, 0, words + item, np.array([0, len(words)]))[0] == 1


def test_long_items_are_searched_in_runs():
    items = [[b"x"] * n for n in (40, 5, 20 * 1024, 40, 1)]
    runs = latent.searches(items)
    assert [x for r in runs for x in items[r]] == items and [r.start for r in runs] == [0, 2, 3]


def test_paraphrases_and_odd_rows(spark, docs_of, odd_rows):
    rng = random.Random(3)
    items = [(i, prose(rng, 30) + ". " + prose(rng, 8) + ".") for i in range(6)] + [(6, None), (7, ""), (0, None)]
    planted = []
    for i, text in items[:6]:
        words = text.split()
        changed = [w for j, w in enumerate(words) if j % 9 != 4]
        planted.append((100 + i, prose(rng, 300) + " " + " ".join(changed).upper() + " " + prose(rng, 200)))
    rows = odd_rows + planted + [(200 + i, prose(rng, 400)) for i in range(40)]
    bench = spark.createDataFrame([(i, t, None, "e") for i, t in items], "item_id int, text string, answer string, doc_id string")
    found = contaminated(docs_of(rows), bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(100 + i, i) for i in range(6)}
    assert contaminated(docs_of([]), bench).count() == 0
    assert contaminated(docs_of(rows), bench.limit(0)).count() == 0


def test_decontamination_stage_with_a_full_block(spark, docs_of, listed_block, tmp_path):
    """Every document with a verbatim item goes; clean ones and those without an id stay, with their columns."""
    items, rows, truth = listed_block
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(4)
    clean = [(10**7 + i, prose(rng, 200)) for i in range(50)]
    docs = docs_of([*rows, *clean, (None, "no id here"), (None, None)])
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert left.schema == docs.schema
    stay = [x.doc_id for x in left.collect()]
    assert truth and not {d for d, _ in truth} & set(stay)
    assert {i for i, _ in clean} <= set(stay) and stay.count(None) == 2


def test_pipeline_stages_against_brute_force(spark, docs_of, odd_rows):
    """Stages 2 and 3 decide as their operators do for single rows; columns stay; ids left over are packed whole."""
    from quayside.llm.compression_bands import verdicts

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    kept = stage["quality rules"](spark, docs, SMALL)
    assert kept.schema == docs.schema
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in rows if verdicts([(x.text or "").encode()])[0][-1]}
    groups = near_duplicates(docs).collect()
    single = stage["near duplicates"](spark, docs, SMALL)
    assert {x.doc_id for x in single.collect()} == {x.component_id for x in groups}
    odd = stage["near duplicates"](spark, docs_of(odd_rows), SMALL)
    assert odd.schema == docs_of([]).schema
    assert sorted((x.doc_id for x in odd.collect()), key=repr) == sorted([1, 4, 5, 6, 7, 8, None, None], key=repr)
    assert corpus_pipeline.run(spark, SMALL).count() > 0
