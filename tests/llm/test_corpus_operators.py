"""Line dedup, the Jaccard join, packing, neighbours, page text and the pipeline, against brute force."""

import itertools
import random

import numpy as np
import pytest

from weft.llm import ann, htmltext, jaccard, linededup, packing

# --- lines ---------------------------------------------------------------------------------------


def brute_dedup(docs, least):
    seen, out = set(), []
    for _, text in docs:
        if not text:
            out.append(text)
            continue
        lines = text.split("\n")
        words, gone = [len(x.split()) for x in lines], set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += words[b]
                if total >= least:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(run)
                    break
        left = [x for i, x in enumerate(lines) if i not in gone]
        out.append("\n".join(left) if not gone or any(x.split() for x in left) else "")
    return out


def test_line_dedup(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 4))) for _ in range(12)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, docs[0][1]), (63, "x y z\n" * 30), (64, "\n".join(["p q r s t u"] * 9))]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, line int").repartition(3)
    for least in (4, 9):
        got = linededup.dedup(df, min_words=least).orderBy("doc_id").collect()
        assert [g["text"] for g in got] == brute_dedup(docs, least) and [g["line"] for g in got] == [i for i, _ in docs]
    assert linededup.dedup(df.limit(0)).count() == 0
    assert linededup.dedup(df.where("doc_id = 60")).first()["text"] is None


def brute_maximal(docs, least):
    """The lines of every run of at least ``least`` words, of any length, that occurs earlier."""
    seen, out = set(), []
    for _, text in docs:
        lines, gone = (text or "").split("\n"), set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(lines[a : b + 1])
                if text and sum(len(x.split()) for x in run) >= least:
                    gone |= set(range(a, b + 1)) if run in seen else set()
                    seen.add(run)
        left = [x for i, x in enumerate(lines) if i not in gone]
        out.append(text if not gone else "\n".join(left) if any(x.split() for x in left) else "")
    return out


def test_line_dedup_deletes_maximal_runs(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 4))) for _ in range(12)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, docs[0][1]), (63, "x y z\n" * 30), (64, "\n".join(["p q r s t u"] * 9))]
    long = " ".join(f"w{i}" for i in range(60))
    docs += [(70, f"{long}\nthese eight words follow the long line here\n\nend"), (71, f"own\n{long}\nthese eight words follow the long line here\n\nother")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for least in (4, 9, 50):
        got = linededup.dedup(df, min_words=least, maximal=True).orderBy("doc_id").collect()
        assert [g["text"] for g in got] == brute_maximal(docs, least)
    assert got[-1]["text"] == "own\nother"


def test_equal_rows_are_one_document(spark):
    """Fifty equal rows, and fifty without an id, have one result and don't multiply."""
    body = "\n".join(f"line {i} of a text that many rows hold, with some more words in it" for i in range(40))
    other = "\n".join(f"own {i} words of the other text that stands alone here" for i in range(40))
    rows = [(5, body)] * 50 + [(None, body)] * 50 + [(7, other)] * 3 + [(9, body + "\nits own last line"), (10, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {}
    for g in linededup.dedup(df, maximal=True).collect():
        got.setdefault(g["doc_id"], []).append(g["text"])
    # no id comes first
    assert got == {None: [body] * 50, 5: [""] * 50, 7: [other] * 3, 9: ["its own last line"], 10: ["x y z"]}


# --- the join ------------------------------------------------------------------------------------


def near_copies(r, n_groups=12, copies=6):
    docs = []
    for _ in range(n_groups):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice((1, 2, 3, 8, 15, 40, 120)))]
        docs.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice(([], [f"v{r.randint(0, 99)}"], [words[k], "extra"]))
                words = words or ["one"]
            docs.append(" ".join(words))
    return docs


def brute_groups(docs, words, num, den):
    def shingles(t):
        w = (t or "").lower().split()
        return set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in docs]
    label, links = list(range(len(docs))), set()

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            links.add((a, b))
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return [root(i) for i in range(len(docs))], sets, links


@pytest.mark.parametrize("words, num", [(3, 90), (2, 60)])
def test_groups(spark, words, num):
    docs = near_copies(random.Random(words)) + [None, "", " \n", "Only One", "only one", "a b"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {g["doc_id"]: g for g in jaccard.groups(df, words, num, 100).collect()}
    labels, sets, _ = brute_groups(docs, words, num, 100)
    assert [got[i]["component_id"] for i in range(len(docs))] == labels
    assert [got[i]["n_shingles"] for i in range(len(docs))] == [len(s) for s in sets]


def test_components(spark):
    """A long chain in no order, stars, pairs, self links and nulls; then more links between them."""
    from weft.llm.common import Scratch, components, merged

    r = random.Random(1)
    names = r.sample(range(-(10**6), 10**6), 400)
    links = [*zip(names[:150], names[1:150]), *[(names[150], x) for x in names[151:250]], *zip(names[250:300:2], names[251:300:2]), (names[301], names[301]), (None, names[302])]
    more = [(names[3], names[160]), (names[250], names[320]), (names[330], names[331]), (names[5], names[6])]

    def brute(links):
        label = {x: x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
        for _ in range(len(label)):
            for a, b in links:
                if a in label and b in label:
                    label[a] = label[b] = min(label[a], label[b])
        return label

    schema = "a long, b long"
    found = components(spark.createDataFrame(links, schema))
    assert {g["node"]: g["label"] for g in found.collect()} == brute(links)
    grown = merged(found, spark.createDataFrame(more, schema), Scratch(spark, "merged"))
    assert sorted((g["node"], g["label"]) for g in grown.collect()) == sorted(brute(links + more).items())
    assert components(spark.createDataFrame([], schema)).count() == 0


def test_all_links(spark):
    docs = near_copies(random.Random(8), 8, 5)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows, pairs = jaccard.join(df, 2, 70, 100, links="all")
    name = {g["doc_id"]: g["name"] for g in rows.collect()}
    _, sets, links = brute_groups(docs, 2, 70, 100)
    want = {frozenset((name[a], name[b])) for a, b in links if sets[a] != sets[b]}
    assert {frozenset((g["a"], g["b"])) for g in pairs.collect()} == want


@pytest.mark.parametrize("crowded, block", [(2, 512), (2, 3), (64, 4)])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = near_copies(random.Random(5), 5, 12)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {g["doc_id"]: g["component_id"] for g in jaccard.groups(df, 2, 80, 100).collect()}
    assert [got[i] for i in range(len(docs))] == brute_groups(docs, 2, 80, 100)[0]


def test_sets_that_meet_many_are_copied_by_tiles(spark, monkeypatch):
    """All pairs of 150 sets that are near each other: exact in every slice, and far fewer copies of sets than pairs."""
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 1)
    r = np.random.default_rng(5)
    sets = {k: np.unique(np.concatenate((np.arange(60), r.integers(60, 100, 20)))).astype(np.uint64) for k in range(150)}
    pairs = list(itertools.combinations(sets, 2))
    stored = spark.createDataFrame([(k, bytearray(v.tobytes()), len(v) * 8) for k, v in sets.items()], "name long, tokens binary, size int")
    scratch = jaccard.Scratch(spark, "tiles-test")
    copied_rows = jaccard._tiles(spark.createDataFrame(pairs, "a long, b long"), stored, scratch).count()
    got = jaccard._verified(spark.createDataFrame(pairs, "a long, b long"), stored, 80, 100, scratch).collect()
    want = {(a, b): 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in pairs}
    assert len(got) == len(pairs) and {(g["a"], g["b"]): g["linked"] for g in got} == want
    assert len(set(want.values())) == 2 and copied_rows < len(pairs) / 8


def test_pigeonhole_holds_for_random_pairs():
    """Any two sets within the bound share an index row."""
    r = np.random.default_rng(4)
    for num in (60, 80, 90):
        for _ in range(400):
            n = int(r.integers(2, 200))
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            y = x.copy()
            for _ in range(int(r.integers(1, max(2, n // 4)))):
                y = np.delete(y, r.integers(0, len(y))) if r.random() < 0.5 and len(y) > 1 else np.append(y, r.integers(0, 2**63, dtype=np.uint64))
            y = np.unique(y)
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= num * (len(x) + len(y) - shared) and len(x) + len(y) > 2 * shared:
                a, b = jaccard.index_rows(x, num, 100), jaccard.index_rows(y, num, 100)
                assert len(np.intersect1d(a[0], b[0]))


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "h"), (3, long + " more", "h"), (3, long + " more", "h"), (9, "quite other words in this one", "x"), (None, long, "n"), (7, None, "y"), (8, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = jaccard.without_near_copies(df).collect()
    assert sorted((g["doc_id"], g["h"]) for g in got) == [(3, "h"), (7, "y"), (8, "z"), (9, "x")]
    assert jaccard.without_near_copies(df.limit(0)).count() == 0


# --- packing -------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        lengths = sorted(r.sample(range(40), r.randint(1, 8)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 4)
        best = min(sum(c * (min(b for b in cut if b >= x) - x) for x, c in zip(lengths, counts)) for n in range(1, k + 1) for cut in itertools.combinations(lengths, n) if cut[-1] == lengths[-1])
        bounds, padding = packing.boundaries(np.array(lengths), np.array(counts), k)
        assert padding == best and bounds[-1] == lengths[-1] and len(bounds) <= k
        assert sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts)) == best
    assert packing.boundaries(np.array([]), np.array([]), 3) == ([], 0)


def test_batches(spark):
    r = random.Random(7)
    rows = [(i % 90, r.choice((1, 3, 3, 3, 3, 200, 9000, 20001)), "b") for i in range(150)] + [(None, None, "b"), (4, 0, "b")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, bucket string").repartition(5)
    got = packing.pack(df, buckets=3, budget=300).collect()
    assert len(got) == len(rows)
    batches = {}
    for g in got:
        assert g["padded_to"] >= (g["n_tokens"] or 0)
        batches.setdefault(g["batch_id"], []).append(g)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert sorted(x["place"] for x in b) == list(range(len(b))) and len({x["padded_to"] for x in b}) == 1
        assert len(b) == 1 or sum(x["padded_to"] for x in b) <= 300


def test_long_rows_have_the_least_padding(spark):
    r = random.Random(9)
    lengths = [r.choice((40, 300, r.randint(8_193, 60_000))) for _ in range(120)]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), buckets=3).collect()
    names = sorted(set(lengths))
    best = min(sum(min(b for b in cut if b >= x) - x for x in lengths) for cut in itertools.combinations(names, 3) if cut[-1] == names[-1])
    assert sum(g["padded_to"] - g["n_tokens"] for g in got) == best


# --- neighbours ----------------------------------------------------------------------------------


def test_hadamard():
    x = np.eye(8)
    h = ann.hadamard(x)
    assert np.allclose(h @ h.T, x) and np.allclose(np.abs(h), 1 / np.sqrt(8))


def brute_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * r.normal(size=16)).tolist()) for i in range(600)]
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(40)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + same[1:]), (2003, [float("inf")] + same[1:]), (2004, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4)
    asked = [x for x in rows if x[0] % 100 == 0]
    got = {}
    for g in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append(g["vec_id"])
    want = brute_nearest(rows, asked, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert got[1000] == want[1000]  # equal vectors: distance 0, ties to smaller ids


@pytest.mark.parametrize("hashes, probes", [(1, ann.PROBES), (2, 2500)])
def test_recall_without_structure(spark, hashes, probes):
    """Random directions are the hard case: recall at 10 over every query, in single precision."""
    x = np.random.default_rng(4).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for g in ann.search(df, df.where("vec_id % 100 = 0"), hashes=hashes, probes=probes).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    exact = np.sqrt(((x[::100, None].astype(float) - x[None]) ** 2).sum(axis=2))
    want = {100 * i: np.argsort(np.where(np.arange(3000) == 100 * i, np.inf, row))[:10].tolist() for i, row in enumerate(exact)}
    assert set(got) == set(want) and all(s == exact[q // 100, i] for q, hits in got.items() for i, s in hits)
    assert np.mean([len({i for i, _ in got[q]} & set(want[q])) / 10 for q in want]) >= 0.9


def test_one_id_with_two_vectors(spark, monkeypatch):
    """Each vector is a query with ranks of its own; buckets of many blocks lose no row."""
    monkeypatch.setattr(ann, "BLOCK", 3)
    monkeypatch.setattr(ann, "PART", 2)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *[(i, [1.0, i / 100]) for i in range(1, 60)], *[(100 + i, [i / 100, 1.0]) for i in range(1, 60)], (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id = 0"), k=3).collect()
    assert sorted((g["rank"], g["vec_id"]) for g in got) == [(1, 1), (1, 101), (2, 2), (2, 102), (3, 3), (3, 103)]


def test_few_rows_are_all_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, -2.0]), (100, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(g["query_id"], g["rank"], g["vec_id"]) for g in got] == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.search(df.limit(0), df).count() == 0


# --- pages ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain():
    return htmltext.trained(300)


def test_held_out_pages(chain):
    maker, wrong, blocks = htmltext.PageMaker(123), 0, 0
    for _ in range(150):
        html, labels = maker.page()
        got = chain.decode(htmltext.blocks_of(html))
        wrong, blocks = wrong + sum(a != b for a, b in zip(got, labels)), blocks + len(labels)
    assert wrong / blocks < 0.02


def test_viterbi_is_the_best_sequence(chain):
    maker = htmltext.PageMaker(5)
    for _ in range(30):
        blocks = htmltext.blocks_of(maker.page()[0])[:9]
        e = [chain.emission(b) for b in blocks]

        def total(y):
            return sum(s for s, k in zip(e, y) if k) + sum(chain.change[a][b] for a, b in zip(y, y[1:]))

        best = max(map(total, itertools.product((0, 1), repeat=len(blocks))))
        assert abs(total(chain.decode(blocks)) - best) < 1e-9


def test_markup(chain):
    html = "<html><head><title>T</title><script>var a='</p><p>x';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- c --><article><h1>Head &amp; more</h1><p>One <b>two\n three</b> four.<br>Five, six and seven.<p>Eight&nbsp;nine ten, eleven.</article><footer>&copy; me</footer>"
    assert chain.main_text(html) == "Head & more\nOne two three four. Five, six and seven.\nEight nine ten, eleven."
    for odd in (None, "", "<", "<p", "a < b", "<!-- never closed", "<script>x", "</p></p>", "<p>" * 5000 + "x", '<a href="' * 3000, "<div>" * 3000 + "x" * 10):
        assert isinstance(chain.main_text(odd), str)


def test_page_columns(spark, chain):
    df = spark.createDataFrame([(1, "u", "<article><p>One, two and three four.</p></article>", "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    got = htmltext.extract(df, chain).orderBy("page_id").collect()
    assert (got[0]["text"], got[0]["n_chars"], got[1]["text"], got[1]["n_chars"]) == ("One, two and three four.", 24, "", 0)


def test_what_an_article_holds_stays(chain):
    """Its author's line, captions, credits and formulas are main text; the page's own are not."""
    say = "Some words of an article, which go on for a while and end here."
    html = f'<nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p class="byline">By Jo Doe</p><p>{say}</p><figure><img src=x><figcaption>A view</figcaption></figure><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><g><text>so</text></g></svg> <object>on</object>. {say}</p><div class="credit">Photo: Ann</div><p>{say}</p></article><div class="sidebar"><p>{say}</p></div><footer>&copy; me</footer>'
    assert chain.main_text(html).split("\n") == ["Title of it", "By Jo Doe", say, "A view", f"Let x = 1 and so on. {say}", "Photo: Ann", say]
    inside = "<div>" * 300 + f"<p>{say}</p>" + "</div>" * 300
    assert chain.main_text(f"<article>{inside}</article><aside>{inside}</aside>") == say


def test_pages_that_repeat(spark, chain):
    df = spark.createDataFrame([(1, "u", "<article><p>One, two and three four.</p></article>")] * 3 + [(2, None, "<p>" + "word, and more. " * 200_000)], "page_id long, url string, html string")
    got = htmltext.extract(df, chain).orderBy("page_id").collect()
    assert len(got) == 4 and len({tuple(g) for g in got[:3]}) == 1 and got[3]["n_chars"] == len("word, and more. ") * 200_000 - 1
    assert htmltext.extract(df.limit(0), chain).count() == 0


def test_a_telling_word_counts_at_any_place():
    utility = " ".join(f"u{chr(97 + i)}" for i in range(20))
    path = htmltext.blocks_of(f'<div class="{utility} sidebar">x</div>')[0].path
    assert "means:side" in htmltext.path_features(path)


def test_depth_has_no_limit():
    """Past any depth the innermost tags still count, and closing tags end their own."""
    deep = "<div>" * 300 + "<nav>menu</nav>" + "</div>" * 44 + "<article><p>text</p></article>" + "</div>" * 256 + "<p>after</p>"
    menu, text, after = [htmltext.path_features(b.path) for b in htmltext.blocks_of(f"<main>{deep}</main>")]
    assert "region:nav" in menu and "leaf:nav" in menu and "in:nav" not in text
    assert "region:article" in text and "leaf:p" in text and "in:article" not in after and "region:main" in after and "in:div" not in after
    for hostile in ("<foo>" * 60_000 + "</bar>" * 60_000, "<li><ul>" + "<foo>" * 60_000 + "<option></option>" * 60_000):
        assert htmltext.blocks_of(hostile + "x")[0].text == "x"


@pytest.mark.parametrize("tag", ["<svg/>", '<svg class="icon" />', "<math/>", "<svg>", "<noscript>", "<iframe src=/a/>", "<noscript>" * 100_000])
def test_tags_without_an_end_hide_nothing(tag):
    assert [b.text for b in htmltext.blocks_of(f"<p>one</p>{tag}<article><p>two</p></article>")] == ["one", "two"]
    assert [b.text for b in htmltext.blocks_of("<p>one</p><svg /><p>two</p><svg href=/a/><text>own</text></svg><p>three</p><script>var x")] == ["one", "two", "own", "three"]


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from weft.llm import pii

    words = [f"{a}{b}" for a in ("an", "re", "tio", "mo", "ka") for b in ("la", "so", "ni", "du", "te", "pra")]

    def prose(n, seed):
        q = random.Random(seed)
        return "\n".join(" ".join(q.choice(words) for _ in range(12)) for _ in range(n))

    passage = prose(6, 1000)
    docs = {i: prose(8, i) for i in range(12)}
    docs[20] = docs[0]  # exact copy
    docs[21] = docs[1].replace("anla", "anle")  # near copy
    docs[22] = prose(8, 22) + "\n" + passage
    docs[23] = prose(8, 23) + "\n" + passage
    docs[24] = prose(8, 24) + "\nwrite to jan.doe@mail.example.com now"
    docs[25] = "junk$$$ word%%% " * 20
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(30, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    pii._TRAINED[()] = pii.train(n_texts=300, steps=60, rows=48)
    try:
        seen = {}
        now = df
        for name, stage in pipeline.STAGES:
            now = stage(spark, now, None)
            now = spark.createDataFrame(now.collect(), now.schema)
            seen[name] = {x["doc_id"]: x for x in now.collect()}
            if name != pipeline.STAGES[-1][0]:
                assert now.columns == df.columns
    finally:
        pii._TRAINED.clear()
    assert set(seen["quality_rules"]) == set(docs) - {25}
    lines = seen["line_dedup"]
    assert 20 not in lines and passage in lines[22]["text"] and lines[23]["text"] == prose(8, 23) and lines[23]["n_chars"] == len(prose(8, 23))
    assert set(range(12)) <= set(seen["near_duplicates"])
    assert "<EMAIL>" in seen["personal_data"][24]["text"]
    assert set(seen["length_buckets"]) == set(seen["personal_data"])


def test_pipeline_equals_brute_force(spark):
    """Each stage on all that its predecessor kept, with repeated rows, null ids and columns named as the operators' own."""
    import corpus_pipeline as pipeline
    from weft.llm import pii, quality, tokenfile
    from weft.llm.common import WordHashes

    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(400)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(4, 30))) for _ in range(60)]
    docs = [(i, "\n".join(r.choice(lines) if r.random() < 0.3 else " ".join(r.choices(words, k=r.randint(3, 25))) for _ in range(r.randint(1, 12)))) for i in range(90)]
    docs += [(100 + i, " ".join(w if r.random() > 0.01 else "changed" for w in t.split(" "))) for i, t in docs[:40]]
    docs += [(200, docs[3][1]), (201, "mail a.b@c.example.com or +1 (555) 010-2030, " + docs[5][1]), (202, None), (203, ""), (204, "up UP UP! " * 30), (205, "bad % $ " * 40)]
    names = ["_row", "row", "_k", "_h", "h", "n_deleted", "n_email", "spans", "fail_bits"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, -1, *[f"{n}{i}" for n in names]) for i, t in docs + docs[:3]]
    df = spark.createDataFrame(rows, schema).repartition(3)

    seen, now = {}, df
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, None)
        now = spark.createDataFrame(now.collect(), now.schema)
        seen[name] = sorted(now.collect(), key=lambda g: g["doc_id"])
        assert name == "length_buckets" or now.columns == df.columns and all(g[n] == f"{n}{g['doc_id']}" for g in seen[name] for n in names)
    text = lambda name: [(g["doc_id"], g["text"]) for g in seen[name]]

    passed = [(i, t) for i, t in sorted(docs + docs[:3], key=lambda x: x[0]) if not quality.failed_bits(quality.measure(t, WordHashes()))]
    assert text("quality_rules") == passed and 0 < len(passed) < len(docs)
    once = sorted(set(passed))
    left = [(i, new) for (i, old), new in zip(once, brute_maximal(once, 50)) if new == old or new]
    assert sorted(set(text("line_dedup"))) == left and left != once
    labels = brute_groups([t for _, t in left], 5, 80, 100)[0]
    assert text("near_duplicates") == [x for k, x in enumerate(left) if labels[k] == k] and len(set(labels)) < len(left)
    found = dict(text("personal_data"))
    for i, t in text("near_duplicates"):
        base = pii.base_spans(t)
        assert found[i] == t if not base else all(t[a:b] not in found[i] and f"<{kind.upper()}>" in found[i] for kind, a, b in base)
    encoder = tokenfile.WordEncoder(tokenfile.vocabulary_path())
    sizes = {i: len(encoder.encode_batch([t])[0]) for i, t in found.items()}
    assert {g["doc_id"]: g["n_tokens"] for g in seen["length_buckets"]} == sizes
    bounds = sorted({g["padded_to"] for g in seen["length_buckets"]})
    assert all(g["padded_to"] == min(b for b in bounds if b >= g["n_tokens"]) for g in seen["length_buckets"])

    now = df.limit(0)
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, None)
        assert now.count() == 0
        now = now if name == "length_buckets" else spark.createDataFrame([], df.schema)


def test_packing_without_rows(spark):
    df = spark.createDataFrame([(1, "a b", "p"), (2, None, "q")], "doc_id long, text string, n_tokens string")
    assert sorted((g["doc_id"], g["n_tokens"]) for g in packing.token_lengths(df).collect()) == [(1, 2), (2, 0)]
    assert packing.token_lengths(df.limit(0)).count() == 0 and packing.pack(packing.token_lengths(df.limit(0))).count() == 0


def test_join_edges(spark):
    """No rows, equal rows, a null id, a very long text, and columns of other operators' names."""
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(4, long, "a"), (2, long + " end", "b"), (None, long, "c"), (7, "own words here", "d"), (7, "own words here", "d"), (7, "other words there", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = sorted(((g["doc_id"], g["n_shingles"], g["component_id"]) for g in jaccard.groups(df, 3, 90, 100).collect()), key=str)
    assert got == sorted([(4, 119_998, 2), (2, 119_999, 2), (None, 119_998, 2), (7, 1, 7), (7, 1, 7), (7, 1, 7)], key=str)
    assert jaccard.groups(df.limit(0)).count() == 0
