"""Encoding, rules, token files, personal data and language identification, mostly without Spark."""

import io
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import bpe, langid, packing, pii, quality, tokenfile
from weft.llm.common import WordHashes

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "  a  b ", "\n\n x", "<|endoftext|>hi <|endoftext|>  <|endoftext|>", "a" * 3000, "ab" * 2000, "  " * 50 + "x", "don't I'll we'VE", "\t\tfoo\x0bbar \x1cq\x85z", "日本語 한국어 ١٢٣", "\U0001f468‍\U0001f469 ½ⅷ", "x \n", "\r\n\r\n", "é ́x \xa0foo　bar", "İstanbul ΣΑΣ’s"]


def random_texts(n, seed=0):
    r = random.Random(seed)
    letters = [chr(i) for i in range(32, 127)] + list("  \n\t éßñ中́ 😀½²")
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(n)]


def test_bpe_equals_the_library():
    path = bpe.vocabulary_path()
    library, mine = tokenizers.Tokenizer.from_file(path), bpe.Codec(path, most=500)
    texts = ODD + random_texts(1500)
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text) == e.ids
        assert mine.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    assert mine.encode(None) == []
    cut = mine.encode("日本語")[:-1]
    assert mine.decode(cut) == library.decode(cut, skip_special_tokens=False)


def test_bpe_equals_the_library_among_white_space():
    """Runs of white space of any kind, which a space may begin, end or part."""
    path = bpe.vocabulary_path()
    library, mine = tokenizers.Tokenizer.from_file(path), bpe.codec(path)
    blanks = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    r = random.Random(6)
    texts = ["_ \xa0 \xa0", "22 \xa0 \xa0", "a\n \nb", " \u3000 x"]
    texts += ["".join(r.choices([*blanks, *[" "] * 25, *"ab1.'é中"], k=r.randint(1, 25))) for _ in range(60_000)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text) == e.ids, text


def test_automaton_lists_every_piece_that_ends():
    r = random.Random(2)
    pieces = {"".join(r.choices("ab", k=r.randint(1, 5))): i for i in range(25)}
    machine, text, state = bpe.Automaton(pieces), "".join(r.choices("abc", k=400)), 0
    for end, c in enumerate(text, 1):
        state = machine.step(state, c)
        assert list(machine.ends[state]) == [(n, pieces[text[end - n : end]]) for n in range(min(end, 5), 0, -1) if text[end - n : end] in pieces]


def test_bpe_rows(spark):
    """Equal rows, a very long text and columns of the operator's own names."""
    long = "lorem ipsum, dolor \xa0 sit " * 40_000 + "x" * 50_000
    df = spark.createDataFrame([(1, long, "n"), (2, "a b", "m"), (2, "a b", "m"), (2, "a b", "k")], "doc_id long, text string, n_tokens string")
    rows = bpe.digests(df).orderBy("doc_id").collect()
    assert len(rows) == 4 and len(set(rows[1:])) == 1 and rows[0]["n_tokens"] == len(bpe.codec(bpe.vocabulary_path()).encode(long))
    back = bpe.decode(bpe.encode(df, ids="n_tokens"), ids="n_tokens").orderBy("doc_id").collect()
    assert back[0]["decoded"] == long and len(back) == 4


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 8), (None, "", 9)], "doc_id long, text string, ids long")
    rows = bpe.decode(bpe.encode(df)).collect()
    assert [r["decoded"] for r in rows] == ["hello world", "", ""] and rows[0]["ids"] == bpe.codec(bpe.vocabulary_path()).encode("hello world")
    assert bpe.digests(df.limit(0)).count() == 0


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, repeated = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated |= {p + k for p in places for k in range(8)}
    lines, dup, before = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_quality_measures():
    r = random.Random(1)
    texts = [None, "", "\n", "a b\na b\n c", "x " * 40] + [" ".join(r.choice("abc") + r.choice(("", "", "\n", "#")) for _ in range(r.randint(1, 120))) for _ in range(200)]
    for text in texts:
        m = quality.measure(text, WordHashes())
        assert tuple(m[n] for n in quality.MEASURES[:5]) == brute_measures(text)


def test_quality_ledger(spark):
    good = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, good), (2, None), (3, "X!! " * 30), (4, good.replace(" ", "%%% ")), (1, good)], "doc_id long, text string")
    rows = quality.with_policy(quality.ledger(df))
    assert sorted((r["doc_id"], r["kept"]) for r in rows.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    found = {r["rule"]: r.asDict() for r in quality.ablations(rows).collect()}
    assert found["few_words"]["n_failed_alone"] == 1 and found["symbols"]["n_kept_without"] == 3 and found["symbols"]["n_docs"] == 5
    assert quality.ledger(df.limit(0)).count() == 0


def test_ledger_edges(spark):
    text = "a few words of it. " * 50_000
    df = spark.createDataFrame([(1, text, "u"), (None, "x", "v")], "doc_id long, text string, source string")
    rows = {r["source"]: r for r in quality.ledger(df, keep=("source",)).collect()}
    assert rows["u"]["n_words"] == 250_000 and rows["u"]["n_repeat_words"] == 250_000 and rows["v"]["doc_id"] is None
    with pytest.raises(ValueError):
        quality.ledger(df.withColumnRenamed("source", "n_words"), keep=("n_words",))


def test_frames():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 50, 3000, 0, 7, 1000)]
    sink = io.BytesIO()
    writer = tokenfile.FrameWriter(sink, frame_ids=64)
    for d in docs:
        writer.add(d)
    writer.close()
    import pyarrow as pa

    data = sink.getvalue()
    reader = tokenfile.FrameReader(pa.BufferReader(data))
    assert len(reader) == len(docs)
    for i in (3, 0, 6, 1, 5, 2, 4):
        assert np.array_equal(reader.document(i), docs[i])
    spoiled = bytearray(data)
    spoiled[12] ^= 255
    with pytest.raises(Exception):
        for i in range(len(docs)):
            tokenfile.FrameReader(pa.BufferReader(bytes(spoiled))).document(i)
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(-1) for _ in (0,))
    assert whole == np.concatenate(docs).astype("<u4").tobytes()


def test_word_encoder_equals_the_library():
    path = tokenfile.vocabulary_path()
    library, mine = tokenizers.Tokenizer.from_file(path), tokenfile.WordEncoder(path, most=500)
    texts = ODD + random_texts(800, 5)
    got = mine.encode_batch(texts)
    assert all(list(a) == e.ids for a, e in zip(got, library.encode_batch(texts, add_special_tokens=False)))


def test_length_counter_equals_the_library():
    path = tokenfile.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    marked = ["Straße&&& ÉCOLE|||, the THE. The<|> a×b ÷ ǅ\u212a <|ENDOFTEXT|> x<|endoftext|>y, it's its' e\u0301te\u0338= <\u0338", None, "w|<|"]
    texts = marked + ODD + random_texts(800, 6)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    counter = packing.LengthCounter(path, most=500)
    assert counter.by_form and counter.letters is not None
    plain, whole = packing.LengthCounter(path, most=500), packing.LengthCounter(path, most=500)
    plain.letters, whole.by_form, whole.letters = None, False, None  # vocabularies of other steps, and those that part words otherwise
    for one in (counter, plain, whole):
        got = [n for i in range(0, len(texts), 90) for n in one.count(pa.array(texts, pa.string()).slice(i, 90)).tolist()]
        assert got == want and one.elder and len(one.known) + len(one.elder) < 3000
    assert counter.count(pa.array([None, None], pa.string())).tolist() == [0, 0] and not len(counter.count(pa.array([], pa.string())))


def test_packing_learns_a_word_once_for_all_its_forms():
    """Texts of many forms of few words: packing's lengths take a small part of the encoder's CPU time, as ids are not written."""
    r, path = random.Random(3), tokenfile.vocabulary_path()
    words = ["".join(r.choice("aeinrstlo") for _ in range(r.randint(4, 12))) for _ in range(20_000)]
    texts = pa.array([" ".join(r.choice((str, str.capitalize))(r.choice(words)) + r.choice(("", ",", ".", "&&&")) for _ in range(400)) for _ in range(512)], pa.string())
    counter, encoder = packing.LengthCounter(path), tokenfile.WordEncoder(path)
    seconds, found = [], []
    for count in (counter.count, lambda t: [len(ids) for ids in encoder.encode_batch(t.to_pylist())]):
        at = time.process_time()
        found.append(list(count(texts)))
        seconds.append(time.process_time() - at)
    assert found[0] == found[1]
    assert len(counter.known) <= len(set(words)) + 10
    assert seconds[0] < 0.7 * seconds[1], seconds


def test_token_files_end_to_end(spark, tmp_path):
    """The query's rows are those of the library's own ids, in ascending order of ids, a very long text and equal rows included."""
    rows = [(7, "One two, THREE"), (3, None), (5, "lorem  ipsum\tdolor\n" * 30_000), (4, "x y"), (4, "x y"), (9, ""), (1, "日本 é <|endoftext|> z")]
    spark.createDataFrame([(*x, "s", i) for i, x in enumerate(rows)], "doc_id long, text string, file string, place int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, tokenfile.op3_tokenfile(spark, str(tmp_path)).collect()))
    library, want, at = tokenizers.Tokenizer.from_file(tokenfile.vocabulary_path()), [], 0
    for key, text in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_only_vocabularies_that_drop_white_space():
    with pytest.raises(ValueError):
        tokenfile.WordEncoder(bpe.vocabulary_path())


def test_token_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["b a", None, "", "c " * 500, "b a", "日本"])] + [(3, "again"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = tokenfile.write_files(df, str(tmp_path / "ids"), files=3)
    got = sorted(tokenfile.with_starts(tokenfile.read_files(manifest)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, 4, 5]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = {r["doc_id"]: r["ids"] for r in tokenfile.read_ids(manifest.where("doc_id in (0, 1)")).collect()}
    assert ids[1] == [1] and ids[0][-1] == 1
    assert next(r for r in got if r["doc_id"] == 0)["ids_crc32"] == zlib.crc32(np.array(ids[0], "<u4").tobytes())
    assert tokenfile.write_files(df.limit(0), str(tmp_path / "none"), files=2).count() == 0


# --- personal data -------------------------------------------------------------------------------


def brute_base(text):
    def spans(pattern, fine):
        return [(m.start(), m.end()) for m in re.finditer(pattern, text) if fine(m[0])]

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", a, b) for a, b in spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)]
    out += [("ip", a, b) for a, b in spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))]
    out += [("card", a, b) for a, b in spans(r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)))]
    return out + [("phone", a, b) for a, b in spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]


def test_base_spans():
    r = random.Random(2)
    texts = ["a@b.com@c.org x@y z@w.", "1.2.3.4.5.6.7.8 256.1.1.1 01.2.3.004", "4111 1111 1111 1111 5", "+1 (578) 555-6437 4918187128635271", "+1", ""]
    texts += ["".join(r.choice("ab@.-+ 0123459()\n") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans(None) == [] and pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def test_gradients():
    net, r = pii.Network(hidden=3, embed=4), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text, labels = pii.SpanMaker(5).text()
    classes = pii.classes_of(text)[:20][None]
    gold, near = labels[:20].astype(np.int64)[None], pii.possible(text, pii.classes_of(text))[:20][None]
    if gold[0, 0] and gold[0, 0] % 2 == 0:
        gold[0, 0] = 0
    _, grad = net.gradients(classes, gold, near)
    for name in net.p:
        at = tuple(r.integers(0, s) for s in net.p[name].shape)
        old, step, loss = net.p[name][at], 1e-3, []
        for d in (step, -step):
            net.p[name][at] = old + d
            loss.append(net.gradients(classes, gold, near)[0])
        net.p[name][at] = old
        assert abs((loss[0] - loss[1]) / (2 * step) - grad[name][at]) < 2e-2, name


@pytest.fixture(scope="module")
def net():
    return pii.trained()


def test_model_on_held_out_texts(net):
    maker, hit, found, gold = pii.SpanMaker(99), 0, 0, 0
    texts = [maker.text() for _ in range(150)]
    for (text, labels), got in zip(texts, pii.labels_of(net, [t for t, _ in texts])):
        want, mine = set(pii.model_spans(text, labels)), set(pii.model_spans(text, got))
        hit, found, gold = hit + len(want & mine), found + len(mine), gold + len(want)
    assert hit / found > 0.97 and hit / gold > 0.93


def test_joined_scores_have_one_best_path():
    """The decoder's labels are the best of all sequences between outside labels."""
    net, r = pii.Network(hidden=2, embed=2), np.random.default_rng(3)
    net.p["change"] = r.normal(size=(pii.LABELS, pii.LABELS)).astype(np.float32)
    a = net.p["change"] + pii.ALLOWED
    runs = [r.normal(size=(n, pii.LABELS)).astype(np.float32) for n in (1, 3, 4, 2, 4)]
    for scores, got in zip(runs, net.decode(runs)):
        paths = itertools.product(range(pii.LABELS), repeat=len(scores))
        best = max(paths, key=lambda y: sum(scores[t, k] for t, k in enumerate(y)) + sum(a[p, q] for p, q in zip((0, *y), (*y, 0))))
        assert tuple(got) == best


def test_spans_lie_where_labels_are_allowed(net):
    """No valid span of any length touches a forbidden character; scores are joined over many windows."""
    name, digits = "n" * 500, "4" + " - " * 60 + "111 1111 1111 1111"
    text = f"mail {name}@{'d' * 300}.com, 中文 4 111-1111 (1111) 1111 or {digits} é"
    may = pii.possible(text, pii.classes_of(text))
    for piece in (f"{name}@{'d' * 300}.com", "4 111-1111 (1111) 1111", digits):
        at = text.index(piece)
        assert may[at : at + len(piece)].all()
    assert not may[:5].any() and not may[-1]
    labels = pii.labels_of(net, [None, text, "", "no such thing", "x 7"])
    assert labels[0] is None and labels[2] is None and labels[3] is None and len(labels[1]) == len(text) and not labels[1][~may].any()


def test_windows_do_not_depend_on_place(net):
    """A long text's spans are those of its parts: overlapping windows are reconciled for the whole text."""
    part = "word and more words then jan.doe@mail.example.com went by. " + "filler text of no note " * 8
    text = part * 40
    labels = pii.labels_of(net, [text])[0]
    spans = pii.all_spans(text, pii.base_spans(text), labels)
    assert [s[1] for s in spans if s[0] == "email"] == [text.index("jan") + i * len(part) for i in range(40)]
    assert pii.masked("a 1.2.3.4 b", [("ip", 2, 9)]) == "a <IP> b"


def test_pii_columns(spark, net):
    df = spark.createDataFrame([(1, "mail a.b@c.example.com now", "x"), (2, None, "y"), (3, "", "z"), (1, "mail a.b@c.example.com now", "x")], "doc_id long, text string, spans string")
    rows = pii.find(df, net, mask=True).collect()
    assert [r["n_email"] for r in rows] == [1, 0, 0, 1] and rows[0]["text"] == "mail <EMAIL> now" and rows[0]["spans"] == "email:5:22" and rows[1]["text"] is None
    assert pii.find(df.limit(0), net).count() == 0


# --- languages -----------------------------------------------------------------------------------


def invented(lang, r, n):
    parts = {"aa": ("an", "re", "th", "ing"), "bb": ("ou", "eau", "é", "le"), "cc": ("sch", "ein", "ü", "ung")}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language_accuracy():
    r = random.Random(4)
    rows = [(invented(x, r, r.randint(5, 60)), x) for x in ("aa", "bb", "cc") for _ in range(60)]
    model = langid.fit([t for t, _ in rows], [x for _, x in rows])
    held = [(invented(x, r, r.randint(5, 60)), x) for x in ("aa", "bb", "cc") for _ in range(50)]
    names, scores = model.predict([t for t, _ in held])
    assert np.mean([a == b for a, (_, b) in zip(names, held)]) > 0.98 and all(0 <= s <= 1 for s in scores)
    assert model.predict([None, "", "12 3!", "\n"]) == (["und"] * 4, [0.0] * 4)


def test_folded_scores_are_kernel_scores():
    """The model's values are those of weighted kernel ridge regression over sets of n-grams, solved apart from it."""
    r = random.Random(5)
    texts = [invented(x, r, 20) for x in ("aa", "bb", "cc") for _ in range(6)][:-2]
    langs = ["aa"] * 6 + ["bb"] * 6 + ["cc"] * 4
    new = [invented(x, r, 15) for x in ("aa", "cc", "bb")] + [texts[0]]
    sets = [set(langid.bins_of(t).tolist()) for t in texts + new]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    n = len(texts)
    values, vectors = np.linalg.eigh(kernel[:n, :n])  # every text is a landmark
    kept = values > 1e-6 * values.max()
    features = kernel[:, :n] @ (vectors[:, kept] / np.sqrt(values[kept]))
    weight = np.array([n / (3 * langs.count(x)) for x in langs])
    want = []
    for name in ("aa", "bb", "cc"):
        # least squares with an own column for the bias, which is not shrunk
        a = np.hstack((features[:n], np.ones((n, 1)))) * np.sqrt(weight)[:, None]
        shrink = np.hstack((np.sqrt(langid.RIDGE) * np.eye(features.shape[1]), np.zeros((features.shape[1], 1))))
        y = np.concatenate((np.array([x == name for x in langs]) * np.sqrt(weight), np.zeros(features.shape[1])))
        solved = np.linalg.lstsq(np.vstack((a, shrink)), y, rcond=None)[0]
        want.append(features[n:] @ solved[:-1] + solved[-1])
    model = langid.fit(texts, langs)
    assert np.allclose(model.scores(new), np.array(want).T, atol=2e-3)
    assert np.allclose(model.scores(new, block=2), model.scores(new), atol=1e-5)


def test_held_out_rows_teach_nothing(spark, tmp_path):
    """The query's rule: rows whose crc32 of the id leaves 2 are predicted only, so their labels may be anything."""
    r = random.Random(6)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(80)]
    rows = [(i, invented(x, r, 25), "zz" if held[i] else x, "s") for i, x in enumerate(["aa", "bb"] * 40)] + [(80, "word " * 100_000, None, "s"), (None, None, "aa", "s"), (0, "same id", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = langid.op5_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(g["held_out"] == held[g["doc_id"]] for g in got if g["doc_id"] is not None and g["doc_id"] < 80)
    assert all(g["lang_pred"] == ("aa", "bb")[g["doc_id"] % 2] for g in got if g["doc_id"] and g["doc_id"] < 80)
    with pytest.raises(ValueError):
        langid.predict(spark.createDataFrame(rows, "doc_id long, text string, score string, source string"), None, keep=("score",))


def test_language_columns(spark):
    r = random.Random(6)
    rows = [(i, invented(x, r, 20), x) for i, x in enumerate(["aa", "bb"] * 20)] + [(40, None, None), (41, "77", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(*langid.sample(df, "doc_id", "text", "lang")), keep=("doc_id", "lang")).collect()
    assert all(g["lang_pred"] == (g["lang"] if g["doc_id"] < 40 else "und") for g in got)
    none = langid.fit(*langid.sample(df.limit(0), "doc_id", "text", "lang"))
    assert {g["lang_pred"] for g in langid.predict(df, none).collect()} == {"und"}


def test_any_number_of_languages(spark):
    """Rare or dirty labels stop nothing: three hundred values, each fitted."""
    r = random.Random(4)
    words = {f"l{i}": ["".join(chr(0x4E00 + r.randrange(9000)) for _ in range(3)) for _ in range(6)] for i in range(300)}
    rows = [(k, " ".join(r.choices(words[n], k=12)), n) for k, n in enumerate([*words] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.sample(df, "doc_id", "text", "lang")
    assert set(langs) == set(words) and max(langs.count(x) for x in words) == 3
    got = langid.predict(df, langid.fit(texts, langs), keep=("doc_id", "lang")).collect()
    assert len(got) == len(rows) and len({g["lang_pred"] for g in got}) > 200
