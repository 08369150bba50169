import hashlib
import random
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest

from tessera.llm import chat, decontaminate, lattice_lm, secrets, toxicity

SF = "/root/testdata/sf0.001"


# op10 -----------------------------------------------------------------------------------------------------------


def slow_base(text):
    text, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    hexes, live = "0123456789abcdef" * 3, "aZ9" * 10
    texts = [None, "", "no", f"token={hexes}", f"PassWord: '{hexes}' x", "secret=token: abcdefgh", "token=abc", "api_key==abcdefg apikey:abcdefg", "🙂é AKIA" + "A1" * 8 + " AKIAAKIA" + "B2" * 10, hexes[:23] + "g" + hexes[:24],
             live, f"🙂 {live}, é {live}x", "tokentoken = \"0000000\"", "password = = x", "x" * 30000 + " passwd=" + "y" * 30000, "example" + live, "ſecret=abcdefgh toKen=abcdefgh"]
    rnd = random.Random(4)
    texts += ["".join(rnd.choices(["token", "=", " ", "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "'", "secret", ":", "é", hexes], k=12)) for _ in range(60)]
    rows = [(i, t, f"s{i % 5}" if i % 7 else None, "q") for i, t in enumerate(texts)] + [(1000 + i, "dup aZ9" + "bY8" * 8, f"s{i}", "q") for i in range(4)] + [(5, texts[5], "s0", "q"), (5, texts[5], "s0", "q"), (None, live, "s1", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, sig string").repartition(4)
    got = secrets.scan(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _, _ in rows:
        base = slow_base(t)
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        want.setdefault(i, []).append((*(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(shown.encode()).hexdigest()))
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want[r.doc_id], r
    by = {r.doc_id: r for r in got}
    assert by[10].spans == "owned:0:30" and by[11].spans.startswith("owned:2:32")
    assert all(by[1000 + i].spans == "" for i in range(4)) and by[15].spans == ""
    assert secrets.scan(docs.limit(0)).count() == 0
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "source").toPandas()
    con.register("documents", frame)
    sql = con.sql(secrets.ORACLES["op10_secrets"]).df()
    show = lambda rows: sorted(map(repr, rows))
    cols = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example"]
    assert show([tuple(r[c] for c in cols) for r in got]) == show(sql[cols].astype({c: object for c in cols}).itertuples(index=False, name=None))


# op3 ------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (4, 0, "user", "ab"), (5, 0, "user", "a"), (5, 1, "assistant", "x"),
            (6, 2, "user", "c"), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (7, 0, None, None), (8, 0, "", None), (9, None, "user", "z"), (9, 1, "user", "y"), (None, 0, "user", "a"), (None, 1, "tool", "t")]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, hashes string")
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert set(got) == {2, 4, 5, 7, 8, 9, None}
    assert got[2].n_copies == 2 and got[2].n_turns == 3 and got[9].rendered.startswith("<|im_start|>user\nz<|im_end|>\n")
    assert chat.format_chats(turns.limit(0)).count() == 0


# op9 ------------------------------------------------------------------------------------------------------------


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    best = min(row)
    return best, row.index(best)


def test_myers_is_the_edit_distance():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = "".join(rnd.choices("abc", k=rnd.randint(1, 90))), "".join(rnd.choices("abc", k=rnd.randint(0, 120)))
        assert decontaminate.myers(decontaminate.bits(a), len(a), b) == slow_distance(a, b)


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_decontaminate(spark, block):
    rnd = random.Random(block)
    vocab = ["".join(rnd.choices("etaoin", k=rnd.randint(2, 7))) for _ in range(50)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(8, 40)))) for i in range(12)] + [(50, None), (51, " "), (None, "x"), (52, "Ok")]
    docs = [(0, None), (1, ""), (2, "ok")]
    for i in range(3, 40):
        text = rnd.choice(items[:12])[1].upper().replace(" ", " \n")
        for _ in range(rnd.randint(0, 14)):
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice(["", "q", "qq", "z"]) + text[at + rnd.randint(0, 1) :]
        docs.append((i, " ".join(rnd.choices(vocab, k=30)) + " " + text + " " + " ".join(rnd.choices(vocab, k=30))))
    docs += [(39, docs[39][1]), (None, docs[39][1])]
    frame, bench = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, distance int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame, bench, block_bytes=block).collect()}
    want = {}
    for i, t in dict(docs).items():
        for j, x in items:
            item, text = decontaminate.normal(x), decontaminate.normal(t)
            if item and i is not None and j is not None and text:
                d, _ = slow_distance(item, text)
                if d <= decontaminate.budget(len(item)):
                    want[i, j] = d
    assert {k: r.distance for k, r in got.items()} == want and 10 < len(want)
    for (i, j), r in got.items():
        text, item = decontaminate.normal(dict(docs)[i]), decontaminate.normal(dict(items)[j])
        assert slow_distance(item, text[r.start : r.end])[0] == r.distance
    kept = decontaminate.keep_clean(frame, bench, block_bytes=block)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs[:-1]} - {i for i, _ in want}
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0 == decontaminate.contaminated(frame, bench.limit(0)).count()


# op2 ------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    vocab = lattice_lm.vocabulary(lattice_lm.default_vocabulary())
    logp, ids = vocab.first_scores(), {}
    import base64

    with open(lattice_lm.default_vocabulary(), "rb") as f:
        for k, line in enumerate(f):
            ids[base64.b64decode(line.split()[0])] = k
    words = ["the", "a", "naïve", "thtion", "zzzzzzz", "o" * 90]
    for word, got in zip(words, lattice_lm.word_scores(vocab, logp, words)):
        raw = b" " + word.encode()
        alpha = [0.0] + [-np.inf] * len(raw)
        for j in range(1, len(raw) + 1):
            alpha[j] = np.logaddexp.reduce([alpha[i] + logp[ids[raw[i:j]]] for i in range(j) if raw[i:j] in ids])
        assert got == pytest.approx(alpha[-1])
        if len(raw) < 9:
            every = [cut for n in range(len(raw)) for cut in combinations(range(1, len(raw)), n)]
            paths = [[raw[a:b] for a, b in zip((0, *c), (*c, len(raw)))] for c in every]
            assert got == pytest.approx(np.logaddexp.reduce([sum(logp[ids[x]] for x in p) for p in paths if all(x in ids for x in p)]))
    # expected counts of a word spell the word
    total = lattice_lm.expected(vocab, logp, words[:5], np.ones(5))
    size = np.zeros(vocab.n)
    for data, k in ids.items():
        size[k] = len(data)
    assert total @ size == pytest.approx(sum(len(w.encode()) + 1 for w in words[:5]))


@pytest.mark.parametrize("common", [100_000, 3])
def test_base_scores(spark, common):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("abcé", k=3)) for _ in range(40)]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 30))) + rnd.choice(["", " Rare%d" % i])) for i in range(60)] + [(None, None), (5, "twice"), (5, "twice"), (61, None)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    from collections import Counter

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    got = lattice_lm.score(docs, common=common, rounds=1).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    again = {(r.doc_id, r.n_tokens): r.score for r in lattice_lm.score(docs, common=50, rounds=1).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score) for r in got if r.doc_id != 5)


@pytest.mark.parametrize("common", [1000, 3])
def test_scores_match_brute_force(spark, common, monkeypatch):
    monkeypatch.setattr(lattice_lm, "_TEXT", 40)
    rnd = random.Random(19)
    vocab = ["".join(rnd.choices("abcé", k=rnd.randint(1, 4))) for _ in range(40)]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 60))) + rnd.choice(["", "\tRare%d" % i, "\u00a0x"])) for i in range(40)] + [(7, None), (None, "a"), (3, "a " * 3000)]
    docs = spark.createDataFrame([(*r, 0.0, "w") for r in rows], "doc_id long, text string, score double, word string")
    from collections import Counter

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, seen = sum(counts.values()), 1 - sum(c == 1 for c in counts.values()) / sum(counts.values())
    path, vocabulary = lattice_lm.default_vocabulary(), lattice_lm.vocabulary(lattice_lm.default_vocabulary())
    logp, end = lattice_lm.fit(spark.createDataFrame([(bytearray(w.encode()), c, c) for w, c in counts.items()], "word binary, c long, t long"), path, rounds=1)

    def of(word):  # the pieces' own sums are held against all segmentations in another test
        pieces = float(lattice_lm.word_scores(vocabulary, logp, [word])[0]) + end
        return np.log10(seen * counts[word] / n + (1 - seen) * np.exp(pieces))

    want = sorted((repr(i), len(tokens(t)), round(sum(map(of, tokens(t))), 6)) for i, t in rows)
    got = lattice_lm.score(docs, common=common, rounds=1).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == want


def test_lm_without_training_rows(spark):
    assert lattice_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lattice_lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score < 0


# op5 ------------------------------------------------------------------------------------------------------------


def test_kernel_counts_gapped_subsequences():
    rnd = random.Random(8)
    for _ in range(30):
        s, t = ("".join(rnd.choices("abc", k=rnd.randint(3, 8))) for _ in range(2))
        weigh = lambda x: [(tuple(x[i] for i in c), toxicity.DECAY ** (c[-1] - c[0] + 1)) for c in combinations(range(len(x)), toxicity.P)]
        want = sum(p * q for a, p in weigh(s) for b, q in weigh(t) if a == b)
        assert toxicity.ssk(toxicity.codes([s]), toxicity.codes([t])[:, : len(t)])[0] == pytest.approx(want)


def test_gaps_in_every_place_keep_an_insult_near(monkeypatch):
    model = toxicity.Model(["stupid", "idiot", "worthless"])
    words = ["stuxpid", "sxtxuxpxixd", "ixdxixoxt", "i1d2i3o4t", "wxoxrxtxhxlxexsxs", "studied", "outside", "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    near = model.similarities(words).max(axis=1)
    assert near[:5].min() > 0.8 and near[5:].max() < 0.5
    rnd = random.Random(4)
    some = ["".join(rnd.choices("idotx", k=rnd.randint(1, 12))) for _ in range(3000)] + ["i" + "".join(rnd.choices("idot", k=rnd.randint(1, 8))) + "t" for _ in range(500)]
    got = model.similarities(some)
    monkeypatch.setattr(toxicity.Bound, "rows", lambda self, c: np.arange(len(c)))
    assert (got == model.similarities(some)).all()  # the bound only saves work


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(*toxicity.sample(docs, labels))
    got = toxicity.score(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").where("held_out").collect()
    right = [(r.predicted, r.toxic) for r in got]
    # sf0.1 has few examples of the inflected insults; with check-size labels 425 of 427 are found
    assert sum(p and t for p, t in right) / sum(t for _, t in right) > 0.75
    assert sum(p and not t for p, t in right) / sum(not t for _, t in right) < 0.02
    scores = model.scorer()
    clean = "the and of thing erth onnd. "
    assert max(scores([clean, "", None])) < 0.1
    assert min(scores([clean + w + " the." for w in ("idiot", "i.d.i.o.t", "i d i o t", "stuxpid", "wor-thless")])) > 0.5
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "IDIOT", 3.0), (2, "x " * 100000, 0.0)], "doc_id long, text string, score double")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(*toxicity.sample(docs, labels))).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), toxicity.train([], [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len(rows) < len(docs) and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest()
    texts = [re.sub(r"\s", "", docs[r.doc_id].text) for r in rows]
    assert len(set(texts)) == len(texts)
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in decontaminate.normal(docs[r.doc_id].text) for r in rows for b in bench)


def test_toxicity_scores_do_not_depend_on_other_texts():
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghijk", k=rnd.randrange(3, 9))) for _ in range(200)]
    insults = ["stupid", "idiot", "worthless", "moron"]
    text = lambda bad: " ".join(w + rnd.choice(["", "", ".", "!"]) for w in rnd.choices(words, k=30) + ([rnd.choice(insults)] * 2 if bad else []))
    texts, labels = map(list, zip(*[(text(i % 2), i % 2) for i in range(200)]))
    model = toxicity.train(texts, labels, rounds=60)
    more = [text(i % 3 == 0) for i in range(120)] + ["Nothing here. You idiot.", "idiot", "", None]
    whole = model.scorer()(more)
    single = [model.scorer()([t])[0] for t in more]
    turned = model.scorer()(more[::-1])[::-1]
    assert np.allclose(whole, single) and np.allclose(whole, turned)
    assert whole[-4] > 0.5 and whole[-1] == whole[-2] < 0.5
