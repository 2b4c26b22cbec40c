"""Training-data operators against brute force, on small fixtures with odd rows."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from pixelmill.llm import decontaminate, exact_dedup, html_text, licenses, lm_score, mixing, near_dedup, queries, secrets, token_files, toxicity
from pixelmill.llm.common import table

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, size long, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """The table with odd rows: null and empty texts, nulls in any column, repeated rows, short and long texts, clashing names."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, D, "documents").collect()]
    long = " ".join(f"w{i}" for i in range(30_000))
    rows += [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, None, None, None, None), (9004, "one two", "en", None, 7), (9005, "two one", "en", "src1", 7), (9006, "ONE\ttwo", "en", "src1", 7)]
    rows += [(9007, long, "en", "src2", None), (9008, long + " end", "en", "src2", None), (9009, rows[0][1], "fr", "src3", 1), (9010, rows[0][1], "fr", "src3", 1), (None, "no id here at all", None, None, None)]
    return spark.createDataFrame([(*r, "k", 1, 2, "d") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_exact(docs, texts, empty):
    keep = defaultdict(list)
    for d, t in texts.items():
        keep[t].append(d)
    for r in exact_dedup.exact_dedup(docs).collect():
        group = keep[texts[r.doc_id]]
        assert r.group_size == len(group) and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.keep_id == max((d for d in group if d is not None), default=None) and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_dedup(empty).count() == 0


def components(sets, percent=85):
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for a, s in sets.items():
        for b, n in Counter(b for x in s for b in where[x] if b > a).items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in sets}


def test_near(docs, texts, empty):
    sets = {d: shingles(t) for d, t in texts.items() if d is not None}
    want = components(sets)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_chains(spark):
    """Chains and stars near the threshold, where one pivot doesn't reach all members."""
    r = np.random.default_rng(11)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 5):
            w[r.integers(0, 140)] = f"x{r.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(40):
        rows.append((100 + k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 150))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components({d: shingles(t) for d, t in rows})
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()} == want


def test_near_form_letters(spark, monkeypatch):
    """Buckets of many texts that share a template but don't link, with some linked pairs among them: found by prefixes, few pairs looked at."""
    r = np.random.default_rng(5)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(400):
        own = [f"o{k}x{i}" for i in range(40)]
        if k % 10 == 9:  # like the one before, with one word changed
            own = [f"o{k - 1}x{i}" for i in range(40)]
            own[int(r.integers(0, 40))] = f"y{k}"
        rows.append((k, " ".join([*template[:60], *own, *template[60:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components({d: shingles(t) for d, t in rows}, 80)
    assert sum(want[d] != d for d in want) == 40
    looked = []
    linked = near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, *a: looked.append(pairs.count()) or linked(pairs, *a))
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, 80).collect()} == want
    assert sum(looked) < 1_000


def test_near_hot_texts(spark):
    """A third of all rows of one text, a third empty, ids that repeat; the scratch folder keeps the result's table only."""
    import os

    from pixelmill.llm.common import scratch_dir

    rows = [(k, "same words over and over again here") for k in range(100)] + [(1000 + k, "  " if k % 2 else None) for k in range(100)]
    rows += [(5000, "a b c d e f"), (5000, "x y z u v w"), (5000, "a b c d e f"), (5001, "x y z u v w"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = os.path.dirname(scratch_dir(spark))
    before = set(os.listdir(folder))
    got = near_dedup.near_duplicates(df)
    assert len(set(os.listdir(folder)) - before) == 1
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(rows) and Counter(got)[(5000, 2, 5000, True)] == 3 and (5001, 2, 5000, False) in got and (None, 2, None, True) in got
    assert sum(r[2] == 0 for r in got) == 100 and all(r[2] == r[0] and r[3] for r in got if r[0] and 1000 <= r[0] < 2000)


def test_sketch_estimates():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000).astype("<u8")
    for n, shared in ((40, 30), (600, 500), (2000, 1000)):
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared : 2 * n - shared])
        got = (near_dedup.sketch([a])[0] == near_dedup.sketch([b])[0]).mean()
        assert abs(got - shared / (2 * n - shared)) < 0.2
    assert (near_dedup.sketch([pool[:1]]) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_mixing(docs, texts, empty):
    rows = [r for r in docs.select("doc_id", "source").collect()]
    sizes = {r.doc_id: len(WORD.findall(texts[r.doc_id])) for r in rows}
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and all(sizes[None if pd.isna(d) else int(d)] == s for d, s in zip(got.doc_id, got["size"], strict=True))
    per = defaultdict(int)
    for r in rows:
        per[r.source] += sizes[r.doc_id]
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight, left, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(per.values()), {}
    open_ = set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] / total * left > 3 * per[s]]
        for s in full or list(open_):
            want[s] = 3 * per[s] if full else weight[s] / total * left
        if not full:
            break
        left -= sum(want[s] for s in full)
        open_ -= set(full)
    by = {r.doc_id: r.source for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got.itertuples():
        d = None if pd.isna(r.doc_id) else int(r.doc_id)
        assert abs(r.target - want[by[d]]) < 1e-6 and r.taken <= 3 * r.size and r.source_size == per[by[d]]
        taken[by[d]] += r.taken
        largest[by[d]] = max(largest[by[d]], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in order)
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(empty).count() == 0


def test_secrets(docs, texts, empty):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan(docs).collect():
        t = texts[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base = sorted(base + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(joined.split(",")) <= set(r.spans.split(","))
    assert secrets.scan(empty).count() == 0


def test_secret_model():
    model = secrets.train(secrets.labelled_samples(2000, 1))
    held = secrets.labelled_samples(1000, 2)
    right = [(secrets.ratio(model, s) > 0) == bool(y) for s, y in held]
    assert np.mean(right) > 0.97
    assert secrets.find("see https://x.org/get_user_name_by_id_2024 now", model)[1] == []
    assert [k for _, k, _ in secrets.find("key is Zx81kQ9vWq27TnB4yLr0Pd5s!", model)[1]] == [3]
    assert secrets.find("token=token:abcdefgh", model)[0] == []


def test_tokens(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(queries.vocabulary_path())
    files = token_files.write_tokens(docs, queries.vocabulary_path())
    start = 0
    for r in sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r.start):
        ids = [*vocabulary.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert start == sum(s[2] for s in files.shards)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, queries.vocabulary_path())).count() == 0


def test_token_pieces():
    from tokenizers import Tokenizer

    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        content = f.read()
    ids, plain = token_files._Ids(content, "<u2"), Tokenizer.from_str(content)
    odd = ["", "  ", "<|endoftext|>", "a<|ENDOFTEXT|>B x", "J\u030c \u0301a", "\u0130I\u0307 \u03a3\u0391\u03a3", "don't DON'T it's'll", "x\x01y \x01", "\x1c a\x1db\x85c d", "$$$,,a1234b", " x\x00y\x7f", "\u216b \u212a"]
    odd += ["\xb2a\xbc\xaa\xd7\xf7\xc0\xb5\xa0x\x85y \xdf\xff", "Caf\xe9, \xc9L\xc8VE! e\u0301 \u2019s l\u2019a", "x\u00ad\u00b4s \u00a8", "\u043f\u0440\u0418, \u6f22\u5b57\u3000x", "y" * 5_000]
    assert ids.apart
    for text, got in zip(odd, ids.of(odd), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_contamination(spark, docs, texts, empty, monkeypatch):
    bench = table(spark, D, "benchmark").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "one two"), (None, "x y z")], "item_id long, text string"))
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None and r.text]
    want = set()
    for i, t in items:
        n = len(t.split())
        own = Counter(tuple(x) for x in grams(t.encode().lower().split()))
        for d, text in texts.items():
            w = text.encode().lower().split()
            every = {g for g in grams(w, min(5, n))}
            if not every & set(own):
                continue
            for p in range(len(w) - n + 1):
                if decontaminate.weighted_jaccard(Counter(grams(w[p : p + n])), own) >= 0.8:
                    want.add((d, i))
                    break
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == want and want
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 4_000)
    assert len(list(decontaminate.load_items(bench))) > 2
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == want
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0


def grams(w, k=5):
    k = min(k, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if k else []


def test_lm(docs, texts, empty):
    train = [d for d in texts if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    c = Counter(w for d in train for w in texts[d].encode().lower().split())
    c[" end"] = len(train)
    n, v = sum(c.values()), len(c)
    got = lm_score.score(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        w = [*texts[r.doc_id].encode().lower().split(), " end"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-6)
    held = [r for r in got if r.held_out and r.n_tokens < 20_000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.score(empty).count() == 0


def test_lm_words_beyond_the_vocabulary(spark, monkeypatch):
    """Words outside the vocabulary, most of them outside the table too, keep what they tell of the next word; all chances sum to one."""
    for name, value in (("VOCABULARY", 8), ("TABLE", 40), ("WORDS_A_GROUP", 2)):
        monkeypatch.setattr(lm_score, name, value, raising=False)
    r, held = np.random.default_rng(5), [d for d in range(3_000) if zlib.crc32(str(d).encode()) % 10 == 0]
    texts = [" ".join(f"k{i} v{i} the" for i in r.integers(0, 60, 600)) for _ in range(400)]
    rows = list(zip((d for d in range(3_000) if d not in held), texts, strict=False))
    right, wrong = ([(held[i + at], f"k{i} v{(i + step) % 60}") for i in range(60)] for at, step in ((0, 0), (60, 1)))
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows + right + wrong, "doc_id long, text string")).collect()}
    gain = sum(got[d].score for d, _ in right) - sum(got[d].score for d, _ in wrong)
    assert gain > 60 * math.log10(1.5), gain  # 2.3 where only the vocabulary's words are told apart
    c = Counter(w for t in texts for w in t.split()) + Counter({" end": len(texts)})
    for d, t in right + wrong:
        assert got[d].n_known == 3 and math.isclose(got[d].base_score, sum(math.log10((c[w] + 0.1) / (c.total() + 0.1 * (len(c) + 1))) for w in (*t.split(), " end")), rel_tol=1e-9)

    part = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    m = lm_score.train(part, lm_score.count_words(part))
    lookup, groups = lm_score._Lookup(m.words), len(m.scale)
    assert len(m.words) == 40 and groups > 1
    unseen = {int(lm_score._encode([w])[0][0]) & (groups - 1): w for w in (b"u%d" % i for i in range(4_000))}
    assert len(unseen) == groups
    words = [w.encode() for w in c if w != " end"] + list(unseen.values())
    for before in (b"", b"k1", b"the k2", b"never seen v3"):
        at = len(before.split())
        hashes, offsets = lm_score._encode([before + b" " + w for w in words] + [before])
        place, _, chance = lm_score.chances(m, lookup, hashes, offsets)
        last, n = offsets[:-1] + at, np.array([c[w.decode()] for w in words] + [len(texts)])
        assert math.isclose((10 ** (chance[last] + np.where(place[last] < 40, 0, np.log10(n + 0.1)))).sum(), 1, rel_tol=1e-4)


def test_lm_places():
    words = np.random.default_rng(6).integers(-(2**63), 2**63, 100_000)
    lookup = lm_score._Lookup(words)
    assert len(lookup.lost) and (lookup.of(words) == np.arange(len(words))).all()
    assert (lookup.of(np.append(words[:5] + 1, 0)) == len(words)).all() and (lm_score._Lookup(words[:0]).of(words[:9]) == 0).all()


def test_licenses(docs, texts, empty, spark):
    more = spark.createDataFrame([(1, "x y RELEASED under the MIT License. z"), (2, "Released under the mit"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(more).collect()} == {1: "MIT", 2: "", 3: ""}
    sets = [(n, set(grams(t.encode().lower().split()))) for n, t in licenses.TEMPLATES]
    for r in licenses.scan(docs).collect():
        own = set(grams(texts[r.doc_id].encode().lower().split()))
        assert set(filter(None, r.licenses.split(","))) == {n for n, s in sets if len(s & own) >= 0.8 * len(s)}
    assert licenses.scan(empty).count() == 0


def test_license_places():
    """Every template, whole or with words changed, at any place of a long text, more than once; against windows by brute force."""
    r = np.random.default_rng(12)
    t = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        words = text.split()
        n = len(words) - 4
        changed = words[: len(words) - int(0.15 * n)]  # a template without its end holds 0.85 of its shingles
        for lead in (0, 1, 7, int(r.integers(8, 400)), licenses.PIECE - 3):
            got = licenses.licences(" ".join([*(f"a{i}" for i in range(lead)), *words, *(f"b{i}" for i in range(600)), *changed, "c"]).encode(), t)
            assert (name, lead, len(words)) in got, (name, lead, got)
            assert any(g[0] == name and g[1] == lead + len(words) + 600 for g in got), (name, lead, got)
        half = " ".join(words[: 4 + int(0.7 * n)]).encode()
        assert n < 4 or all(g[0] != name for g in licenses.licences(half, licenses.Templates([(name, text)])))
    assert licenses.licences(b"any text", licenses.Templates([])) == [] and licenses.licences(b"", t) == []
    assert licenses.licences(b"x Two Words y", licenses.Templates([("A", "two words"), ("B", " ")])) == [("A", 1, 2)]


def test_toxicity(spark, docs, empty):
    labels = table(spark, D, "labels")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} <= {0, 1}
    assert toxicity.score(empty, none).count() == 0


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    labels = table(spark, big, "labels")
    docs = table(spark, big, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    said, meant = got.predicted == 1, got.toxic == 1
    assert (said == meant).mean() > 0.95 and said[meant].mean() >= 0.8 and meant[said].mean() >= 0.8


def test_toxicity_labels(spark):
    """Null, repeated and clashing labels, null ids, a text for each of several rows of an id; scores against the fit by hand."""
    base = table(spark, D, "documents").select("doc_id", "text").collect()
    marks = {r.doc_id: r.toxic for r in table(spark, D, "labels").collect()}
    rows = [(r.doc_id, r.text, 5) for r in base] + [(None, "x y", 1), (base[0].doc_id, "~ another text", 1), (7001, None, 1), (7002, "word " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3)
    labels = [(d, 1, t, "t") for d, t in marks.items()] + [(d, 0, 0, "t") for d, t in marks.items() if t] + [(None, 1, 1, "t"), (7001, 1, None, "t"), (7002, 1, 0, "t"), (9999, 1, 1, "t")]
    made = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    known = {**{d: int(t > 0) for d, t in marks.items()}, 7002: 0, 9999: 1}
    known = {d: y for d, y in known.items() if zlib.crc32(str(d).encode()) % 4 != 2}
    texts_ = {}
    for d, t, _ in rows:
        if d in known:
            texts_[d] = min(texts_.get(d, t or ""), t or "")
    s = toxicity.Settings()
    sample = [(toxicity._shortened(texts_[d].encode(), s), known[d]) for d in sorted(texts_)]
    want = toxicity.fit(sample, (sum(known.values()) + 0.5) / (len(known) + 1))
    assert (made.toxic, made.ordinary) == (want.toxic, want.ordinary)
    p = dict(zip((t for _, t, _ in rows), toxicity.score_texts(want, want.compressors(), [(t or "").encode() for _, t, _ in rows]), strict=True))
    got = toxicity.score(docs.select("doc_id", "text", "y"), made).join(docs.select("doc_id", "text"), "doc_id").filter("doc_id <> 0").collect()
    assert len(got) > 150 and all(any(abs(r.score - v) < 1e-9 for t, v in p.items() if t == r.text) or r.doc_id == base[0].doc_id for r in got)


def test_html(spark):
    pages = table(spark, D, "pages")
    truth = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        truth[r.page_id] = "\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == truth
    tree = html_text.train()
    page = """<body><header><div>Site name</div></header><div class="sidebar"><p>Some words beside the text that go on for a while.</p></div>
      <main><h2>A title</h2><p>First <a href=x>linked</a> words of the text,\n and &amp; more &#233;.</p><ul><li>an item of the text here</li></ul>
      <form><p>Send us your mail address</p><input></form><div id="comments"><p>I liked this text very much, thank you for it.</p></div></main>
      <p class="cookie-notice">We use cookies on this site.</p><footer>(c) us</footer></body>"""
    assert html_text.main_text(page, tree) == "A title\nFirst linked words of the text, and & more é.\nan item of the text here"
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<article><p>cut off &am")], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract(odd).collect()} == {1: ("", 0), 2: ("", 0), 3: ("cut off &am", 11)}


def test_html_odd_markup():
    """Optional tags, loud class names, tags that never close; time in proportion to the page."""
    import time

    tree = html_text.train()
    text = lambda page: html_text.main_text(page, tree)
    a, b = "a " * 30, "b " * 30
    assert text("<html><head><title>x</title><article><p>words of the text</article></html>") == "words of the text"
    assert text(f'<div class="post-content share-enabled"><p>{a}') == a.strip()
    assert text(f'<div class="entry promo"><article><p>{a}</article></div><p class=ad>buy this now') == a.strip()
    for tag in ("svg", "button", "select"):
        assert text(f"<p>{a}<{tag}><p>{b}") == f"{a.strip()}\n{b.strip()}"
    assert text(f"<article><header><h1>The title</h1></header><p>{a}") == f"The title\n{a.strip()}"
    assert text("<p>one short paragraph here") == "one short paragraph here" and text("<p>one < two three") == "one < two three"
    assert text("<p>some words here <!-- at the end") == "some words here" and text("<p>a b c <a href") == "a b c"
    for tag in ("<div>word ", "<p>w </b>", "<li>w ", "<svg>", "</p></div>", "<!--", "<a ", "<p a='x' "):
        began = time.time()
        text("<p>one two three " + tag * 100_000)
        assert time.time() - began < 20, tag


def test_html_labelled_pages():
    """Each labelled page is judged by a tree that was grown without it."""
    made, right, n = html_text.labelled_blocks(), 0, 0
    for k, (x, y) in enumerate(made):
        tree = html_text.train(html_text.PAGES[:k] + html_text.PAGES[k + 1 :])
        right += sum(html_text.decide(tree, v) == bool(c) for v, c in zip(x.tolist(), y, strict=True))
        n += len(y)
    assert right / n > 0.94


def test_html_without_article(spark):
    """The pages with their article element renamed to a plain one give the same text wherever it outweighs the rest."""
    tree, same, n = html_text.train(), 0, 0
    for r in table(spark, D, "pages").collect():
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        same += html_text.main_text(plain, tree) == html_text.main_text(r.html, tree)
        n += 1
    assert same / n > 0.9


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = table(spark, D, "documents").cache()
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == list(C.COLUMNS), name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
    assert C.run(spark, D).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_near_threshold(spark):
    """The stage links at 0.80; op2's query stays at 0.85."""
    import corpus_pipeline as C

    w = [f"w{i}" for i in range(144)]
    far = [*w[:78], "x", *w[79:100], "y", *w[101:]]  # 130 of 150 shingles shared: 0.867
    near = [*w[:40], "x", *w[41:80], "y", *w[81:120], "z", *w[121:]]  # 125 of 155: 0.806
    odd = [*near[:60], "u", *near[61:]]  # 120 of 160 with w: 0.75, but linked to near
    rows = [(k, " ".join(x), "en", "src0", 1) for k, x in enumerate((w, far, near, odd, [f"v{i}" for i in range(50)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = components({r[0]: shingles(r[1]) for r in rows}, 80)
    assert want == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert {r.doc_id for r in C.drop_near_duplicates(spark, df, D).collect()} == {0, 4}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == components({r[0]: shingles(r[1]) for r in rows})
    for percent in (80, 85, 90):
        rows_, p = near_dedup.band_rows(percent), percent / 100
        assert (1 - p**rows_) ** (near_dedup.T // rows_) <= 1e-6
    assert (near_dedup.band_rows(85), near_dedup.band_rows(80)) == (5, 4)


def test_toxicity_own_words():
    """All words that are odd to toxic text are learnt, far beyond 500 bytes of them."""
    r = np.random.default_rng(5)
    usual = [f"usual{i}" for i in range(400)]
    bad = [f"{''.join(chr(97 + c) for c in r.integers(0, 26, 9))}" for _ in range(240)]
    made = lambda words: " ".join(words).encode()
    rows = [(made(r.choice(usual, 40)), 0) for _ in range(900)]
    for k in range(600):  # each bad word is in ten rows
        w = list(r.choice(usual, 36))
        rows.append((made([*w[:18], *(bad[(4 * k + j) % 240] for j in range(4)), *w[18:]]), 1))
    model = toxicity.fit(rows, 0.4)
    assert np.mean([w.encode() in model.toxic for w in bad]) > 0.7 and len(model.toxic) == len(model.ordinary)
    assert not any(w.encode() in model.ordinary for w in bad)
    new = [made([*r.choice(usual, 18), *(bad[(4 * k + j + 7) % 240] for j in range(4)), *r.choice(usual, 18)]) for k in range(60)]
    assert (toxicity.score_texts(model, model.compressors(), new) >= toxicity.THRESHOLD).mean() > 0.95
    clean = [made(r.choice(usual, 40)) for _ in range(60)]
    assert (toxicity.score_texts(model, model.compressors(), clean) < toxicity.THRESHOLD).mean() > 0.9


def test_contamination_trimmed(spark):
    """Documents that are an item with words cut off at either end or both, against brute force on whole texts."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((3, 5, 6, 7, 10, 14, 40, 41, 100))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, want = [], set()
    for _, t in items:
        w = t.split()
        texts += [" ".join(w[a : len(w) - b]) for a in range(12) for b in range(12) if a + b < len(w)]
    for d, t in enumerate(texts):
        w = t.encode().split()
        for k, item in items:
            j = decontaminate.weighted_jaccard(Counter(grams(w)), Counter(grams(item.encode().split())))
            if j >= 0.8:
                want.add((d, k, 0, len(w), round(j, 9)))
    got = decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {(*r[:4], round(r.similarity, 9)) for r in got} == want and any(n < 40 for _, k, _, n, _ in want if k == 6)


def test_pipeline_mixing_rows(spark):
    """Each row, with or without an id, comes as often as the mix takes it."""
    import corpus_pipeline as C

    rows = [(None, f"text {i} of none {'w ' * (i % 7)}", "en", "src0" if i % 3 else None, i) for i in range(60)]
    rows += [(i // 2, f"text {i} with an id", None, ("src0", "src1", "src2")[i % 3], None) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.mix_sources(spark, df, D).collect()
    counts = Counter(tuple(r) for r in got)
    assert set(counts) <= set(rows) and max(counts.values()) <= 3 and sum(r.doc_id is None for r in got) > 0
    per, aims = Counter(), {r.source: r.target for r in mixing.copies(df).collect()}
    for r in got:
        per[r.source] += len(r.text.split())
    assert all(abs(per[s] - t) <= 11 for s, t in aims.items())
    assert Counter(map(tuple, C.mix_sources(spark, df.repartition(5), D).collect())) == counts


def test_pipeline_keeps_tokens(spark, docs, texts, tmp_path):
    import json

    import corpus_pipeline as C

    spark.conf.set("spark.pixelmill.tokens.dir", str(tmp_path))
    try:
        report = C.write_token_files(spark, docs, D).collect()
    finally:
        spark.conf.unset("spark.pixelmill.tokens.dir")
    (folder,) = tmp_path.iterdir()
    listed = json.loads((folder / "shards.json").read_text())
    assert sum(s[2] for s in listed["shards"]) == sum(r.n_tokens for r in report) and len(report) == len(texts)
    for name, n_docs, n_ids, _ in listed["shards"]:
        assert len(np.fromfile(folder / f"{name}.bin", listed["dtype"])) == n_ids and len(np.fromfile(folder / f"{name}.idx", "<u8")) == n_docs + 1


def test_near_maps():
    """The maps of two sets never differ in more bits than the sets have shingles apart."""
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**63, 4000).astype("<u8")
    for n in (1, 30, 200, 1500):
        for shared in (0, n // 2, n):
            a, b = np.unique(pool[:n]), np.unique(pool[n - shared : 2 * n - shared])
            x, y = near_dedup.maps([a, b])
            apart = sum(int(v).bit_count() for v in (x ^ y).view("<u8"))
            assert apart <= len(np.setxor1d(a, b)) and (n > 200 or shared == n or apart > 0.6 * len(np.setxor1d(a, b)))
    assert near_dedup.maps([]).shape == (0, near_dedup.MAP_WORDS)
