"""Every operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import pathlib
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lossledger.llm import _blob, _text, bpe, katz, linededup, minhash, mixing, packing, quality, simple8b, syncmers, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and water river stone light house green tree under over cloud rain small large wind fire earth sky bird fish road hill".split()


def text_of(rng, n, lines=1, words=WORDS):
    return "\n".join(" ".join(rng.choice(words) for _ in range(n)) + "." for _ in range(lines))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, text_of(rng, rng.randint(1, 60), rng.randint(1, 6)), "en", f"s{i % 3}") for i in range(60)]
    out += [(60, out[0][1], "en", "s0"), (61, out[5][1] + " tail", None, None), (62, out[7][1], "en", "s1")]
    out += [(63, "", "en", "s0"), (64, None, None, None), (None, "stone bird", "en", "s2"), (None, None, None, None), (65, "  \n \n\n", "en", "s1")]
    out += [(66, "one two", "en", "s1"), (66, "one two", "en", "s1"), (66, "three four five", "en", "s1")]
    out += [(67, text_of(rng, 3000, 2), "en", "s0"), (68, "é" * 70 + " — “quoted” naïve ÇA 漢字", "fr", "s2"), (69, "a b c\n" * 40, "en", "s2")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def internal_names():
    """Every name that the operators give a column, from their source."""
    text = " ".join(p.read_text() for p in pathlib.Path(minhash.__file__).parent.glob("*.py"))
    found = re.findall(r"[\"'](\w+)[\"']", text) + re.findall(r"\bas (\w+)", text) + re.findall(r"(\w+) (?:long|int|string|binary|double|boolean|array<)", text)
    return sorted({n for n in found if re.fullmatch(r"[A-Za-z_]\w*", n) and n == n.lower()} - {"doc_id", "text", "lang", "source", "n_chars"})


CLASH = internal_names()


@pytest.fixture(scope="module")
def clashing(spark, docs):
    assert {"gone", "cut", "row", "part", "sig", "epoch", "n_lines", "label", "bits"} <= set(CLASH)
    return docs.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASH])


def words(t):
    return re.findall(_text.WORD_RE.replace("\\x{BF}", "\xbf").replace("\\x{2000}-\\x{206F}\\x{3000}-\\x{303F}", " -⁯　-〿"), (t or "").lower())


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ---- helpers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=12))
def test_words_and_hashes(texts):
    w = _text.words(pa.array(texts, pa.string()))
    got = w.strings(np.arange(len(w.hash))).to_pylist()
    assert got == [x for t in texts for x in words(t)]
    assert w.doc.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
    assert w.chars().tolist() == [len(x) for x in got]
    assert (w.hash == _text.word_hash(got)).all() if got else not len(w.hash)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_blobs(values):
    a = np.array(values, np.uint64)
    assert (_blob.unpack(_blob.pack(a)) == a).all()
    assert (_blob.unpack_sorted(_blob.pack_sorted(np.sort(a))) == np.sort(a)).all()
    k, n = _blob.count_sorted(a)
    assert dict(zip(k.tolist(), n.tolist())) == Counter(values)


def test_slices_cover_every_row():
    a = pa.array(["x" * 10, None, "y" * 100, "", "z"])
    assert list(_text.slices(a, 20))[0][0] == 0 and [hi for _, hi in _text.slices(a, 20)][-1] == 5
    assert list(_text.slices(pa.array([], pa.string()))) == []


# ---- 1 packing


def brute_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(capacity - n)
    return sorted(free)


@settings(max_examples=2000, deadline=None)
@example([1, 1, 16, 16], 30)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 41))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    used, seen = defaultdict(list), Counter()
    for n, lo, hi, first, per, off in packing.plan_bins(Counter(lengths).items(), capacity):
        assert seen[n] == lo
        seen[n] += hi - lo
        for k in range(hi - lo):
            used[first + k // per].append((off + k % per * n, n))
    assert seen == Counter(lengths)
    for slots in used.values():
        assert [o for o, _ in sorted(slots)] == [sum(n for _, n in sorted(slots)[:i]) for i in range(len(slots))]
    assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == brute_fit(lengths, capacity)


def check_packed(got, want_tokens, capacity):
    bins = defaultdict(list)
    for r in got:
        if r.bin is not None:
            bins[r.bin].append((r.bin_offset, r.length))
        else:
            assert r.length == 0
    for slots in bins.values():
        slots.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(slots, slots[1:])) and slots[-1][0] + slots[-1][1] <= capacity
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == want_tokens
    lengths = [r.length for r in got if r.length]
    assert sorted(capacity - sum(n for _, n in s) for s in bins.values()) == brute_fit(lengths, capacity)


def test_packing(docs, rows, clashing, empty):
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").split())
    for d in (docs, clashing):
        for part in (packing.PART, 7):  # 7: ranks are counted in many parts
            got = packing.pack(d, capacity=64, part=part).collect()
            check_packed(got, want, 64)
            starts = {(r.doc_id, r.piece): r.start for r in got if r.doc_id not in (None, 66)}
            assert all(at == 64 * k for (_, k), at in starts.items())
    assert packing.pack(docs, capacity=64).columns == ["doc_id", "piece", "start", "length", "bin", "bin_offset"]
    assert packing.pack(empty).collect() == []
    with pytest.raises(ValueError):
        packing.plan_bins([(9, 1)], 8)


# ---- 2 Simple-8b and 9 token counts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(-(2**63), 2**63 - 1)), max_size=400), st.sampled_from([1, 7, 128]))
def test_simple8b_round_trip(values, block):
    b = simple8b.encode_rows(pa.array([1]), np.array(values, np.int64), np.array([len(values)]), block)
    out = simple8b.decode(np.frombuffer(b.column(2)[0].as_py(), "<u8"), np.array(b.column(3)[0].as_py(), np.int64), len(values), block)
    assert out.tolist() == values


def test_simple8b_packs_as_many_as_fit():
    b = simple8b.encode_rows(pa.array([1]), np.array([1] * 120 + [5] * 8), np.array([128]))
    assert len(b.column(2)[0].as_py()) == 8 * 3
    big = simple8b.encode_rows(pa.array([1]), np.array([-1, 3]), np.array([2]))
    assert np.frombuffer(big.column(2)[0].as_py(), "<u8")[0] >> 60 == simple8b.ESCAPE


def test_encoded_documents(docs, rows, clashing, empty):
    enc = simple8b._encoder(bpe.VOCABULARY)
    want = [(i, enc.encode_ordinary(t or "")) for i, t, *_ in rows]
    for d in (docs, clashing):
        got = simple8b.encode_documents(d).collect()
        same([(r.doc_id, simple8b.decode(np.frombuffer(bytes(r.words), "<u8"), np.array(r.block_offsets), r.n_ids).tolist()) for r in got], want)
        same([(r.doc_id, r.n_tokens) for r in bpe.token_counts(d).collect()], [(i, len(x)) for i, x in want])
    assert simple8b.encode_documents(empty).collect() == [] == bpe.token_counts(empty).collect()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab 1'st.\n\t\0é漢  ", max_size=30), st.text(max_size=20)), min_size=1, max_size=8))
def test_token_counts_are_exact(texts):
    enc = simple8b._encoder(bpe.VOCABULARY)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = np.concatenate([b.column(1).to_numpy() for b in bpe._run(bpe.VOCABULARY)(iter([batch]))])
    assert got.tolist() == [len(enc.encode_ordinary(t or "")) for t in texts]


# ---- 3 toxicity


def toxic_corpus(rng, n):
    bad = ["vile", "scumbag", "wretch", "vermin"]
    out, labels = [], []
    for i in range(n):
        t = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        for _ in range(2 + len(t) // 30 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        out.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return out, labels


def test_toxicity_on_held_out_documents(spark):
    out, labels = toxic_corpus(random.Random(1), 900)
    docs = spark.createDataFrame(out + [(None, "vile scumbag wretch"), (None, None), (5000, ""), (5001, None), (0, out[0][1])], "doc_id long, text string").selectExpr("*", "1 as label", "'x' as word", "true as toxic")
    lab = spark.createDataFrame([(*x, "y") for x in labels if x[0] % 2] + [(None, 1, "y"), (1, 7, "y"), (3, None, "y")] + [(i, t, "z") for i, t in labels if not i % 12], "doc_id long, toxic int, text string")
    lex = toxicity.induce(docs, lab)
    assert {"vile", "scumbag", "wretch", "vermin"} <= set(lex.word) and len(lex.word) < 12
    got = {r.doc_id: r.toxic for r in toxicity.score_documents(docs, lab).where("doc_id is not null").collect()}
    held = [i for i, _ in labels if i % 2 == 0 and i % 12]
    wrong = sum(got[i] != bool(labels[i][1]) for i in held)
    assert wrong <= 0.03 * len(held) and not got[5000] and not got[5001]
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, t in got.items() if not t} | {None}
    assert kept.where("doc_id is null").count() == 1


def test_toxicity_without_data(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, none).where("toxic").count() == 0
    assert toxicity.score_documents(empty, none).collect() == []
    clean = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, clean).count() == docs.count()


def test_rare_toxic_word_stays_found(spark):
    """A word in eight labelled toxic documents is found however many clean documents there are besides."""
    for n in (2000, 30_000):
        docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 50, ' w', id * 7 % 53, ' w', id % 31, if(id < 8, ' gronk', ''), ' w', id % 43, ' w', id % 29) as text")
        lab = spark.range(200).selectExpr("id as doc_id", "if(id < 8, 1, 0) as toxic")
        assert "gronk" in toxicity.induce(docs, lab).word
        assert {r.doc_id for r in toxicity.score_documents(docs, lab).where("toxic").collect()} == set(range(8))


def signed(h):
    return np.asarray(h, np.uint64).view(np.int64).tolist()


def test_graph_and_walk(spark):
    """Seeds, nodes, edges, walks and polarity against dense matrices."""
    out, labels = toxic_corpus(random.Random(2), 240)
    df = spark.createDataFrame([(i, t, y) for (i, t), (_, y) in zip(out, labels)], "doc_id long, text string, label int").repartition(3)
    n, k, m = Counter(), Counter(), Counter()
    for (_, t), (_, y) in zip(out, labels):
        n.update(words(t))
        m.update(set(words(t)))
        k.update(set(words(t)) if y else ())
    z = toxicity.Z

    def bound(w, sign):
        q = k[w] / m[w]
        return (q + z * z / (2 * m[w]) + sign * z * math.sqrt(q * (1 - q) / m[w] + z * z / (4 * m[w] ** 2))) / (1 + z * z / m[w])

    vocab, total = toxicity.vocabulary(df)
    assert total == sum(n.values())
    got = {r.word: (r.n, r.seed_t, r.seed_c, r.denied) for r in vocab.collect()}
    assert got == {w: (n[w], bound(w, -1) > 0.5, bound(w, 1) < 0.5, 2 * k[w] < m[w]) for w in n}
    toxic = {w for w in n if got[w][1]}
    assert toxic == {"vile", "scumbag", "wretch", "vermin"}
    c = Counter()
    for _, t in out:
        ws = words(t)
        for i in range(len(ws)):
            for d in (1, 2, 3):
                if i + d < len(ws) and ws[i] != ws[i + d]:
                    c[frozenset((ws[i], ws[i + d]))] += 1
    weight = {}
    for pair, q in c.items():
        x, y = pair
        e = 2 * 3 * n[x] * n[y] / total
        if math.log(q / e) > 0 and 2 * (q * math.log(q / e) - (q - e)) >= 3.84:
            weight[pair] = math.log(q / e)
    at = sorted(toxic | {w for pair in weight if pair & toxic for w in pair})
    rows = toxicity.word_graph(df, vocab, total, 3, 3.84, most=1)[1]  # pairs as rows
    nodes, edges = toxicity.word_graph(df, vocab, total, 3, 3.84)
    assert sorted((r.i, r.j, round(r.w, 9)) for r in rows.collect()) == sorted((r.i, r.j, round(r.w, 9)) for r in edges.collect())
    h = dict(zip(at, signed(_text.word_hash(at))))
    assert {r.h: (r.n, r.seed_t, r.seed_c) for r in nodes.collect()} == {h[w]: got[w][:3] for w in at} and len(at) > 8
    want = {(h[x], h[y]): v for x in at for y in at if (v := weight.get(frozenset((x, y))))}
    have = {(r.i, r.j): r.w for r in edges.collect()}
    assert have.keys() == want.keys() and all(have[e] == pytest.approx(want[e]) for e in want)
    a = np.array([[want.get((h[x], h[y]), 0.0) for y in at] for x in at])
    start = np.array([[float(got[w][j]) for w in at] for j in (1, 2)])
    start /= np.maximum(start.sum(axis=1, keepdims=True), 1)
    p = start
    for _ in range(toxicity.STEPS):
        p = 0.5 * start + 0.5 * (p / np.maximum(a.sum(axis=0), 1e-300)) @ a.T
    value = dict(zip(at, (p[0] - p[1]) / (p[0] + p[1] + 1 / len(at))))
    assert {r.h: r.value for r in toxicity.polarity(nodes, edges).collect()} == pytest.approx({h[w]: value[w] for w in at}, abs=2e-6)


def test_worker_gives_memory_back():
    """What a task of word statistics has freed isn't kept by its worker, which waits beside an executor that needs it."""
    code = """
import ctypes
import numpy as np, pyarrow as pa
from lossledger.llm import _text, toxicity
_text.powers(1 << 22)
resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
rng = np.random.default_rng(0)
texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 400_000, 200)) for _ in range(20_000)])
assert sum(b.num_rows for b in toxicity._stats(iter([pa.RecordBatch.from_arrays([texts, pa.nulls(len(texts), pa.int32())], ["text", "label"])]))) > 400_000
after = resident()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(after - resident())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=pathlib.Path(toxicity.__file__).parents[2])
    assert float(out.stdout) < 25


def test_toxicity_workers_stay_small():
    """MB that workers take at most, beside their texts, while they count words, count pairs and score; two of each wait beside an executor whose heap is full."""
    code = """
import sys
import numpy as np, pyarrow as pa
from lossledger.llm import _text, toxicity
def status(name):
    return next(int(x.split()[1]) / 1024 for x in open("/proc/self/status") if x.startswith(name))
class Sent:
    pass
words = [f"w{x}" for x in range(400_000)]
h = np.sort(_text.word_hash(words))
Sent.value = toxicity.Lexicon(words[:1000], h[::400], np.ones(1000), 0.2, 0.1, 0.5) if sys.argv[1] == "score" else toxicity.Numbering(h, np.arange(len(h)).astype(np.uint32), 64, -(-len(h) // 64))
rng = np.random.default_rng(0)
texts = pa.array([" ".join(words[x] for x in rng.integers(0, 400_000, 200)) for _ in range(20_000)])
run = {"count": toxicity._stats, "pairs": toxicity._all_pairs(Sent, 3), "score": toxicity._score(Sent, "text", True)}[sys.argv[1]]
batch = lambda t: iter([pa.RecordBatch.from_arrays([t, pa.nulls(len(t), pa.int32())], ["text", "label"])])
list(run(batch(texts.slice(0, 100))))
toxicity.trim()
open("/proc/self/clear_refs", "w").write("5")  # the peak begins anew
before = status("VmRSS")
for out in run(batch(texts)):
    del out
print(status("VmHWM") - before)
"""
    peak = {k: float(subprocess.run([sys.executable, "-c", code, k], capture_output=True, text=True, check=True, cwd=pathlib.Path(toxicity.__file__).parents[2]).stdout) for k in ("count", "pairs", "score")}
    assert peak["count"] < 175 and peak["pairs"] < 95 and peak["score"] < 32, peak


def test_walks_go_over_the_graph_of_all_words(spark):
    """Every significant pair is an edge, however far from the toxic seeds: polarities against dense matrices, for words numbered and in rows."""
    out, labels = toxic_corpus(random.Random(4), 240)
    out = [(i, t + (" vile" + " hint" * (i % 2) + " far" * (i % 4 == 2) if y else "")) for (i, t), (_, y) in zip(out, labels)] + [(1000 + i, "hint far") for i in range(30)]
    label = dict(labels)
    df = spark.createDataFrame([(i, t, label.get(i)) for i, t in out], "doc_id long, text string, label int").repartition(3)
    vocab, total = toxicity.vocabulary(df)
    rows = sorted(vocab.collect(), key=lambda r: r.word)
    at = {r.word: k for k, r in enumerate(rows)}
    n = np.array([r.n for r in rows])
    c = np.zeros((len(at), len(at)))
    for _, t in out:
        ws = [at[w] for w in words(t)]
        for d in (1, 2, 3):
            for x, y in zip(ws, ws[d:]):
                if x != y:
                    c[x, y] += 1
                    c[y, x] += 1
    e = 2 * 3 * np.outer(n, n) / total
    w = np.log(np.maximum(c, 1e-9) / e)
    a = np.where((c > 0) & (w > 0) & (2 * (c * w - (c - e)) >= 3.84), w, 0)
    start = np.array([[float(r.seed_t) for r in rows], [float(r.seed_c) for r in rows]])
    beyond = (start[0] == 0) & (a[start[0] > 0].sum(axis=0) == 0)
    assert a[beyond][:, beyond].any()  # edges that the toxic seeds' neighbours don't have
    start /= np.maximum(start.sum(axis=1, keepdims=True), 1)
    p = start
    for _ in range(toxicity.STEPS):
        p = 0.5 * start + 0.5 * (p / np.maximum(a.sum(axis=0), 1e-300)) @ a
    value = (p[0] - p[1]) / (p[0] + p[1] + 1 / len(at))
    h = signed(_text.word_hash([r.word for r in rows]))
    for most in (toxicity.NUMBERED, 0):
        got = {r.h: r.value for r in toxicity.polarities(df, vocab, total, 3, 3.84, -2.0, most).collect()}
        assert got == pytest.approx(dict(zip(h, value.tolist())), abs=2e-6)
    graph = toxicity.Graph(df, vocab, total, 3, 3.84)
    assert graph.times(None) == pytest.approx(a.sum(axis=0)[[h.index(x) for x in signed(graph.hash)]])


def test_word_two_links_from_the_seeds_is_found(spark):
    """A word that is never beside a toxic seed, but beside words that are, is in the lexicon."""
    docs = spark.range(600).selectExpr("id as doc_id", "concat('w', id % 50, ' w', id * 7 % 53, case when id < 60 then ' gronk' when id < 120 then ' gronk snarl' when id < 180 then ' snarl blurk' else '' end, ' w', id % 31, ' w', id % 43, ' w', id % 29) as text")
    lab = spark.range(300).selectExpr("id as doc_id", "if(id < 60, 1, 0) as toxic").where("doc_id < 60 or doc_id >= 180")
    assert {"gronk", "snarl", "blurk"} <= set(toxicity.induce(docs, lab).word)


def test_corpus_ten_times_over_has_the_same_lexicon(spark):
    """No word is cut by a share of the corpus: clean documents besides, in any number, leave the lexicon's seeds as they are."""
    out, labels = toxic_corpus(random.Random(3), 300)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    one = toxicity.induce(spark.createDataFrame(out, "doc_id long, text string"), lab)
    ten = toxicity.induce(spark.createDataFrame(out + [(1000 + 300 * r + i, t) for r in range(9) for i, t in out], "doc_id long, text string"), lab)
    assert {"vile", "scumbag", "wretch", "vermin"} <= set(one.word) <= set(ten.word)


def test_threshold_takes_equal_scores_together():
    lex = toxicity.Lexicon(["x"], _text.word_hash(["x"]), np.ones(1))
    n, hits, label = np.array([10] * 6), np.array([2.0, 2.0, 2.0, 0.0, 0.0, 0.0]), np.array([1, 1, 0, 0, 0, 0])
    got = toxicity.fit(lex, n, hits, label)
    assert (toxicity.llr(got, n, hits) >= got.threshold).tolist() == [True, True, True, False, False, False]
    assert toxicity.fit(lex, n, hits * 0, label).threshold == math.inf


# ---- 4 Katz


def brute_katz(texts):
    """P(w | u, v), P(w | v), P(w) as functions of any words, and the counts."""
    seqs = [["<s>", "<s>", *words(t), "</s>"] for t in texts]
    c3 = Counter((s[i - 2], s[i - 1], s[i]) for s in seqs for i in range(2, len(s)))
    c2, c1, h3, h2 = Counter(), Counter(), Counter(), Counter()
    for (u, v, w), n in c3.items():
        c2[v, w] += n
        c1[w] += n
        h3[u, v] += n
        h2[v] += n
    d = [katz.discounts(np.array([sum(1 for n in c.values() if n == r) for r in range(1, katz.K + 2)])) for c in (c1, c2, c3)]
    total = sum(c1.values())
    after2, after3 = defaultdict(list), defaultdict(list)
    for v, w in c2:
        after2[v].append(w)
    for u, v, w in c3:
        after3[u, v].append(w)
    f = lambda k, n: (d[k][n] if n <= katz.K else 1) * n
    for v in after2:
        h2[v] += all(f(1, c2[v, w]) == c2[v, w] for w in after2[v])
    for u, v in after3:
        h3[u, v] += all(f(2, c3[u, v, w]) == c3[u, v, w] for w in after3[u, v])
    total += all(f(0, n) == n for n in c1.values())
    rest = 1 - sum(f(0, n) for n in c1.values()) / total

    def p1(w):
        return f(0, c1[w]) / total if c1[w] else rest

    def p2(w, v):
        if c2[v, w]:
            return f(1, c2[v, w]) / h2[v]
        left, below = 1 - sum(p2(x, v) for x in after2[v]), 1 - sum(p1(x) for x in after2[v])
        return left / below * p1(w)

    def p3(w, u, v):
        if c3[u, v, w]:
            return f(2, c3[u, v, w]) / h3[u, v]
        left, below = 1 - sum(p3(x, u, v) for x in after3[u, v]), 1 - sum(p2(x, v) for x in after3[u, v])
        return left / below * p2(w, v)

    return p1, p2, p3, c1, c2, c3


def brute_scores(rows, p3):
    out = []
    for i, t in rows:
        s = ["<s>", "<s>", *words(t), "</s>"]
        lp = sum(math.log(p3(s[k], s[k - 2], s[k - 1])) for k in range(2, len(s)))
        out.append((i, len(s) - 3, lp, lp / (len(s) - 2)))
    return out


def close(got, want):
    got, want = sorted((tuple(r) for r in got), key=repr), sorted(want, key=lambda r: repr((r[0], r[1], round(r[2], 6))))
    assert [g[:2] for g in got] == [e[:2] for e in want]
    for g, e in zip(got, want):
        assert g[2:] == pytest.approx(e[2:], abs=2e-5)


def test_katz(spark, docs, rows, clashing, empty):
    p3 = brute_katz([r[1] for r in rows])[2]
    want = brute_scores([r[:2] for r in rows], p3)
    for d, part, share in ((docs, katz.PART, katz.MIN_SHARE), (clashing, 40, katz.MIN_SHARE), (docs, katz.PART, 1.0), (docs, 20, 0.02)):  # small parts split nearly every context; a share of 1 leaves the code book empty
        close(katz.score_documents(d, part=part, min_share=share).collect(), want)
    assert katz.score_documents(empty).collect() == []
    named = docs.selectExpr("if(doc_id is null, null, concat('d', doc_id)) as id", "text as body")
    close(katz.score_documents(named, "id", "body").collect(), [(i if i is None else f"d{i}", *x) for i, *x in want])


@pytest.fixture(scope="module")
def katz_model(docs):
    return katz.train(docs)


def test_katz_model_scores_held_out_documents(spark, docs, rows, katz_model):
    """Unseen trigrams, bigrams and words against brute force; the corpus itself as in the single pass."""
    p1, p2, p3, c1, c2, c3 = brute_katz([r[1] for r in rows])
    rng = random.Random(12)
    held = [(k, " ".join(rng.choice([*WORDS, "unheard", "漢字"]) for _ in range(rng.randint(1, 40)))) for k in range(40)] + [(90, None), (91, ""), (None, "hill hill zzz")]
    tri = [x for _, t in held for s in [["<s>", "<s>", *words(t), "</s>"]] for x in zip(s, s[1:], s[2:])]
    assert any(x not in c3 and x[1:] in c2 for x in tri) and any(x[1:] not in c2 and x[2] in c1 for x in tri) and any(x[2] not in c1 for x in tri)
    df = spark.createDataFrame(held, "doc_id long, text string").selectExpr("*", "1 as u", "2 as p", "3 as row", "4 as n")
    close(katz.score(df, katz_model).collect(), brute_scores(held, p3))
    close(katz.score(docs, katz_model).collect(), katz.score_documents(docs).collect())


def test_katz_tables_sum_to_one(spark, rows, katz_model):
    """Over the vocabulary and the unknown words, for trigram and bigram contexts, from the model's own tables."""
    p1, p2, p3, c1, c2, c3 = brute_katz([r[1] for r in rows])
    h = lambda w: {"<s>": katz.START, "</s>": katz.END}.get(w, None) if w in ("<s>", "</s>") else signed(_text.word_hash([w]))[0]
    every = {w: h(w) for w in [*c1, "never seen"]}
    some = sorted({(u, v) for u, v, _ in c3} - {("<s>", "<s>")})[:25] + [("<s>", "<s>"), ("river", "nowhere"), ("nowhere", "stone")]  # the last two are seen as bigram contexts at most
    types = spark.createDataFrame([(h(u), h(v), x) for u, v in some for x in every.values()], "u long, v long, w long")
    sums = Counter()
    for r in katz.probabilities(types, katz_model).collect():
        sums[r.u, r.v] += r.p
    assert len(sums) == len(some) and all(x == pytest.approx(1, abs=1e-9) for x in sums.values())


def test_katz_of_a_corpus_ten_times_over(spark, docs, katz_model):
    """No word is cut however large the corpus: the vocabulary is the same, and counts grow with it."""
    ten = katz.train(docs.crossJoin(spark.range(10).select()))
    assert {r.w for r in ten.unigrams.collect()} == {r.w for r in katz_model.unigrams.collect()}
    assert ten.trigrams.count() == katz_model.trigrams.count()
    empty = katz.train(docs.limit(0))
    assert empty.trigrams.count() == 0 and katz.score(docs.limit(0), empty).collect() == []


# ---- 5 line dedup


def brute_lines(rows):
    """Rows with the same id and text are one occurrence."""
    seen, cut = set(), defaultdict(set)
    none = "" if any(isinstance(i, str) for i, _ in rows) else 0
    keyed = {(i is not None, i or none, t) for i, t in rows if t is not None}

    # any order of the texts of one id is as good as another: such rows are left out by the caller
    for key in sorted(keyed):
        lines = [x.strip(" ") for x in key[2].split("\n")]
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not any(w):  # blank lines alone are no passage
                continue
            if w in seen:
                cut[key] |= {k, k + 1, k + 2}
            seen.add(w)
    out = []
    for i, t in rows:
        c = cut[i is not None, i or none, t] if t is not None else ()
        lines = None if t is None else t.split("\n")
        out.append((i, t if not c else "\n".join(x for k, x in enumerate(lines) if k not in c), len(lines or ()), len(c)))
    return out


def test_line_dedup(spark, docs, rows, clashing, empty):
    rng = random.Random(3)
    passage = text_of(rng, 20, 3)
    some = [(i, t) for i, t, *_ in rows] + [(100 + k, f"start {k}\n{passage}\nend {k}\n{passage}") for k in range(4)]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3).selectExpr("*", "1 as n_lines", "'q' as pos", "'r' as first", "4 as __x")
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "first", "__x", "n_lines", "n_removed"]
    same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], brute_lines(some))
    rest = {r.doc_id: r.text for r in linededup.keep_rest(got).collect()}
    assert rest[100].count("\n") == 4 and rest[101] == "start 1\nend 1" and 63 in rest and 64 in rest
    assert linededup.dedup_lines(clashing).count() == clashing.count()
    assert linededup.dedup_lines(empty).collect() == []


def test_line_dedup_drops_copies(spark):
    t = "a b\nc d\ne f\ng h"
    df = spark.createDataFrame([(1, t), (2, t), (3, "x\n" + t)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.keep_rest(linededup.dedup_lines(df)).collect()} == {1: t, 3: "x"}


def test_line_dedup_edges(spark):
    """Blank lines, names that clash, ids of another type, a text of several MB."""
    long = "\n".join(f"line {k} of many" for k in range(150_000))
    rows = [("a", "c\n\n\n\nd"), ("b", "e\n\n\n\nf"), ("c", "x one\ny two\nz three"), ("d", "x one \n y two\nz three\nlast"), ("e", long), ("f", "first\n" + long), (None, "x one\ny two\nz three"), ("g", ""), ("h", None)]
    df = spark.createDataFrame(rows, "id string, body string").repartition(2)
    for c in ("__h", "__th", "__cut", "__id", "h", "k", "row", "cut", "slot", "bits", "c_id", "c_h", "a", "b", "text", "doc_id"):
        df = df.selectExpr("*", f"'{c}' as `{c}`")
    got = linededup.dedup_lines(df, "id", "body")
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and all(r["__th"] == "__th" and r.cut == "cut" for r in got.collect())
    same([(r.id, r.body, r.n_lines, r.n_removed) for r in got.collect()], brute_lines(rows))
    by = {r.id: r.body for r in got.collect()}
    assert by["a"] == "c\n\n\n\nd" and by["d"] == "last" and by["f"] == "first" and by["c"] == ""
    assert {r.id for r in linededup.keep_rest(got).collect()} == {"a", "b", "d", "e", "f", "g", "h", None}


# ---- 6 mixing


def test_exponent():
    tokens = [900, 90, 10]
    t = mixing.exponent(tokens, 1000, 0.9 * math.log(3), None)
    assert 0 < t < 1 and mixing.entropy(mixing.weights(tokens, t)) == pytest.approx(0.9 * math.log(3))
    assert mixing.exponent(tokens, 1000, 0.1, None) == 1.0
    t = mixing.exponent(tokens, 1000, math.log(3), 4.0)  # both can't be met: the limit wins
    assert max(1000 * w / n for w, n in zip(mixing.weights(tokens, t), tokens)) == pytest.approx(4)
    assert mixing.exponent([5, 0], 5, None, 4.0) == 1.0 and mixing.weights([5, 0], 0.5) == [1.0, 0.0]


def test_mixing(spark, docs, rows, clashing, empty):
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is not None, s or ""))
    for d, budget in ((docs, None), (clashing, 9000), (docs, 300)):
        out = mixing.mix(d, budget=budget)
        assert [c for c in out.columns if c not in ("epoch", "block_rank")] == [c for c in d.columns if c not in ("epoch", "block_rank")]
        got = out.collect()
        b = float(budget or sum(size.values()))
        tokens = [size[s] for s in names]
        w = mixing.weights(tokens, mixing.exponent(tokens, b, mixing.ENTROPY_SHARE * math.log(sum(1 for x in tokens if x)), mixing.MAX_REPEATS))
        longest = max(len((t or "").split()) for _, t, *_ in rows)
        for s, x in zip(names, w):
            mine = [r for r in got if r.source == s]
            took = sum(len((r.text or "").split()) for r in mine)
            want = math.floor(b * x + 1e-6)
            assert want <= took < want + longest + 1 or took == want == 0
            per = Counter((r.doc_id, r.text) for r in mine)
            own = Counter((i, t) for i, t, _, z, _ in rows if z == s)
            full = want // size[s] if size[s] else 1
            assert all(full * n <= per[k] <= (full + 1) * n for k, n in own.items())
    assert mixing.mix(empty).collect() == []


def test_mixing_where_the_repeat_limit_binds(spark, docs):
    """mix() against its SQL with a limit that wins over the entropy."""
    duckdb = pytest.importorskip("duckdb")
    from lossledger.llm._tables import table

    for limit in (1.2, 2.0, 4.0):
        df = table(spark, "/root/testdata/sf0.001", "documents").where("source <> 'x'")
        got = mixing.mix(df.select("doc_id", "text", "source"), max_repeats=limit).select("doc_id", "block_rank", "epoch")
        con = duckdb.connect()
        con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
        same([tuple(r) for r in got.collect()], con.execute(mixing.sql(max_repeats=limit)).fetchall())
    tokens = [50, 5, 5]
    assert mixing.exponent(tokens, 60, math.log(3), 1.5) > mixing.exponent(tokens, 60, math.log(3), None)


def test_mixing_of_many_sources(spark):
    """Sources are rows: as many as documents, of a few sizes, some without tokens; ids and names of any kind."""
    df = spark.range(3000).selectExpr("concat('d', id) as id", "if(id % 10 = 0, '', repeat('w ', cast(1 + id % 3 as int))) as body", "concat('s', id) as site", "1 as n", "2 as row", "3 as __mix_n", "4 as passes", "5 as rank", "6 as i", "7 as s", "8 as h", "9 as b", "10 as copies")
    out = mixing.mix(df, id_col="id", text_col="body", source_col="site")
    assert out.columns == [*df.columns, "block_rank", "epoch"]
    got = Counter(r.id for r in out.collect())
    tokens = [1 + k % 3 if k % 10 else 0 for k in range(3000)]
    w = mixing.weights(tokens, mixing.exponent(tokens, sum(tokens), mixing.ENTROPY_SHARE * math.log(2700), mixing.MAX_REPEATS))
    for k in range(3000):
        want = math.floor(sum(tokens) * w[k] + 1e-6)
        assert got[f"d{k}"] == (want // tokens[k] + (want % tokens[k] > 0) if tokens[k] else 1)


# ---- 7 near duplicates


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + minhash.SHINGLE]) for i in range(max(1, len(w) - minhash.SHINGLE + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def near_corpus(rng, n):
    vocab = [f"v{k}" for k in range(3000)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice((1, 1, 2, 5))):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_near_duplicates_against_all_pairs(spark):
    texts = near_corpus(random.Random(5), 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    g = {r.doc_id: (r.group_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    s = [shingles(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(s)), 2) if jaccard(s[a], s[b]) >= minhash.THRESHOLD + 0.05]
    assert len(near) > 100 and sum(g[a][0] == g[b][0] for a, b in near) >= 0.95 * len(near)
    for i, (root, kept) in g.items():
        assert kept == (i == root) and (i == root or max(jaccard(s[i], s[o]) for o in range(len(s)) if o != i and g[o][0] == root) > minhash.THRESHOLD - 0.2)
    left = {r.doc_id for r in minhash.drop_near_duplicates(df).collect()}
    assert left == {i for i, (_, kept) in g.items() if kept}


def test_near_duplicates_edges(spark, docs, rows, clashing, empty):
    for d in (docs, clashing):
        g = [(r.doc_id, r.group_id, r.kept) for r in minhash.near_duplicates(d).collect()]
        assert len(g) == len(rows)
        by = {i: (k, kept) for i, k, kept in g}
        assert by[60] == (0, False) and by[0] == (0, True) and by[62][0] == 7 and by[63] == (63, True) and by[64] == (64, True) and by[None] == (None, True)
        kept = minhash.drop_near_duplicates(d)
        assert kept.columns == d.columns and kept.where("doc_id is null").count() == 2
    assert minhash.near_duplicates(empty).collect() == []


def forest_rows(sig, tree=0):
    """Sorted regions, sketches and the order, as a task gets them."""
    packed = minhash.pack_sketch(sig)
    body = np.roll(packed[:, : minhash.SKETCH], -tree * minhash.STEP // 2, axis=1)
    region = sig[:, tree * minhash.STEP].astype(np.int64) << 16 | sig[:, tree * minhash.STEP + 1]
    order = sorted(range(len(sig)), key=lambda i: (region[i], body[i].tobytes()))
    return region[order], body[order], np.array(order)


def clusters(rng, n, k, noise):
    base = rng.integers(0, 1 << 16, (k, minhash.PERMS)).astype(np.uint16)
    which = rng.integers(0, k, n)
    sig = base[which].copy()
    flip = rng.random(sig.shape) < noise
    sig[flip] = rng.integers(0, 1 << 16, flip.sum()).astype(np.uint16)
    sig[:, : minhash.LEAST] = 7  # one region
    return sig, which


def roots(n, a, b):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        lo, hi = sorted((find(x), find(y)))
        root[hi] = lo
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("enough", [2, 5, 20])
def test_candidates_are_longest_prefix_neighbours(enough):
    """Each row's run against brute force: the deepest prefix that it shares with `enough` rows, or the region."""
    rng = np.random.default_rng(1)
    sig, _ = clusters(rng, 150, 4, 0.15)
    sig[100:, 0] = rng.integers(0, 30, 50)
    region, body, _ = forest_rows(sig)
    start, end = minhash.runs(region, body, enough)
    nib = np.stack([body >> 4, body & 15], axis=2).reshape(len(body), -1)
    for i in range(len(region)):
        best = set(np.flatnonzero(region == region[i]))
        for d in range(minhash.LEAST, minhash.PERMS):
            same = {j for j in np.flatnonzero(region == region[i]) if (nib[j, : d + 1] == nib[i, : d + 1]).all()}
            if len(same) >= enough:
                best = same
        assert set(range(start[i], end[i])) == best


@pytest.mark.parametrize("n,noise", [(900, 0.1), (900, 0.2), (40, 0.1)])
def test_dense_region_connects_every_cluster(n, noise):
    """All six clusters of one region, wholly, and no two of them, with a fraction of the pairs."""
    sig, which = clusters(np.random.default_rng(0), n, 6, noise)
    region, body, order = forest_rows(sig)
    a, b, compared = minhash.region_edges(region, body, enough=16)
    got = roots(n, a, b)
    for k in range(6):
        assert len({got[i] for i in range(n) if which[order[i]] == k}) == 1
    assert len(set(got)) == 6 and (n < 100 or compared < n * n / 4)


def test_matches_in_a_region_are_all_pairs_where_it_is_sparse():
    sig, _ = clusters(np.random.default_rng(3), 60, 20, 0.45)
    region, body, _ = forest_rows(sig)
    nib = np.stack([body >> 4, body & 15], axis=2).reshape(len(body), -1)
    want = [(i, j) for i, j in combinations(range(60), 2) if (nib[i] == nib[j]).sum() >= minhash.needed(minhash.THRESHOLD)]
    a, b, _ = minhash.region_edges(region, body)
    assert want and roots(60, a, b) == roots(60, *zip(*want))


def test_equal_sketches_join():
    sig = np.tile(clusters(np.random.default_rng(0), 1, 1, 0.0)[0], (3000, 1))
    region, body, _ = forest_rows(sig)
    a, b, compared = minhash.region_edges(region, body)
    assert len(a) == 2999 and set(b) == {0} and not compared


def test_large_groups_around_the_threshold(spark):
    """A group of over 700 documents whose pairs are a little above the threshold, and divided regions."""
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(4000)]
    base = [rng.choice(vocab) for _ in range(200)]
    texts = []
    for _ in range(700):
        w = list(base)
        for k in range(0, 200, 12):
            w[k + rng.randrange(12) if k + 12 <= 200 else k] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(vocab) for _ in range(150)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for split in (minhash.SPLIT, 60):
        g = {r.doc_id: r.group_id for r in minhash.near_groups(df, split=split).collect()}
        assert sum(g.get(i) == 0 for i in range(700)) >= 0.99 * 700 and not any(i in g for i in range(700, 800))


def test_near_duplicates_with_other_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "seven eight nine ten"), ("c", "one two three four five six"), ("d", "seven eight nine ten"), (None, "x y z"), ("e", "")]
    df = spark.createDataFrame(rows, "id string, body string").selectExpr("*", "1 as gone", "2 as gone_", "3 as doc_id", "4 as group_id", "5 as sig", "6 as region", "7 as a", "8 as b", "9 as v", "10 as root")
    assert {r.doc_id: r.group_id for r in minhash.near_duplicates(df, "id", "body").collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", None: None, "e": "e"}
    left = minhash.drop_near_duplicates(df, "id", "body")
    assert left.columns == df.columns and sorted(r.id or "" for r in left.collect()) == ["", "a", "e"]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.v: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


# ---- 8 syncmers


def brute_syncmers(t, k, s):
    def h(x, which=0):
        p, base = syncmers.PRIMES[which]
        v = 0
        for c in reversed(x):
            v = (v * base + ord(c)) % p
        return (v * syncmers._A + syncmers._B) % p

    inner, out = [h(t[i : i + s]) for i in range(len(t) - s + 1)], []
    for i in range(len(t) - k + 1):
        w = inner[i : i + k - s + 1]
        if min(w) in (w[0], w[-1]):
            out.append((i, h(t[i : i + k]) << 31 | h(t[i : i + k], 1)))
    return out


def test_syncmers(docs, rows, clashing, empty):
    """Whole texts, the long one too, with production values and others."""
    for k, s in ((syncmers.K, syncmers.S), (20, 6)):
        got = [(r.doc_id, list(zip(r.positions, r.hashes))) for r in syncmers.fingerprints(docs, k, s).collect()]
        same(got, [(i, brute_syncmers(t or "", k, s)) for i, t, *_ in rows])
    assert syncmers.fingerprints(clashing).count() == len(rows) and syncmers.fingerprints(empty).collect() == []
    named = syncmers.fingerprints(docs.selectExpr("concat('d', doc_id) as id", "text as body"), id_col="id", text_col="body")
    assert dict(named.dtypes)["doc_id"] == "string" and named.count() == len(rows)


def test_short_passages_share_an_anchor(spark):
    """Any passage of 51 characters and any benchmark-like item has an anchor, the same wherever it stands."""
    rng = random.Random(16)
    least = 2 * syncmers.K - syncmers.S - 1
    items = [text_of(rng, 30)[:least] for _ in range(60)] + [text_of(rng, rng.randint(12, 25)) for _ in range(40)]
    where = [text_of(rng, 5) + x + text_of(rng, 40) for x in items]
    df = spark.createDataFrame([*enumerate(items), *((1000 + k, t) for k, t in enumerate(where))], "doc_id long, text string")
    got = {r.doc_id: set(r.hashes) for r in syncmers.fingerprints(df).collect()}
    assert all(len(x) >= least for x in items) and all(got[k] and got[k] <= got[1000 + k] for k in range(len(items)))


def test_syncmers_are_context_free(spark):
    rng = random.Random(6)
    passage = text_of(rng, 80)
    df = spark.createDataFrame([(1, passage), (2, text_of(rng, 33) + passage + text_of(rng, 20))], "doc_id long, text string")
    a, b = (dict(zip(r.hashes, r.positions)) for r in syncmers.fingerprints(df).orderBy("doc_id").collect())
    assert a and set(a) <= set(b) and len({b[h] - p for h, p in a.items()}) == 1


# ---- 10 repetition


def brute_repetition(t):
    ws = words(t)
    out = []
    for n in sorted(quality.MAX_SHARE):
        seen, cover = set(), set()
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            if g in seen:
                cover |= set(range(i, i + n))
            seen.add(g)
        out.append(round(sum(len(ws[i]) for i in cover) / max(1, sum(map(len, ws))), 6))
    lines = [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")]
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    return (*out, round(again / max(1, sum(map(len, lines))), 6))


def test_repetition(spark, docs, rows, clashing, empty):
    rng = random.Random(7)
    some = [(i, t) for i, t, *_ in rows] + [(200 + k, " ".join([text_of(rng, 12)] * (1 + k) + [text_of(rng, 40)])) for k in range(5)] + [(300, "same line\n" * 30), (301, " a \nb\n a\n\n \nb c")]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = quality.repetition(df).collect()
    same([(r.doc_id, *r[1:-1]) for r in got], [(i, *brute_repetition(t)) for i, t in some])
    by = {r.doc_id: r.keep for r in got}
    assert not by[300] and not by[204] and by[63] and by[64] and by[66] and by[67]
    assert quality.repetition(clashing).count() == len(rows) and quality.repetition(empty).collect() == []


def test_nothing_here_is_imported_by_the_rest():
    root = pathlib.Path(minhash.__file__).parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "llm" not in p.read_text(), p
