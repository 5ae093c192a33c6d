"""The pipeline's stages against brute force on a small corpus."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lossledger.llm import _text, entry, minhash, mixing, packing, toxicity
from lossledger.llm._blob import unpack, unpack_sorted
from test_corpus_operators import CLASH, DDL, brute_fit, brute_lines, jaccard, shingles, signed, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(1500)]
    bad = ["vile", "scumbag", "wretch", "vermin"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = "\n".join(text(20) for _ in range(4))
    rows, toxic = [], {}
    for i in range(420):
        lines = [text(rng.randint(8, 30)) for _ in range(rng.randint(1, 6))]
        toxic[i] = int(i % 7 == 3)
        if toxic[i]:
            lines = [f"{x} {rng.choice(bad)} {text(3)} {rng.choice(bad)}" for x in lines]
        rows.append((i, "\n".join(lines), "en", "big" if i % 5 else f"s{i % 2}"))
    rows += [(500 + k, f"{text(60)}\n{passage}\n{text(50)}", "en", "big") for k in range(5)]  # a shared passage
    for k in range(20):  # near copies
        w = rows[k * 7][1].replace("\n", " ").split(" ")
        w[len(w) // 2] = "changed"
        rows.append((600 + k, " ".join(w), "en", "s1"))
    rows += [(700 + k, rows[k * 7 + 1][1], "en", "big") for k in range(10)]  # exact copies
    rows += [(800, None, None, None), (801, "", "en", "big"), (None, text(30), "en", "big"), (802, text(5000), "en", "big"), (802, "short one", "en", "s0")]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DDL).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items() if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows, toxic


def test_stages(spark, sf_dir):
    where, rows, toxic = sf_dir
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = f"{where}/stage-{k}"
        stage(spark, docs, where).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
        old = [(r.doc_id, r.text, r.source) for r in before.select("doc_id", "text", "source").collect()]
        new = docs.collect()
        if name == "toxicity":
            left = {r.doc_id for r in new}
            wrong = [i for i, t in toxic.items() if (i in left) == bool(t)]
            assert len(wrong) <= 8 and {500, 600, 800, 801, 802, None} <= left
        elif name == "line dedup":
            want = [(i, t) for i, t, n, cut in brute_lines([(i, t) for i, t, _ in old]) if not cut or cut < n]
            assert Counter((r.doc_id, r.text) for r in new) == Counter(want)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in new)
            by = {r.doc_id: r.text for r in new}
            assert by[500].count("\n") == 5 and by[501].count("\n") == 1
        elif name == "near duplicates":
            s = {i: shingles(t) for i, t, _ in old if i is not None and shingles(t)}
            left = {r.doc_id for r in new}
            near = [(a, b) for a in s for b in s if a < b and jaccard(s[a], s[b]) >= minhash.THRESHOLD + 0.1]
            assert near and all(b not in left for a, b in near) and sum(a in left for a, _ in near)
            lonely = [i for i in s if all(o == i or jaccard(s[i], s[o]) < minhash.THRESHOLD - 0.2 for o in s)]
            assert set(lonely) <= left and {None, 800} <= left
        elif name == "mixing":
            size = Counter()
            for _, t, z in old:
                size[z] += len((t or "").split())
            names = list(size)
            w = mixing.weights([size[z] for z in names], mixing.exponent([size[z] for z in names], sum(size.values()), mixing.ENTROPY_SHARE * math.log(sum(1 for z in names if size[z])), mixing.MAX_REPEATS))
            took = Counter()
            for r in new:
                took[r.source] += len((r.text or "").split())
            for z, x in zip(names, w):
                assert 0 <= took[z] - math.floor(sum(size.values()) * x + 1e-6) < 5001
        else:
            fill = Counter()
            for r in new:
                if r.bin is not None:
                    fill[r.bin] += r.length
            lengths = [n for _, t, _ in old for n in pieces(len((t or "").split()))]
            assert sorted(packing.CAPACITY - n for n in fill.values()) == brute_fit(lengths, packing.CAPACITY)
        kept[name] = len(new)
    assert corpus_pipeline.run(spark, where).count() == kept["packing"]


def test_stages_on_edges(spark, tmp_path_factory):
    """Empty tables, and few rows with nulls in every column and further columns of all names that the code uses."""
    where = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(1, 1, 1), (None, 0, None), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    rows = [(1, "a b c\nd e f\ng h i", "en", "s", 17), (2, "a b c\nd e f\ng h i\nmore", None, None, None), (3, None, None, None, None), (None, "", "en", "s", 0), (4, "x y z", "en", "t", 5), (4, "x y z", "en", "t", 5)]
    some = spark.createDataFrame(rows, DDL).selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASH])
    for docs in (some, some.limit(0)):
        n = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, where)
            assert out.columns == (docs.columns if k < 4 else ["doc_id", "piece", "start", "length", "bin", "bin_offset"])
            path = f"{where}/{n}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == ({1, 2, 3, 4, None} if n else set())  # none is lost; the mixture repeats some


def pieces(n):
    return [packing.CAPACITY] * (n // packing.CAPACITY) + [n % packing.CAPACITY] * bool(n % packing.CAPACITY)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.QUERIES) == list(range(1, 11)) and set(entry.SQL) <= set(entry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "packing"]


def test_toxicity_stage_drops_documents_two_links_from_the_seeds(spark, tmp_path):
    """Documents whose only lexicon word is never beside a toxic seed."""
    rare = "case when id < 60 then ' gronk gronk' when id < 120 then ' gronk snarl' when id < 180 then ' snarl blurk' when id < 200 then ' blurk blurk blurk' else '' end"
    docs = spark.range(600).selectExpr("id as doc_id", f"concat('w', id % 50, ' w', id * 7 % 53, {rare}, ' w', id % 31, ' w', id % 43, ' w', id % 29) as text")
    spark.range(300).selectExpr("id as doc_id", "if(id < 60, 1, 0) as toxic").where("doc_id < 60 or doc_id >= 200").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()} == set(range(200, 600))


def test_toxicity_stage_walks_every_significant_pair(spark, sf_dir, monkeypatch):
    """The edges that the stage walks against all pairs of the corpus, for words numbered and in rows; word_graph(), a part of them, isn't called."""
    where, rows, _ = sf_dir
    n, c = Counter(), Counter()
    for _, t, *_ in rows:
        ws = words(t)
        n.update(ws)
        c.update(frozenset((x, y)) for d in range(1, toxicity.WINDOW + 1) for x, y in zip(ws, ws[d:]) if x != y)
    want = {}
    for (x, y), k in ((tuple(p), k) for p, k in c.items()):
        e = 2 * toxicity.WINDOW * n[x] * n[y] / sum(n.values())
        if k > e and 2 * (k * math.log(k / e) - (k - e)) >= toxicity.MIN_G2:
            want[x, y] = want[y, x] = math.log(k / e)
    name = dict(zip(signed(_text.word_hash(list(n))), n))
    bad = {"vile", "scumbag", "wretch", "vermin"}
    near = bad | {y for x, y in want if x in bad}
    assert sum(x not in near and y not in near for x, y in want) > 100
    got = []

    def numbered(graph):
        for k, keys, count in graph.edges.collect():
            key = unpack_sorted(keys)
            x, y = (key >> np.uint64(32)).astype(np.int64) * graph.bins + k, (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            w, _ = toxicity._association(unpack(count).astype(np.int64), graph.count[x], graph.count[y], graph.total, graph.window)
            got.extend(zip(signed(graph.hash[x]), signed(graph.hash[y]), w.tolist()))
        return walk(graph)

    def in_rows(half):
        edges = both(half)
        got.extend(map(tuple, edges.select("i", "j", "w").collect()))
        return edges

    walk, both = toxicity.Graph.polarity, toxicity.both_ways
    monkeypatch.setattr(toxicity, "word_graph", None)
    monkeypatch.setattr(toxicity.Graph, "polarity", numbered)
    monkeypatch.setattr(toxicity, "both_ways", in_rows)
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    left = []
    for stage in (lambda: corpus_pipeline.drop_toxic(spark, docs, where), lambda: toxicity.drop_toxic(docs, labels, most=0)):
        got.clear()
        left.append(Counter((r.doc_id, r.text) for r in stage().collect()))
        assert len(got) == len(want) and {(name[i], name[j]): w for i, j, w in got} == pytest.approx(want)
    assert left[0] == left[1] and left[0].total() < len(rows)
