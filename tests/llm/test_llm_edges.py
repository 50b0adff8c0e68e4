"""Nulls, empty and very long texts, repeated rows and ids, empty tables, clashing columns; small cases against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import bpe, decontaminate, embed_dedup, html_text, langid, quality, queries, sharding, simhash, toxicity, urls

#: Extra columns under names that the operators use themselves.
CLASH = ("held_out", "score", "predicted", "vslot", "part", "cell", "fp", "u", "v", "host", "path", "rule", "tokens", "label", "ids", "stats", "kept", "w", "n", "y", "t", "h", "z", "key", "text_crc32", "size", "a", "b", "g")
LONG = "word and word " * 20_000 + "x" * 300 + " end"
ROWS = [(None, None), (None, "a text without an id"), (1, ""), (1, "two texts under one id"), (2, "repeated row"), (2, "repeated row"), (3, LONG), (4, " \n\t "), (5, "ÀÉ 東京 🙂 ß")]


def odd_docs(spark, rows=ROWS):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    return d.select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in d.columns))


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))


WANT = [1, 1, 2, 2, 3, 4, 5, None, None]


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")


def train_docs(spark):
    return spark.createDataFrame([(k, ("vile nasty " if k % 2 else "kind calm ") * 9 + f"w{k}", "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")


def test_toxicity_edges(spark):
    m = toxicity.fit(train_docs(spark), labels(spark), F.lit(True))
    got = toxicity.score(odd_docs(spark), m, keep=("doc_id", "label")).collect()
    assert ids(got) == WANT and all(0 <= r.score <= 1 and r.kept.label == "clash" for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert toxicity.score(odd_docs(spark, []), m).count() == 0
    none = toxicity.fit(odd_docs(spark, []), labels(spark), F.lit(True))
    assert toxicity.score(odd_docs(spark), none).where("predicted = 1 or size(neighbour_ids) > 0").count() == 0
    again = train_docs(spark).unionByName(train_docs(spark).withColumn("text", F.lit("zzz")))
    assert len(toxicity.fit(again, labels(spark), F.lit(True)).ids) == 40  # a repeated id is one example


def test_toxicity_against_plain_cosines(spark):
    """Scores and evidence from dense vectors and votes, ties of cosine by example number."""
    d, lab = train_docs(spark).unionByName(train_docs(spark).withColumn("doc_id", F.col("doc_id") + 100)), labels(spark)
    m = toxicity.fit(d, lab, F.lit(True))
    text = {r.doc_id: r.text for r in d.collect()}
    vec = lambda t: {w: (1 + math.log(c)) * m.idf[m.terms[w]] for w, c in Counter(toxicity.tokens(t)).items() if w in m.terms}
    cos = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    examples = [vec(text[i]) for i in m.ids.tolist()]
    for r in toxicity.score(d, m).where("doc_id % 7 = 0").collect():
        s = [round(cos(vec(text[r.doc_id]), e), 10) for e in examples]
        order = sorted((k for k in range(len(s)) if s[k] > 0), key=lambda k: (-s[k], k))[: toxicity.NEIGHBOURS]
        assert r.neighbour_ids == [int(m.ids[k]) for k in order] and np.allclose(r.neighbour_cosines, [s[k] for k in order])
        w = np.array([m.importance[k] / (1.05 - min(s[k], 1)) for k in order])
        assert math.isclose(r.score, np.interp((w * m.labels[order]).sum() / w.sum(), *m.knots), abs_tol=1e-6)


def test_bpe_edges(spark):
    got = queries.bpe_digest(odd_docs(spark)).collect()
    assert ids(got) == WANT
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, sha(t)) for i, t in ROWS)
    assert queries.bpe_digest(odd_docs(spark, [])).count() == 0
    b = bpe.Bpe.load(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    d = spark.createDataFrame([([72, 101],), ([],), (None,)], "ids array<int>").withColumn("decoded", F.lit("old"))
    assert [None if r.decoded is None else bytes(r.decoded) for r in b.decode(d).collect()] == [b.by_id[72] + b.by_id[101], b"", None]


def test_urls_edges(spark):
    rows = [(1, None), (1, "http://a.org/x"), (2, ""), (2, ""), (None, "x://FREE.Bets.com"), (3, "http://" + "ab" * 400 + ".com/" + "p/" * 500), (4, "http://é.net/ü?x"), (5, "a://b://c/d")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in CLASH})
    got = urls.judge(d, urls.fit(d)).collect()
    assert sorted((r.page_id, r.host) for r in got if r.page_id is not None and r.page_id < 3) == [(1, ""), (1, "a.org"), (2, ""), (2, "")]
    by = {r.page_id: r for r in got if r.page_id not in (1, 2)}
    assert by[None].verdict == "block" and by[None].host == "free.bets.com" and by[3].host == "ab" * 400 + ".com" and (by[4].rule, by[5].host, by[5].path) == ("net/", "b:", "//c/d")
    assert urls.judge(d.limit(0), urls.fit(d.limit(0))).count() == 0 and urls.judge(d, urls.fit(d.limit(0))).count() == len(rows)


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    words = ["river", "free", "bets", "sun", "win", "a", "ab"]
    given = [f"http://{rng.choice(words)}{rng.choice(words)}.{rng.choice(words)}.com/{rng.choice(words)}/{rng.randint(0, 9)}" for _ in range(60)] + ["http://river.com/", "http://sun.com/a"] * 4
    d = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    split = lambda u: re.match(r"http://([^/]*)(.*)", u).groups()
    known = {w for w in (*urls.SEEDS, *urls.KNOWN) if len(w) > 2}

    def cuts(x):
        for n in range(len(x)):
            for at in itertools.combinations(range(1, len(x)), n):
                yield [x[i:j] for i, j in zip((0, *at), (*at, len(x)))]

    def best(x, score):
        return max(cuts(x), key=lambda c: round(score(c), 9))

    counts = Counter(t for u in given for t in split(u)[0].split("."))
    for w in list(counts):
        c = best(w, lambda c: sum(-8.0 if p in known else -math.log(1e6) - 2.5 * len(p) for p in c))
        if w not in (*urls.SEEDS, *urls.KNOWN) and len(c) > 1 and known.issuperset(c):
            del counts[w]
    counts.update(dict.fromkeys((*urls.SEEDS, *urls.KNOWN), urls.KNOWN_COUNT))
    total = sum(counts.values())
    log = lambda p: math.log(counts[p] / total) if p in counts else -math.log(total) - 2.5 * len(p)
    seg = {w: best(w, lambda c: sum(map(log, c))) for w in {t for u in given for t in split(u)[0].split(".")}}
    tokens = [[p for t in split(u)[0].split(".") for p in seg[t]] + ["/" + t for t in split(u)[1].split("/") if t and not t.isdigit()] for u in given]
    block = [not set(urls.SEEDS).isdisjoint(t) for t in tokens]
    b, a = Counter(dict.fromkeys(urls.SEEDS, urls.SEED_COUNT)), Counter()
    for t, y in zip(tokens, block):
        (b if y else a).update(t)
    vocab = set(a) | set(b)
    sb, sa = sum(b.values()) + 0.5 * len(vocab), sum(a.values()) + 0.5 * len(vocab)
    bias = math.log((sum(block) + 1) / (len(block) - sum(block) + 1))
    for r in urls.judge(d, urls.fit(d), rules=()).collect():
        z = bias + sum(math.log((b[t] + 0.5) / sb) - math.log((a[t] + 0.5) / sa) for t in tokens[r.page_id])
        assert r.tokens == tokens[r.page_id] and math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6) and r.verdict == ("block" if z >= 0 else "allow")


def test_langid_edges(spark):
    m = langid.fit(train_docs(spark), F.lit(True), queries.tokenizer_file("piece_bpe_32k.model"))
    got = langid.predict(odd_docs(spark), m).collect()
    assert ids(got) == WANT and {r.lang_pred for r in got if r.doc_id == 4} == {"und"}
    assert langid.predict(odd_docs(spark, []), m).count() == 0
    long = langid.fit(spark.createDataFrame([(k, ("ab" * 100 if k % 2 else "xy" * 100), "p" if k % 2 else "q") for k in range(8)], "doc_id long, text string, lang string"), F.lit(True), queries.tokenizer_file("piece_bpe_32k.model"))
    assert langid.predict(spark.createDataFrame([(0, "abab"), (1, "xyxy")], "doc_id long, text string"), long).orderBy("doc_id").toPandas().lang_pred.tolist() == ["p", "q"]
    nothing = langid.fit(odd_docs(spark, []), F.lit(True), queries.tokenizer_file("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(odd_docs(spark), nothing).collect()} == {"und"}


def test_sharding_and_simhash_edges(spark):
    assert ids(sharding.shard(odd_docs(spark), 8)[0].collect()) == WANT
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert ids(got) == WANT
    assert all(r.fp == simhash.fingerprint(t) - (1 << 64 if simhash.fingerprint(t) >> 63 else 0) for r in got for i, t in ROWS if i == r.doc_id and i in (2, 3, 5))


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "word and word and"), (1, "repeated row"), (None, "end"), (2, None), (3, ""), (2, "a text")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontaminate.judged(decontaminate.find(odd_docs(spark), bench, keep=("doc_id", "host"))).collect()
    assert ids(got) == WANT and all(r.kept.doc_id == r.doc_id for r in got)
    assert {(r.n_words, r.n_hit, tuple(r.item_ids)) for r in got if r.doc_id == 2} == {(2, 2, ("1",))}
    assert decontaminate.find(odd_docs(spark, []), bench).count() == 0


def test_large_benchmarks_take_passes(spark, monkeypatch):
    """Blocks of a few bytes, one to a pass, give what one automaton gives."""
    bench = spark.createDataFrame([(k, f"word and word {t}") for k, t in enumerate(("", "end", "x", "and", "row"))] + [(9, "repeated row"), (None, "repeated"), (7, "text without an")], "item_id long, text string")
    rows = lambda d: sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.item_ids, r.spans, r.kept.label) for r in d.collect())
    whole = rows(decontaminate.find(odd_docs(spark), bench, keep=("label",)))
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 1)
    assert rows(decontaminate.find(odd_docs(spark), bench, keep=("label",), block_bytes=30)) == whole and any(r[2] for r in whole)


def test_quality_edges_and_equations(spark):
    stats = quality.document_statistics(train_docs(spark).withColumn("text", F.concat("text", F.repeat(F.lit("!? "), F.col("doc_id").cast("int")))))
    m = quality.fit(stats, labels(spark), F.col("doc_id") % 5 != 0)
    got = quality.score(quality.document_statistics(odd_docs(spark), keep=("doc_id", "score")), m).collect()
    assert ids(got) == WANT and all(0 <= r.score <= 1 and r.kept.score == "clash" for r in got)
    assert quality.score(quality.document_statistics(odd_docs(spark, [])), m).count() == 0
    rows = sorted((r.doc_id, r.stats) for r in stats.collect() if r.doc_id % 5)
    x, y = np.array([s for _, s in rows]), np.array([i % 2 for i, _ in rows], float)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0) + 1e-6, atol=1e-5)
    z = m.features(x)
    assert np.allclose(m.beta[-1], np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y), atol=1e-6)


def test_html_edges(spark):
    long = "<article>" + "<p>one two</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (1, "http://a/", "<article>x"), (2, "", ""), (2, "", ""), (None, "http://b/", "<p>plain</p>"), (3, "u", long), (4, "u", '<!-- <article > --><script>"<article >"</script><p>only</p>'),
            (5, "u", '<article><h2 class="post-header">T</h2><div class="social-history">kept</div><div class="comment-list">gone</div></article>')]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASH})
    got = html_text.extract(d).collect()
    assert len(got) == len(rows) and sorted(r.text for r in got if r.page_id in (1, 2)) == ["", "", "", "x"]
    by = {r.page_id: r.text for r in got}
    assert by[None] == "plain" and by[3].count("\n") == 19_999 and by[4] == "only" and by[5] == "T\nkept"
    assert html_text.extract(d.limit(0)).count() == 0


def test_embedding_edges(spark, monkeypatch):
    """Repeated ids keep all their rows; two vectors of one id are two points; empty tables; too low a recall ends in exact links."""
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, one, 0), (1, None, 0), (2, one, 0), (2, [0.0, 1.0, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.0, 0.01], 0), (None, one, 0), (4, [0.0] * 4, 0), (5, one, None), (6, one, 1), (6, one, 1), (7, [], 0), (8, [1e300, 0.0, 0.0, 0.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in CLASH if c != "label"})
    for recall in (0.999, 1.1):
        monkeypatch.setattr(embed_dedup, "RECALL", recall) if recall <= 1 else monkeypatch.setattr(embed_dedup, "_audit", lambda p, *a: p.select("label").distinct().withColumns({"found": F.lit(0.0), "true": F.lit(1.0)}))
        found, audit = embed_dedup.near_duplicates(d)
        got = Counter((r.vec_id, r.n_links, r.component_id) for r in found.collect())
        assert got == Counter([(1, 2, 1), (1, 0, 1), (2, 2, 1), (2, 1, 2), (3, 1, 2), (None, 0, None), (4, 0, 4), (5, 0, 5), (6, 1, 6), (6, 1, 6), (7, 0, 7), (8, 2, 1)])
        assert audit.recall == 1.0
    monkeypatch.undo()
    assert embed_dedup.near_duplicates(d.limit(0))[0].count() == 0


def test_pipeline_runs_whole(spark, tmp_path):
    """run() against the operators applied one after the other in plain Python."""
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice("the sun and a river of light on old stone walls".split()) for _ in range(60)) + "."
    item = " ".join(f"q{k}" for k in range(20))
    texts = [good() + (" vile nasty" * 8 if k % 5 == 1 else "") + (" $$$ !!! %%% ###" * 9 if k % 5 == 2 else "") for k in range(120)]
    texts += [texts[0], texts[0], item, good() + " " + item[:30]]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(None, texts[5], "en", "s", 1), (None, item, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 2), int(k % 5 == 1)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert not kept & {k for k in range(120) if k % 5 in (1, 2)} and not kept & {120, 121, 122}
    assert {k for k in range(120) if k % 5 in (0, 3, 4)} <= kept and sum(r.doc_id is None for r in got) == 1
    text = dict(enumerate(texts))
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in got if r.doc_id is not None)


def test_embeddings_write_little(spark, monkeypatch):
    """Vectors that link with nothing leave no lists behind, and vectors are not dealt once for each tree."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[1:200:2] = x[0:200:2] * 2 + 0.01
    d = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").withColumn("label", F.lit(0))
    made, keep = [], embed_dedup.materialize
    monkeypatch.setattr(embed_dedup, "materialize", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    monkeypatch.setattr(embed_dedup, "discard", lambda df: None)
    found, audit = embed_dedup.near_duplicates(d)
    got = [r.n_links for r in found.orderBy("vec_id").collect()]
    assert got == [1] * 200 + [0] * 2800 and audit.recall == 1.0
    assert sum(t.count() for name, t in made if name == "embed-lists") < 1000
    assert sum(p.stat().st_size for _, t in made for p in Path(t._strandframe_path.removeprefix("file:")).glob("*.parquet")) < 3 * x.nbytes
