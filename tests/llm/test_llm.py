import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import bpe, decontaminate, embed_dedup, html_text, langid, quality, queries, sharding, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, vslot int, part string, y int, label string"


def docs(spark, texts, lang="en"):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, lang, "s", len(t or ""), 1, "x", 7, "z") for k, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n", "same text here", "same text here", "é" * 30, "word " * 3000, "a b c d e"]


def test_sharding(spark):
    rows, m = sharding.shard(docs(spark, ODD * 40 + [f"text {k} " * (k % 50) for k in range(400)]), 8)
    got = rows.collect()
    assert len(got) == 720
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    again = sharding.rebalance(m, 9)
    moved = {b for a, b in zip(m.shard, again.shard) if a != b}
    assert moved == {8} and again.version == 2
    small = sharding.rebalance(m, 7)
    assert max(small.shard) < 7 and all(a == b for a, b, n in zip(m.shard, small.shard, m.rows) if a < 7 and n)
    assert sharding.shard(docs(spark, []), 8)[0].count() == 0


def test_sharding_against_brute_force(spark, tmp_path):
    """Sizes, checksums, near equal bytes; only copies of the one hot text part, small groups of its slot stay together."""
    import zlib

    hot = "the hot text " * 20
    texts = [None, "", *[hot] * 3000, *(f"group {k % 40}" for k in range(400)), *(f"é {k} " * (k % 90) for k in range(2000))]
    path = f"{tmp_path}/map"
    rows, m = sharding.shard(docs(spark, texts), 8, slots=3, store_path=path)
    got = rows.collect()
    raw = [(t or "").encode() for t in texts]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [(k, len(b) + 1, zlib.crc32(b)) for k, b in enumerate(raw)]
    where: dict = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if t != hot) and len(where[hot]) > 1
    rows, _ = sharding.shard(docs(spark, texts), 8)
    load = {s: n for s, n in rows.groupBy("shard").agg(F.sum("size")).collect()}
    assert max(load.values()) < 1.02 * sum(load.values()) / 8
    sharding.store(spark, sharding.rebalance(m, 9), path)
    assert sharding.load(spark, path) == sharding.rebalance(m, 9) and sharding.load(spark, path, 1) == m
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.store(spark, m, path)


def brute_hits(text, items, n=13):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for i, t in items:
        x = decontaminate.words(t)
        for a in range(max(1, len(x) - n + 1)) if x else ():
            win = x[a : a + n]
            for b in range(len(w) - len(win) + 1):
                if w[b : b + len(win)] == win:
                    hit |= set(range(b, b + len(win)))
                    found.add(i)
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("ab cd ef gh é".split())
    items = [(str(k), " ".join(word() for _ in range(n))) for k, n in enumerate((3, 13, 20, 14, 0))]
    texts = [*ODD, "X-" + items[2][1].upper().replace("É", "é") + "! tail", *(" ".join(word() for _ in range(60)) for _ in range(10))]
    bench = spark.createDataFrame([(int(i), t) for i, t in items] + [(9, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find(docs(spark, texts), bench).collect()}
    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].n_hit, got[k].item_ids) == brute_hits(t, items)
    s = got[len(ODD)].spans
    assert texts[len(ODD)][s[0].start : s[0].end].lower() == items[2][1]
    assert decontaminate.find(docs(spark, ODD), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("the of and to in is") + str(rng.randint(0, 40)) for _ in range(80)) for _ in range(20)]
    texts = ODD + base + [b.replace("the1 ", "a ", 1) for b in base] + base[:5]
    fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    comp = np.arange(len(texts))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    for _ in texts:
        comp = np.array([comp[m].min() for m in near])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(comp.tolist()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_grid_loses_no_link(spark):
    """Every pair within four bits shares a cell; runs of any length keep it connected."""
    rng = random.Random(3)
    a = [rng.getrandbits(64) for _ in range(40)]
    b = [x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for x in a]
    s = lambda x: x - (1 << 64) if x >> 63 else x
    cells = {}
    for r in simhash.grid(spark.createDataFrame([(s(x),) for x in a + b], "fp long")).collect():
        cells.setdefault(r.fp, set()).add(r.cell)
    assert all(cells[s(x)] & cells[s(y)] for x, y in zip(a, b))
    u, v = simhash._forest(np.array([0, 1, 3, 7, 15, 31, 1 << 60], np.uint64))
    assert {int(x) for x in np.concatenate([u, v])} == {0, 1, 3, 7, 15, 31, 1 << 60}


def test_bpe_against_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    b = bpe.Bpe.load(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    texts = [*ODD, "It's  déjà-vu!!\n\n  x <|endoftext|> 東京    🙂 42", "unforeseeable counterrevolutionaries " * 3]
    for limit in (4, 1000):
        coded = bpe.encode(docs(spark, texts), b, public_tokenizers.PATTERN, limit=limit)
        for r in b.decode(coded).collect():
            assert r.ids == enc.encode_ordinary(texts[r.doc_id] or "")
            assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def merges(word, ranks):
    """Lowest rank first, leftmost first."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_bpe_long_words_and_any_ranks(spark):
    """Words on both sides of the bound of the one-pass fold; ranks whose merges fall as well as rise."""
    import public_tokenizers

    b = bpe.Bpe.load(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    assert b.ordered
    rng = random.Random(5)
    texts = ["z" * 700, "é" * 100, "y" * 62, "x" * 63, "東" * 21, "東" * 20 + "a", "#" * 63 + "\n" * 200, None]
    texts += ["".join(rng.choice("aeinrst") for _ in range(n)) for n in (5, 20, 61, 62, 63, 90)]
    words = ["abc", "abcd", "cdab", "abab", "bcdab", "aaaaa", "dcbabcd" * 12, ""]
    few = {bytes([k]): k for k in range(256)} | {w.encode(): 256 + k for k, w in enumerate(("abcd", "cd", "ab", "bc", "aa", "dab", "da"))}
    odd = bpe.Bpe(few)
    assert not odd.ordered
    for own, given in ((b, texts), (odd, words), (odd, ["abcd abcd", "xabcdx"])):
        for r in bpe.encode(docs(spark, given), own, public_tokenizers.PATTERN, limit=2).collect():
            import regex

            want = [i for w in regex.findall(public_tokenizers.PATTERN, given[r.doc_id] or "") for i in merges(w.encode(), own.ranks)]
            assert r.ids == want


def test_bpe_windows_change_no_result(spark):
    """Words whose windows are all listed, some of them or none, with long tokens that start in a window and tokens cut off by the end."""
    b = bpe.Bpe.load(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(8)
    tokens = [t for t in b.ranks if len(t) > 5 and t.isascii()]
    words = ["".join(rng.choice(tokens).decode()[: rng.randint(2, 12)] for _ in range(rng.randint(1, 4))) for _ in range(300)]
    words += [chr(rng.randint(97, 122)) * rng.randint(1, 62) for _ in range(30)] + ["é東" * rng.randint(1, 12) for _ in range(9)] + ["ab", "abc", "a", ""]
    d = docs(spark, words)
    for own in (b, b.fitted(w.encode() for w in words[::2]), b.fitted(w.encode() for w in words)):
        coded = own.unbind(own.bind(d).withColumn("ids", F.expr(own.let(own.encode_word("text")))))
        assert {r.doc_id: r.ids for r in coded.collect()} == {k: merges(w.encode(), b.ranks) for k, w in enumerate(words)}


@pytest.mark.parametrize("head", [0, 10, 40])
def test_block_max_search_is_exact(head):
    rng = np.random.default_rng(0)
    w = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    index = toxicity.BlockMaxIndex.build(w, head)
    for _ in range(20):
        ids = sorted(rng.choice(40, 5, replace=False).tolist())
        q = rng.random(5)
        n, s = index.search([(np.array(ids), q)], 15)[0]
        full = w[:, ids] @ q
        order = np.lexsort((np.arange(500), -full))[:15]
        order = order[full[order] > 0]
        assert n.tolist() == order.tolist() and np.allclose(s, full[order])


def labelled(spark, good, bad, n=300):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(good + (bad if k % 3 == 0 else [])) for _ in range(60)) for k in range(n)]
    d = docs(spark, texts + ODD)
    lab = spark.createDataFrame([(k, int(k % 3 != 0), int(k % 3 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")
    return d, lab.unionByName(lab.limit(3)), n


def test_toxicity(spark):
    d, lab, n = labelled(spark, [f"w{chr(97 + k)}" for k in range(20)], ["nasty", "vile"])
    m = toxicity.fit(d, lab, F.col("doc_id") % 5 != 0)
    got = toxicity.score(d, m).collect()
    assert len(got) == n + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id < n]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id >= n)
    assert toxicity.score(d, toxicity.fit(d, lab.limit(0), F.lit(True))).where("predicted = 1").count() == 0


def test_toxicity_indexes_rare_terms(spark):
    """Toxic texts whose telling words stand in one or two examples; equal texts have cosine 1."""
    d, lab, n = labelled(spark, [f"w{chr(97 + k)}" for k in range(20)], ["nasty", "vile"])
    rare = ["zig zag zog zug", "zig zag zog zug", "qua quo", "zig zag zog"]
    more = spark.createDataFrame([(1000 + k, t, "en", "s", 1) for k, t in enumerate(rare)], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.select(more.columns).unionByName(more)
    m = toxicity.fit(d, lab.unionByName(spark.createDataFrame([(1000, 0, 1), (1001, 0, 1), (1002, 0, 0)], lab.schema)), F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(d, m).where("doc_id >= 1000").collect()}
    assert [got[1000 + k].predicted for k in range(4)] == [1, 1, 0, 1]
    assert got[1000].neighbour_ids == got[1003].neighbour_ids and sorted(got[1000].neighbour_ids) == [1000, 1001] and got[1002].neighbour_ids == [1002]
    assert np.allclose(got[1001].neighbour_cosines, 1) and np.allclose(got[1002].neighbour_cosines, 1)


def test_quality(spark):
    d, lab, n = labelled(spark, ["plain", "words", "here."], ["$$$", "JUNK!!", "%%%"])
    stats = quality.document_statistics(d)
    got = quality.score(stats, quality.fit(stats, lab, F.col("doc_id") % 5 != 0)).collect()
    assert len(got) == n + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in got if r.doc_id < n]) > 0.95
    none = quality.score(stats, quality.fit(stats, lab.limit(0), F.lit(True))).collect()
    assert {r.score for r in none} == {0.5}


def brute_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p.get(word[:k], 0.0) * brute_segmentations(word[k:], p) for k in range(1, len(word) + 1))


def test_forward_sum_over_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba"]
    p = np.array([0.0, 0.2, 0.1, 0.1, 0.2, 0.1, 0.2, 0.1, 0.0])[:, None]
    words = ["▁abab", "▁baab"]
    got = langid.Lattice(pieces).log_likelihood(words, 5, p)[:, 0]
    table = dict(zip(pieces, p[1:-1, 0]))
    assert np.allclose(np.exp(got), [brute_segmentations(w, table) for w in words])
    e = langid.Lattice(pieces).expected({"▁ab": 1.0}, p[:, 0])
    assert e @ np.array([1, *(len(x) for x in pieces), 0]) == pytest.approx(3)  # expected pieces cover the word


def test_langid(spark):
    en, de = "the house and the garden of the people with this", "das haus und der garten der leute mit dieser ist"
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice((en if k % 2 else de).split()) for _ in range(30)), "en" if k % 2 else "de") for k in range(80)] + [(80, None, "en"), (81, "12 ..", "de"), (82, "", None), (83, "z" * 5000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(d, F.col("doc_id") % 4 != 2, queries.tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in langid.predict(d, m).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows[:80])
    assert [got[k].lang_pred for k in (80, 81, 82)] == ["und"] * 3 and 0 <= got[83].score <= 1


def test_urls(spark):
    u = ["http://A.Example.net/en/1?x", "https://example.com/de/", "x.org/fr/", None, "http://b.org/fr/9#t", "http://cheappills.example.com/en", "http://quietriver.example.com/en/2", "http://", "http://net"]
    u += [f"http://quiet{k % 17}river.example.com/en/{k}" for k in range(200)] + [f"http://{h}.example.com/en/{k}" for k in range(5) for h in ("cheap-pills", "spam-farm", "casino-win")]
    d = spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(d, urls.fit(d)).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict, got[4].rule, got[4].verdict) == ("example.com/de/", "block", "org/fr/", "allow")
    assert (got[2].host, got[2].path, got[3].host, got[3].rule) == ("", "", "", None)
    assert got[5].tokens[:2] == ["cheap", "pills"] and got[5].verdict == "block" and got[6].verdict == "allow"
    assert got[8].rule is None and got[8].host == "net"


def test_html(spark):
    page = """<html><head><title>T</title></head><body><nav><p>Menu</p></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>
      three<br>four<p>five<script>x()</script><aside>note</aside><div class="comments"><article>me too</article></div></article><footer>f</footer>"""
    head, foot = "Shared menu of this site with many words in it today", "Copyright of this site and its owners since long ago now"
    plain = [f"<p>{head}</p><p>Story number {k} tells of {k * 7} things</p><p>{foot}</p>" for k in range(6)]
    rows = [(0, "http://a/", page), (1, "http://a/", None), (2, None, "")] + [(10 + k, "http://b/x", h) for k, h in enumerate(plain)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "A & B\nOne two three\nfour\nfive" and got[0].n_chars == len(got[0].text)
    assert got[1].text == got[2].text == ""
    assert got[13].text == "Story number 3 tells of 21 things"


@pytest.mark.parametrize("bound", [html_text.HOST_TOKENS, 20])
def test_html_repeats_are_sought_over_the_whole_host(spark, monkeypatch, bound):
    """Few pages of a host, many partitions that stay apart; a mark in a dropped part; a repeated row."""
    monkeypatch.setattr(html_text, "HOST_TOKENS", bound)
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "32")):
        spark.conf.set(key, value)
    try:
        head = "Shared menu of this site with many words in it today"
        rows = [(k, "http://b/x", f"<p>{head}</p><p>Story number {k} tells of {k * 7} things</p>{'<aside><article>x</article></aside>' if k % 2 else ''}") for k in range(6)]
        rows += [rows[0], (50, "http://c/", f"<p>{head}</p>")]
        got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [(k, f"Story number {k} tells of {k * 7} things") for k in (0, *range(6))] + [(50, head)]
    assert sorted((r.page_id, r.text) for r in got) == want


def test_repeated_runs_against_brute_force():
    rng = random.Random(8)
    pages = [[rng.choice("abc") for _ in range(40)] for _ in range(4)] + [[]]
    got = html_text.repeated(pages, 5)
    for k, p in enumerate(pages):
        others = {tuple(q[i : i + 5]) for j, q in enumerate(pages) if j != k for i in range(len(q) - 4)}
        want = np.zeros(len(p), bool)
        for i in range(len(p) - 4):
            if tuple(p[i : i + 5]) in others:
                want[i : i + 5] = True
        assert got[k].tolist() == want.tolist()


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[200:230] = x[150]
    rows = [(k, [float(np.float32(v)) for v in r], k % 2 if k < 100 else 0) for k, r in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[0][1], None), (304, [], 0), (305, [1.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, audit = embed_dedup.near_duplicates(d)
    got = {r.vec_id: r for r in got.collect()}
    assert audit.recall >= 0.999 and len(got) == len(rows)
    v = x.astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:300]])
    link = (v @ v.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    assert [got[k].n_links for k in range(300)] == link.sum(1).tolist()
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(300, 306))
    assert got[139].component_id == 0 and got[229].component_id == 150


def brute_links(x, of):
    v = x.astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.93) & (of[:, None] == of[None, :])
    np.fill_diagonal(link, False)
    return link.sum(1).tolist()


def vectors(spark, x, of):
    return spark.createDataFrame([(k, [float(np.float32(v)) for v in r], int(of[k])) for k, r in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_embeddings_crowded_leaf(spark):
    """A label made up of one tight group stands whole in one leaf of every tree."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + 1e-6 * rng.normal(size=(900, 16))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors(spark, x, np.zeros(900)))[0].collect()}
    assert {r.component_id for r in got.values()} == {0}
    assert [got[k].n_links for k in range(900)] == brute_links(x, np.zeros(900))


def test_embeddings_isolated_pairs_are_not_drowned(spark, monkeypatch):
    """Trees that find one large group only: the audit of its label notices the missed pairs and all pairs are compared."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    x[:200] = x[0] + 0.02 * rng.normal(size=(200, 16))
    x[301:400:2] = x[300:400:2] + 0.1 * rng.normal(size=(50, 16))
    of = np.array([k >= 420 for k in range(500)])
    leaves = embed_dedup._leaves
    monkeypatch.setattr(embed_dedup, "_leaves", lambda *a: leaves(*a).where("a < 200 and b < 200"))
    found, audit = embed_dedup.near_duplicates(vectors(spark, x, of))
    got = {r.vec_id: r.n_links for r in found.collect()}
    assert audit.recall >= 0.999 and [got[k] for k in range(500)] == brute_links(x, of)


def test_pipeline_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "decontamination", "bpe"]
    d = docs(spark, ODD)
    out = corpus_pipeline.simhash_stage(spark, d, "")
    assert out.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in out.collect()} == {0, 3, 5, 6, 7}


def test_digest(spark):
    r = queries.bpe_digest(docs(spark, [None])).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty)


def test_simhash_stage_keeps_null_ids_and_different_texts(spark):
    rows = [(None, "one clean text of its own words", "en", "s", 1), (None, "and quite another text with no id", "en", "s", 1), (4, "a text that is here twice over", "en", "s", 1), (4, "a text that is here twice over", "en", "s", 1)]
    out = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted(r.text[:3] for r in out) == ["a t", "and", "one"]


def test_stages_decide_by_row(spark, tmp_path):
    """Bad rows without an id go; a clean text stays though a bad one shares its id."""
    d, lab, n = labelled(spark, ["plain", "words", "here."], ["nasty", "vile", "$$$"])
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = d.where(F.col("doc_id") < n).select(*corpus_pipeline.COLUMNS)
    good, bad = "plain words here. " * 20, "nasty vile $$$ " * 20
    for stage, worse in ((corpus_pipeline.toxicity_stage, bad), (corpus_pipeline.quality_stage, bad), (corpus_pipeline.decontamination_stage, item)):
        more = spark.createDataFrame([(None, worse, "en", "s", 1), (None, good, "en", "s", 1), (9000, worse, "en", "s", 1), (9000, good, "en", "s", 1)], d.schema)
        out = stage(spark, d.unionByName(more), str(tmp_path)).where("doc_id IS NULL OR doc_id = 9000")
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, good), (9000, good)]
