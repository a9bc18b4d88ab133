"""The operators for training data against brute force, on small tables with nulls, empty and very long texts, ties,
repeated rows, no rows, and clashing column names."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest

from ledgerlynx.llm import bpe, boosting, hnsw, html_extract, jaccard, packing, pii, quality, sharding, training_order, url_filter
from ledgerlynx.llm.graph import components

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORDS = "the of and river stone green walks under bright seven lantern quiet market harbour winter".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ed"]) for _ in range(n))


def texts():
    base = prose(1, 80)
    words = base.split()
    near = " ".join(words[:40] + ["altered"] + words[41:])
    return [base, base, near, prose(2, 90), prose(3, 60), None, "", "two words", "two words", "word " * 3000, prose(4, 9000), "Ünïcode — 漢字 🙂  \x1c tabs\t\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "src", k) for k, t in enumerate(texts())]
    # clashing names: columns that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, sig string, shard string, id long")


def test_packing(docs):
    out = packing.pack_documents(docs, RANKS, JSON, P.PATTERN, capacity=256, with_ids=True).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    for k, t in enumerate(texts()):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = out[out.doc_id == k].sort_values("piece")
        assert [i for x in own.ids for i in x] == ids and own.start.tolist() == list(np.cumsum([0, *own.length])[:-1])
        assert (own.length.iloc[1:] == 256).all() and own.length.max() <= 256
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids]
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all(np.cumsum([0, *g.length])[:-1].tolist() == g.offset.tolist() and g.length.sum() <= 256 for _, g in by)
    assert by.ngroups <= -(-out.length.sum() // 256) + 1


def test_packing_of_long_and_short_pieces_apart(spark):
    # one partition has an open bin for each piece, another the pieces that fill them
    long, short = 60_000, 60_000
    pieces = spark.range(0, long + short, 1, 2).selectExpr("id as row", "id as doc_id", "0 as piece", "0L as start", f"if(id < {long}, 140L, 110L) as length", "0L as ids_crc32")
    out = packing.pack(pieces, 256).toPandas()
    one = packing.pack(pieces, 256, group_rows=200_000).toPandas()
    assert len(out) == long + short and one.sequence_id.nunique() == long and out.sequence_id.nunique() < 1.01 * long
    for found in (out, one):
        by = found.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert by.length.sum().max() <= 256 and ((found.sort_values(["sequence_id", "offset"]).length.groupby(found.sequence_id).cumsum() - found.length) == found.offset).all()


def test_packing_of_special_tokens_and_no_rows(spark):
    special = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    out = packing.pack_documents(special, RANKS, JSON, P.PATTERN, with_ids=True).first()
    assert out["ids"] == [64, 50256, 65, 0]
    assert packing.pack_documents(special.where("false"), RANKS, JSON, P.PATTERN).count() == 0


def test_sharding(docs, spark):
    out = sharding.shard_documents(docs, n_shards=4, blocks=8).toPandas()
    sizes = [len((t or "").encode()) + 8 for t in texts()]
    assert out.sort_values("doc_id")["size"].tolist() == sizes
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.groupby("group_key").shard.nunique().max() == 1
    groups = out.groupby("group_key")["size"].sum().sort_index().tolist()

    def fits(c):
        n, room = 1, c
        for s in groups:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= 4

    best = next(c for c in range(1, sum(sizes) + 1) if fits(c))
    assert out.capacity.iloc[0] == best and out.groupby("shard")["size"].sum().max() <= best
    assert sharding.shard_documents(docs.where("false"), 4).count() == 0


def test_sharding_refines_cells(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) || id as text")
    out = sharding.shard_documents(many, n_shards=7).toPandas().sort_values("group_key")
    sizes, cap = out["size"].tolist(), int(out.capacity.iloc[0])

    def shards(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    assert shards(cap) <= 7 < shards(cap - 1)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")


def test_near_duplicates(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(6, 16))
    rows = [(k, (base[k % 6] + rnd.normal(scale=0.12, size=16)).tolist(), k % 2 if k % 11 else None, "x") for k in range(240)]
    rows += [(500, rows[1][1], rows[1][2], "x"), (501, None, 1, "x"), (502, [0.0] * 16, 1, "x"), (503, [float("nan")] * 16, 1, "x"), (504, [None] * 16, 1, "x"), (505, [1.0, 2.0], 1, "x"), (506, [2.0, 4.0], 1, "x"), (507, [float("inf")] * 16, 1, "x")]
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(vectors(spark, rows), shard=64).collect()}
    fit = {i: (np.array(e, np.float64), lab) for i, e, lab, _ in rows if e and lab is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)}
    links = {i: {j for j, (f, lj) in fit.items() if j != i and lj == li and len(f) == len(e) and e @ f / np.sqrt((e @ e) * (f @ f)) >= 0.93} for i, (e, li) in fit.items()}
    found = total = 0
    for i, _, _, _ in rows:
        want = len(links.get(i, ()))
        assert got[i]["n_links"] <= want
        found, total = found + got[i]["n_links"], total + want
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert found >= 0.99 * total and got[502]["component_id"] == 502
    want = brute_components([r[0] for r in rows], [(a, b) for a, bs in links.items() for b in bs])
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all((r["recall"] is None) == (k not in fit) and (r["recall"] or 1) >= 0.99 for k, r in got.items())
    assert hnsw.near_duplicates(vectors(spark, rows).where("false")).count() == 0


def test_near_duplicates_of_a_crowd(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=24)
    rows = [(k, (base + rnd.normal(scale=0.02, size=24)).tolist(), 1, "x") for k in range(1000)] + [(1000 + k, rnd.normal(size=24).tolist(), 1, "x") for k in range(300)]
    rows += [(2000 + k, [1.0] * 24, 1, "x") for k in range(40)]  # ties
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(vectors(spark, rows), shard=400).collect()}
    assert all(got[k]["component_id"] == 0 and got[k]["n_links"] == 999 for k in range(1000))
    assert all(got[2000 + k]["component_id"] == 2000 and got[2000 + k]["n_links"] == 39 for k in range(40))


def test_small_world_recall():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(1500, 24)) + 2 * rnd.normal(size=(30, 24))[rnd.integers(0, 30, 1500)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids, _ = hnsw.SmallWorld(x).query(x[:200], 48)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) > 0.95


def test_byte_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = {r["doc_id"]: r for r in bpe.encode_documents(docs, path, P.PATTERN).collect()}
    for k, t in enumerate(texts()):
        ids = enc.encode_ordinary(t or "")
        assert out[k]["ids"] == ids and out[k]["n_tokens"] == len(ids)
        assert out[k]["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest() and out[k]["decoded_sha256"] == sha256((t or "").encode()).hexdigest()
    codec = bpe.Codec(path, P.PATTERN)
    assert codec.encode("x" * 20000) == enc.encode_ordinary("x" * 20000)
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FF), rnd.randrange(0x3040, 0x30FF), 0x1F600, 10, 0x85])) for _ in range(rnd.randrange(40)))
        assert codec.encode(t) == enc.encode_ordinary(t) and codec.decode(codec.encode(t)) == t.encode()


def test_perfect_hash():
    ranks = {f"key {k}".encode(): k for k in range(3000)}
    table = bpe.PerfectHash(ranks)
    rank = table.lookup()
    assert all(rank(k) == v for k, v in ranks.items()) and rank(b"no key") == -1 and None not in table.keys


def test_quality(docs, spark):
    out = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert [out[k]["kept"] for k in (0, 3, 5, 6, 7, 9, 10)] == [True, True, False, False, False, False, True]
    assert out[5]["n_words"] == 0 and out[9]["n_repeat_words"] == 3000 and out[9]["base_failed"]
    assert quality.base_counts("a b c d a b c\n\nx|# y\nx|# y".encode()) == (11, 15, 4, 1, 6)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs.where("false")).count() == 0
    assert quality.quality_rules(docs.where("false")).count() == 0


def test_quality_base_counts_against_brute_force():
    import re

    rnd = random.Random(8)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", "é", "\x1c", "\x85", " ", " ", "\n", "\n\n", "\t", "#", "a b a b ", "x y\n"]) for _ in range(rnd.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.base_counts(text.encode()) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_quality_bands_decide(spark):
    rnd = random.Random(4)
    natural = [(k, prose(k, 60 + 7 * k)) for k in range(120)]
    junk = [
        (500, " ".join(f"{rnd.getrandbits(200):x}" for _ in range(60))),
        (501, " ".join(f"numbered-item-{k:05d}" for k in range(200))),
        (502, prose(900, 700) + " " + " ".join(f"numbered-item-{k:05d}" for k in range(300)) + " " + prose(901, 900)),
    ]
    rows = spark.createDataFrame(natural + junk, "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality.quality_rules(rows).collect()}
    assert not any(out[k]["base_failed"] or out[k]["kept"] for k, _ in junk) and out[502]["bad_chunks"] >= 0.25
    assert sum(out[k]["kept"] for k, _ in natural) >= 118
    assert {r["doc_id"] for r in quality.keep_good(rows).collect()} == {k for k, r in out.items() if r["kept"]}
    # by hand: medians and quartiles of each octave, then the rule
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    excess = {k: (len(t.encode()), len(squeeze(t.encode())) / len(t.encode()) - quality.usual(len(t.encode()))) for k, t in natural + junk}
    for k, (size, own) in excess.items():
        peers = sorted(e for i, (n, e) in excess.items() if n.bit_length() == size.bit_length() and n >= 256 and not out[i]["base_failed"])
        q1, middle, q3 = (peers[max(0, -(-len(peers) * a // 4) - 1)] for a in (1, 2, 3))
        centre, spread = len(peers) * middle / (len(peers) + 20), (len(peers) * (q3 - q1) / 1.349 + 1.4) / (len(peers) + 20)
        if size >= 256 and out[k]["bad_chunks"] == 0:
            assert out[k]["kept"] == (abs(own - centre) <= 4 * spread), k


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><nav><a>Home</a></nav>
<div class="cookie-notice">We use cookies</div><header>Site</header><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b><p>Second&nbsp;&#8212; line<br>break
<form><input value="x">Send</form></article><div id="comments"><p>nice post</p></div><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://a.x/1", PAGE), (2, None, None), (3, "http://a.x/2", ""), (4, "b", "plain text only"), (4, "b", "plain text only")]
    out = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert out[0]["text"] == "Title & more First bold Second — line break" and out[0]["n_chars"] == len(out[0]["text"])
    assert [r["text"] for r in out[1:]] == ["", "", "plain text only", "plain text only"]
    host = [(k, f"http://h.x/{k}", f"<body><div class=b1><p>Same words on every page</p></div><div class=b2><p>{prose(k, 20)}</p></div></body>") for k in range(12)]
    out = html_extract.extract_text(spark.createDataFrame(host, "page_id long, url string, html string")).collect()
    assert all(r["text"] == prose(r["page_id"], 20) for r in out)


def test_html_of_a_host_with_many_templates(spark):
    def page(k, section):
        return f"<body><div class=s{section}><div class=b1><p>Unmarked words of section {section}</p></div><div class=b2><p>{prose(k, 20)}</p></div></div></body>"

    rows = [(k, f"http://hot.x/{k}", page(k, k % 6)) for k in range(60)]  # each section is on a sixth of the host
    out = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 60 and all(r["text"] == prose(r["page_id"], 20) for r in out)


def test_html_that_is_not_as_it_should_be(spark):
    def text(html):
        blocks, tree, _, _ = html_extract.page_parts(html)
        return html_extract.main_text(blocks, tree, {})

    assert text("<a title=don't>one</a><p>two's</p>") == "one two's" and text('<p class=x">one') == "one" and text("<script src=x />var a</script>t") == "t"
    assert text("<div class=free-form>a</div><div class=header-image-story>b</div><div class=comment-list>c</div><div id=cookieNotice>d</div>") == "a b"
    assert text("<div>x" * 20_000) == " ".join("x" * 20_000)
    many = spark.createDataFrame([(k, "http://h.x/", "<div>" * 3000 + "x", "c") for k in range(3)], "page_id long, url string, html string, row string")
    assert [r["text"] for r in html_extract.extract_text(many).collect()] == ["x"] * 3 and html_extract.extract_text(many.where("false")).count() == 0


@pytest.mark.parametrize("most", [html_extract.MOST_JUDGED, 0])
def test_html_keeps_what_is_important_inside_an_unimportant_branch(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "MOST_JUDGED", most)

    def page(k):
        own = f"<section><p>{prose(k, 20)}</p></section>" if k < 9 else ""
        return f"<body><div class=z><p>Same words</p>{own}</div><ul><li>{prose(500 + k, 9)}</li></ul></body>"

    out = html_extract.extract_text(spark.createDataFrame([(k, f"http://h.x/{k}", page(k)) for k in range(200)], "page_id long, url string, html string")).collect()
    assert all(r["text"] == (f"{prose(r['page_id'], 20)} " if r["page_id"] < 9 else "") + prose(500 + r["page_id"], 9) for r in out)


def brute_components(ids, links):
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def test_jaccard(spark, docs):
    rnd = random.Random(9)
    base = prose(20, 120).split()
    made = list(texts())
    for k in range(60):  # near copies around the threshold
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(10_000)}"
        made.append(" ".join(w))
    shared = prose(30, 60)
    made += [f"{shared} {prose(100 + k, 25)}" for k in range(40)]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(made)], "doc_id long, text string, sig string")
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(df).collect()}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in made]
    links = [(a, b) for a in range(len(made)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = brute_components(range(len(made)), links)
    assert {k: r["component_id"] for k, r in got.items()} == want and all(got[k]["n_shingles"] == len(s) for k, s in enumerate(sets))
    assert jaccard.jaccard_components(df.where("false")).count() == 0
    assert set(jaccard.one_of_each(df).columns) == set(df.columns)


def test_jaccard_of_crowds_and_passages(spark):
    rnd = random.Random(11)
    base, passage = prose(50, 200).split(), " ".join(f"p{k}" for k in range(60))
    made = []
    for k in range(200):  # 200 that link by one passage and more, and 200 that share a passage and don't
        words = list(base)
        words[rnd.randrange(200)] = f"w{k}"
        made.append(" ".join(words))
    made += [passage + " " + " ".join(f"u{k}x{i}" for i in range(40)) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert all(got[k] == 0 for k in range(200)) and all(got[k] == k for k in range(200, 400))


def test_jaccard_keeps_one_row_of_repeated_ids(spark):
    a, b = prose(60, 80), prose(61, 80)
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "z"), (3, b, "x"), (None, b, "x"), (None, b, "y"), (4, None, "x"), (4, None, "x"), (5, "", "x")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted([(1, a), (3, b), (0, b), (4, ""), (5, "")])


def test_jaccard_signatures_that_clash():
    s = np.arange(10, dtype=np.uint64)
    h = jaccard.signature(s)
    assert jaccard.signature(s, frozenset([h])) != h and jaccard.signature(s, frozenset([h + 1])) == h
    big, small = jaccard.parity(np.arange(600, dtype=np.uint64)), jaccard.parity(np.arange(500, dtype=np.uint64))
    half = len(big) // 2
    assert len(small) == half and sum(int(x).bit_count() for x in ((big[:half] ^ big[half:]) ^ small).view(np.uint64)) <= 100


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 150), (7, 7)]
    out = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(out[k] == 0 for k in range(31)) and out[200] == out[150] == 100


def test_urls(spark):
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("allow", "com", "/fr/")]
    urls = ["https://A.Example.ORG/es/1?x", "http://example.org/fr/", "http://x.com/fr/casino", "http://x.net/casino/1", "http://x.net/casinos1/", "http://x.net/free-bonus", "http://x.net/free", None, "no scheme porn", "http://x.net/c%61sino", "http://fakeorg/", "http://q.org"]
    out = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [r["verdict"] for r in out] == ["block", "allow", "allow", "block", "allow", "block", "allow", "allow", "block", "block", "allow", "allow"]
    assert [r["rule"] for r in out] == ["example.org/es/", "org/", "com/fr/"] + [None] * 9
    assert (out[0]["host"], out[0]["path"], out[7]["host"], out[8]["path"], out[11]["path"]) == ("a.example.org", "/es/1", "", "", "")


def test_urls_against_brute_force_and_sql(spark):
    import re
    from urllib.parse import unquote_to_bytes

    import duckdb

    from ledgerlynx.llm.queries import URL_RULES
    from ledgerlynx.llm.sql import ORACLES

    rnd = random.Random(1)
    parts = [*url_filter.STRICT_TERMS, *url_filter.SOFT_TERMS, "a", "Xx", "é", "%20", "%66ree", "+", "?", "#", "/fr/", "/es/"]
    urls = [None, "", "x", "://", "http://h.net/" + "casin" * 20_000] + [f"http://{rnd.choice(['H', 'a.example', 'example'])}.{rnd.choice(['net', 'org', 'com'])}/" + "".join(rnd.choice(parts) + rnd.choice(["", "-", "/", "_", "%2D"]) for _ in range(rnd.randrange(6))) for _ in range(600)]
    pages = spark.createDataFrame([(k, u, "clash", 1) for k, u in enumerate(urls)], "page_id long, url string, rest string, n_soft int")
    got = url_filter.filter_urls(pages, URL_RULES).orderBy("page_id").collect()
    for u, r in zip(urls, got, strict=True):
        text = unquote_to_bytes((u or "").encode().lower()).lower().decode("utf-8", "replace")
        hits = {t: len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)) for t in (*url_filter.STRICT_TERMS, *url_filter.SOFT_TERMS)}
        assert (r["n_strict"], r["n_soft"]) == (sum(hits[t] for t in url_filter.STRICT_TERMS), sum(hits[t] > 0 for t in url_filter.SOFT_TERMS))
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    assert con.sql(f"select page_id, host, path, rule, verdict, n_strict, n_soft from ({ORACLES['op8_url_filters']}) order by page_id").fetchall() == [tuple(r) for r in got]
    assert url_filter.filter_urls(pages.where("false"), URL_RULES).count() == 0


def test_personal_data(spark):
    text = "mail joe.b+1@mail.example.com or 10.0.0.256 and 10.20.30.40, card 4111 1111 1111 1111, not 4111 1111 1111 1112, call +1 (555) 010-2030 é🙂 +12"
    rows = [(1, text), (2, None), (3, ""), (4, "a@b no dot"), (5, "x" * 200_000 + "@" + "9" * 50_000)]
    out = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    spans = out[1]["spans"].split(",")
    assert [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in spans)] == ["joe.b+1@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (555) 010-2030"]
    assert (out[1]["n_email"], out[1]["n_ip"], out[1]["n_card"], out[1]["n_phone"]) == (1, 1, 1, 1) and out[1]["base_sha256"] == sha256(out[1]["spans"].encode()).hexdigest()
    assert all(out[k]["spans"] == "" for k in (2, 3, 4, 5))
    assert pii.redact(text, [{"kind": "email", "start": 5, "stop": 29}]).startswith("mail <EMAIL> or")


def test_disguised_personal_data_at_every_size(spark):
    planted = ["write to joe at mail dot com now", "they saw a[at]b.com there", "seen 10[.]0[.]0[.]1 in logs", "call (555) 010-2030 today", "card 4111.1111.1111.1111 is", "tel 555.010.2030 and"]
    hidden = ["joe at mail dot com", "a[at]b.com", "10[.]0[.]0[.]1", "(555) 010-2030", "4111.1111.1111.1111", "555.010.2030"]
    clean = ["on 2024-01-15 we met", "arrived at Paris.The next", "version 10 dot 2 dot 3 dot 4", "order 555-010-2030 is late", "host 300[.]0[.]0[.]1 failed", "card 4111.1111.1111.1112 no", "paid 12 345 678 900 in all"]
    filler = [f"mail u{k}@m{k % 9}.example.com or +1 (555) 01{k % 10}-{1000 + k} or {k % 200}.1.2.3 in serial {2669109448945251 + 10 * k}" for k in range(400)]
    # disguised data that is frequent in the table must not count against itself
    for more in ([], filler, filler + planted * 100):
        found = pii.find_personal_data(spark.createDataFrame(list(enumerate(planted + clean + more)), "doc_id long, text string"))
        out = {r["doc_id"]: [(planted + clean)[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]] for r in found.where(f"doc_id < {len(planted + clean)}").collect()}
        assert [out[k] for k in range(len(planted + clean))] == [[h] for h in hidden] + [[]] * len(clean)


def test_spans_of_many_candidates_in_one_text():
    base = " ".join(f"10.0.{k // 250}.{k % 250}" for k in range(20_000))
    text = base + " " + " ".join(f"10[.]0[.]{k // 250}[.]{k % 250}" for k in range(5_000))
    found = pii.spans_of(text)
    ips = [s for s in found if s["kind"] == pii.IP]
    assert sum(s["base"] for s in ips) == 20_000 and sum(not s["base"] for s in ips) >= 5_000
    spans = [pii.Span(s["kind"], s["start"], s["stop"], s["base"]) for s in pii.spans_of(base[:3000] + " 1[.]2[.]3[.]4")]
    own = [s for s in spans if s.base]
    assert all(s.stop <= b.start or b.stop <= s.start for s in spans if not s.base for b in own)


def test_boosting_held_out():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.boost(x[:2000], y[:2000])
    scores = trees.score(x[2000:])
    assert ((scores > 0.5) == y[2000:]).mean() > 0.95
    cut = boosting.threshold_for(scores, y[2000:], 0.98)
    assert y[2000:][scores >= cut].mean() >= 0.98


def test_training_order(docs, tmp_path, spark):
    for n in (1, 2, 3, 1000):
        slots = training_order.permute(np.arange(n), n, 7)
        assert sorted(slots) == list(range(n)) and (training_order.permute(slots, n, 7, inverse=True) == np.arange(n)).all()
    folder = str(tmp_path / "out")
    out = training_order.write_in_order(docs, folder, RANKS, JSON, P.PATTERN, key=3, stride=64, per_shard=16, end_id=50256).toPandas().sort_values("slot")
    n = len(out)
    assert out.slot.tolist() == list(range(n)) and sorted(out.number) == list(range(n))
    read = list(training_order.read_slots(folder, 0, n, 64, 16))
    assert [zlib.crc32(x.tobytes()) for x in read] == out.tokens_crc32.tolist()
    assert (read[20] == next(training_order.read_slots(folder, 20, 1, 64, 16))).all()
    total = sum(len(packing._encoder(RANKS, JSON, P.PATTERN)(t)) + 1 if t else 1 for t in texts())
    assert out.n_tokens.sum() == total
    # the tasks' chains one after the other, cut and put into their slots, are the files
    chains, encode = {}, packing._encoder(RANKS, JSON, P.PATTERN)
    from pyspark.sql import functions as F

    for r in docs.withColumn("part", F.spark_partition_id()).collect():
        chains.setdefault(r["part"], []).extend([*(encode(r["text"]).tolist() if r["text"] else []), 50256])
    cut = [c[a : a + 64] for _, c in sorted(chains.items()) for a in range(0, len(c), 64)]
    slots = training_order.permute(np.arange(n), n, 3)
    assert len(cut) == n and all(read[slots[k]].tolist() == c + [50256] * (64 - len(c)) for k, c in enumerate(cut))
    assert sorted(p.name for p in (tmp_path / "out").glob("*.bin")) == [f"shard-{k:08d}.bin" for k in range(-(-n // 16))]
    assert training_order.write_in_order(docs.where("false"), folder + "2", RANKS, JSON, P.PATTERN, key=3).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        training_order.write_in_order(docs, folder + "3", RANKS, JSON, P.PATTERN, key=3, dtype="u1")


def test_packing_over_several_rounds(spark):
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(20, 256, 30_000)
    pieces = spark.createDataFrame([(k, k, 0, 0, int(v), 0) for k, v in enumerate(lengths)], "row long, doc_id long, piece int, start long, length long, ids_crc32 long").repartition(8)
    out = packing.pack(pieces, 256, group_rows=1500).toPandas()
    assert len(out) == 30_000 and out.groupby("sequence_id").length.sum().max() <= 256
    best = packing.best_fit(lengths, 256)[0].max() + 1
    assert max(-(-lengths.sum() // 256), (lengths > 128).sum()) <= out.sequence_id.nunique() <= 1.02 * best


def test_packing_by_a_tree_of_three_levels(spark):
    rnd = np.random.default_rng(4)
    lengths = np.concatenate([rnd.integers(20, 256, 30_000), rnd.integers(140, 250, 8_000)])
    pieces = spark.createDataFrame([(k, k, 0, 0, int(v), 0) for k, v in enumerate(lengths)], "row long, doc_id long, piece int, start long, length long, ids_crc32 long").repartition(8)
    for group_rows in (400, 40):  # 95 groups, and 950 of a few bins each, whose lightest bins must travel far
        out = packing.pack(pieces, 256, group_rows=group_rows).toPandas().sort_values(["sequence_id", "offset"])
        assert len(out) == len(lengths) and (out.length.groupby(out.sequence_id).cumsum() - out.length == out.offset).all()
        used = out.groupby("sequence_id").length.sum()
        assert used.max() <= 256 and (2 * used <= 256).sum() <= 1
        if group_rows == 400:
            assert out.sequence_id.nunique() <= 1.02 * (packing.best_fit(lengths, 256)[0].max() + 1)


def test_bins_to_hand_up():
    used = np.array([255, 200, 130, 129, 60, 140, 256])
    assert np.flatnonzero(packing.to_hand_up(used, 256, 2)).tolist() == [2, 3, 4]
    assert np.flatnonzero(packing.to_hand_up(used, 256, 9)).tolist() == [1, 2, 3, 4, 5]
