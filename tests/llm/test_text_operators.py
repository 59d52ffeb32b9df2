"""Token counts, sentence pieces, quality rules, line chain and pages against plain versions."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from veilmark.llm import page_text, quality_classifier, quality_rules, sentence_pieces, token_counts
from veilmark.llm.queries import model_file

ODD = [None, "", " ", "  a  b ", "\n\n a", "▁ab ▁", "日本語😀x", "<s>hi</s><0x41>", "a" * 3000, "=====a====aaaa aa aaa", "\x00\x01", "word " * 5000, "tail "]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file())


def odd_docs(spark, texts=ODD):
    rows = [(i if i % 4 else None, t, "x", 1) for i, t in enumerate([*texts, texts[-1]])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, copy int")


def test_every_prefix():
    own, c = library(), token_counts.PrefixCounter(model_file())
    rng = random.Random(1)
    for _ in range(400):
        s = "".join(rng.choice("aab  eth.=▁é日😀\n") for _ in range(rng.randrange(25)))
        want = [len(own.encode(s[:i])) for i in range(len(s) + 1)]
        assert c.prefixes(s) == want
        for budget in (0, 1, 3, 7):
            assert c.measured(s, budget) == (want[-1], max(i for i, n in enumerate(want) if n <= budget))


def test_count_tokens(spark):
    own = library()
    docs = odd_docs(spark)
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, model_file()).collect()]
    want = [(r.doc_id, len((r.text or "").encode()), n := len(own.encode(r.text or "")), n > 4096) for r in docs.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert token_counts.count_tokens(docs.limit(0), model_file()).count() == 0
    asked = token_counts.answers(token_counts.count_tokens(docs.filter("doc_id IS NOT NULL"), model_file()), F.lit(7), F.lit(3)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in asked:
        assert r.count_at_chars == len(own.encode(texts[r.doc_id][:7])) and len(r.prefix_steps) == len(texts[r.doc_id])
        assert r.chars_within == max(i for i in range(len(texts[r.doc_id][:60]) + 1) if len(own.encode(texts[r.doc_id][:i])) <= 3)


def test_pieces_against_the_library(spark):
    """The rebuilt backend's ids are the library's; parity says so, and `faithful` has the library's where they aren't."""
    own = library()
    docs = odd_docs(spark)
    rows = sentence_pieces.encode(docs, model_file(), keep=("text",)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = own.encode(r.text or "")
        assert r.parity is (list(r.token_ids) == want) and r.n_tokens == len(r.token_ids)
        assert r.round_trip is ("▁" not in (r.text or ""))
    assert sum(r.parity for r in rows) >= len(rows) - 1
    assert all(list(r.token_ids) == own.encode(r.text or "") for r in sentence_pieces.encode(docs, model_file(), keep=("text",), faithful=True).collect())
    back = sentence_pieces.decode(sentence_pieces.encode(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), model_file()), model_file())
    want = {r.doc_id: (r.text or "").replace("▁", " ") for r in docs.collect() if r.doc_id is not None}
    assert {r.doc_id: r.text for r in back.collect()} == want
    assert sentence_pieces.encode(docs.limit(0), model_file()).count() == 0


def test_codec_forgets_nothing():
    """Words that go and come again with a small bound, in lots and alone, have the backend's ids for the whole text."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé日 \n.=<") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    codec = sentence_pieces.Codec(model_file(), 1, kept_words=60)
    for _ in range(150):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(8))) for _ in range(3)]
        ids, same, back = codec.encode(texts)
        assert ids.to_pylist() == [e.ids for e in codec.fast.encode_batch(texts, add_special_tokens=False)]
        assert same == [x == codec.own.encode(t) for x, t in zip(ids.to_pylist(), texts)] and all(back) and len(codec.young) + len(codec.old) < 70


def test_unigram_backend_of_real_size(tmp_path):
    """32,000 pieces with scores as a unigram model with white space folded: whole texts by the rebuilt backend and the library."""
    import sentencepiece.sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model_file(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    m.normalizer_spec.remove_extra_whitespaces = True
    for k, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -4 - np.log1p(k) - 0.0001 * (k * 7919 % 1000)
    path = tmp_path / "big.model"
    path.write_bytes(m.SerializeToString())
    codec = sentence_pieces.Codec(str(path), 2)
    assert not codec.by_word
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu,.é") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    ids, same, back = codec.encode([*texts, "", "日本 😀"])
    assert sum(same) == len(same) and all(back) and ids.to_pylist() == codec.own.encode([*texts, "", "日本 😀"])


def test_unigram_backend(tmp_path):
    """A unigram model file with scores and byte fallback, made by hand: the rebuilt backend agrees with the library."""
    import sentencepiece
    import sentencepiece.sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = 1, True, 0
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    m.normalizer_spec.name = "identity"
    for piece, score, kind in [("<unk>", 0, 2), *((f"<0x{b:02X}>", 0, 6) for b in range(256)), ("▁", -3, 1), ("▁a", -2, 1), ("a", -4, 1), ("b", -4.5, 1), ("ab", -5, 1), ("▁ab", -6.5, 1), ("ba", -5.5, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    own, fast = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentence_pieces.rebuild(str(path))
    for n in range(5):
        for t in map("".join, itertools.product("ab é", repeat=n)):
            assert fast.encode(t, add_special_tokens=False).ids == own.encode(t), t


def plain_statistics(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


TEXTS = [None, "", "a b c a b c", "a a a a", "x y z", "# a\nb\n# a\n \n \n", "p|q " * 30, "é\x1cf g", "one two three\none two three\n" * 3, " ".join(f"w{i}" for i in range(60))]


def test_statistics():
    rng = random.Random(2)
    more = ["".join(rng.choice("ab \n#\t") for _ in range(rng.randrange(60))) for _ in range(200)]
    for t in TEXTS + more:
        assert quality_rules.statistics(t)[:5] == plain_statistics(t), t


def test_rules(spark):
    good = [" ".join(f"word{(i * 7 + k) % 91}x" for k in range(80)) + "." for i in range(30)]
    bad = [" ".join(f"W{k}$$$ |" for k in range(80)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate([*TEXTS, *good, *bad])], "doc_id long, text string, votes string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert len(got) == docs.count()
    for i, t in enumerate([*TEXTS, *good, *bad]):
        n, _, _, _, rep = plain_statistics(t)
        assert got[i].base_failed is (n < 50 or 100 * rep > 50 * n)
        assert not (got[i].base_failed and got[i].kept)
    n = len(TEXTS)
    assert all(got[n + i].kept for i in range(30)) and not any(got[n + 30 + i].kept for i in range(12))
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_base_columns_by_sql(spark):
    """The statistics of a whole table by SQL, and the verdicts by a plain loop of expectation and maximisation over the documents."""
    import duckdb

    from veilmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, sf).collect()}
    want = duckdb.sql(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{sf}/documents.parquet'),
    w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    g AS (SELECT *, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs FROM w),
    e AS (SELECT doc_id, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS x FROM g), c AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(3) o(k) GROUP BY doc_id)
    SELECT doc_id, len(ws), coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), len(ls) - len(list_distinct(ls)), coalesce(r.n, 0) FROM g LEFT JOIN r USING (doc_id)""").fetchall()
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.values()} == set(want)
    docs = [r for r in got.values() if not r.base_failed]
    prior, start = 0.7, [{0: 0.5, 1: 0.15, 2: 0.35}, {0: 0.1, 1: 0.6, 2: 0.3}]
    rules = range(len(quality_rules.RULES))
    like = [[dict(start[c]) for _ in rules] for c in (0, 1)]
    for _ in range(200):
        post = []
        for r in docs:
            p = [1 - prior, prior]
            for c in (0, 1):
                for k in rules:
                    p[c] *= like[c][k][int(r.votes[k])]
            post.append(p[1] / (p[0] + p[1]))
        for c in (0, 1):
            for k in rules:
                mass = {v: start[c][v] + sum((q if c else 1 - q) for r, q in zip(docs, post) if int(r.votes[k]) == v) for v in (0, 1, 2)}
                like[c][k] = {v: m / sum(mass.values()) for v, m in mass.items()}
        prior = min(max((sum(post) + 1) / (len(docs) + 2), 1e-6), 1 - 1e-6)
    assert all(abs(r.quality - q) < 1e-6 for r, q in zip(docs, post)) and all(r.kept is (not r.base_failed and r.quality >= 0.5) for r in got.values())


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    counts = {}
    truth = rng.random(20_000) < 0.8
    seen = np.where(rng.random((20_000, 5)) < 0.85, truth[:, None], ~truth[:, None]).astype(int)
    for row in seen:
        counts["".join(map(str, row))] = counts.get("".join(map(str, row)), 0) + 1
    post = quality_rules.fit(counts)
    called = np.array([post["".join(map(str, r))] >= 0.5 for r in seen])
    assert (called == truth).mean() > 0.96 and quality_rules.fit({}) == {}


def plain_marginals(chain, bins):
    own = chain.scores(bins)
    total, good = 0.0, np.zeros(len(own))
    for ys in itertools.product((0, 1), repeat=len(own)):
        w = np.exp(sum(o for o, y in zip(own, ys) if y) + sum(chain.pair[a][b] for a, b in zip(ys, ys[1:])))
        total += w
        good += w * np.array(ys)
    return good / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    names, bins = len(quality_classifier.NAMES), quality_classifier.BINS
    chain = quality_classifier.Chain(rng.normal(size=(3, names, bins)) / 5, rng.normal(size=1), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        b = rng.integers(0, bins, (n, names)).astype(np.uint8)
        assert np.allclose(chain.marginals(b), plain_marginals(chain, b))
        own = chain.scores(b)
        good, _ = quality_classifier._forward_backward(own[None], chain.pair, np.array([n]))
        assert np.allclose(good[0], plain_marginals(chain, b))


def test_training_raises_the_likelihood():
    """The fitted chain is better than all its neighbours in weight space: the gradient that it stops at is that of numeric differences."""
    rng = np.random.default_rng(2)
    docs = []
    for i in range(60):
        y = i % 2
        b = np.clip(rng.normal(3 + 3 * y, 1.5, (rng.integers(1, 6), len(quality_classifier.NAMES))), 0, 9).astype(np.uint8)
        docs.append((b, np.ones(len(b)), y))
    chain = quality_classifier.train(docs, rounds=400, rate=0.05)

    def fit(c):
        return sum(float(np.mean(np.log(np.clip(np.where(y, c.marginals(b), 1 - c.marginals(b)), 1e-12, 1)))) for b, _, y in docs) / len(docs)

    best = fit(chain)
    assert best > -0.05 and all(chain.score(b, s) > 0.5 if y else chain.score(b, s) < 0.5 for b, s, y in docs)
    assert best > fit(quality_classifier.Chain(chain.weights * 0, chain.first * 0, chain.pair * 0)) + 0.5
    bins, sizes = np.zeros((5000, 14), np.uint8), np.arange(5000.0)
    thin = quality_classifier.thinned(bins, sizes, 640)
    assert len(thin[0]) == len(thin[1]) <= 640 and (thin[1][:64] == np.arange(64)).all() and quality_classifier.thinned(bins, sizes, 5000)[0] is bins


def prose(i):
    rng = random.Random(i)
    return "\n".join(" ".join(rng.choice(["the", "river", "stone", "walks", "along", "quiet"]) for _ in range(9)).capitalize() + "." for _ in range(4))


def junk(i):
    rng = random.Random(i)
    return "\n".join(" ".join(rng.choice(["BUY", "NOW", "WIN"]) + "!!" for _ in range(9)) for _ in range(4))


def test_classifier_on_held_out(spark):
    docs = spark.createDataFrame([(i, prose(i) if i % 3 else junk(i), "en") for i in range(240)] + [(None, "", "en"), (500, None, "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1)], "doc_id long, quality int")
    rows = quality_classifier.classify(docs, labels, bound=200).collect()
    assert len(rows) == 242
    held = [r for r in rows if r.held_out]
    assert all(r.held_out is (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in rows)
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id is not None and r.doc_id < 240) and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.classify(docs, labels.limit(0)).count() == 242 and quality_classifier.classify(docs.limit(0), labels).count() == 0


PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header><a href="/">Home</a></header><div id="cookie-notice">We use</div>
<main><h1>T &amp; t {i}</h1><p>a  b{i}<br>c<p>d{i} &#233;<ul><li>x{i}<li>y{i}</ul><script>var t="</p>";</script><div class="comments"><p>c{i}</p></div><div class="zz">Join us now</div></main>
<div class="wrap sidebar-left"><article><p>in {i}</p></article></div><div class="zzz">Same on all pages</div><footer>f</footer></body></html>"""


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], "page_id long, url string, html string, text string, host int")


def test_pages(spark):
    rows = [(i, "http://h.org/a", PAGE.replace("{i}", str(i))) for i in range(6)] + [(7, None, "<p>only"), (8, "http://h.org/b", None), (9, "u", ""), (None, "http://x.y", "text & <b>bold</b>word")]
    got = {r.page_id: r for r in page_text.main_text(pages_frame(spark, rows)).collect()}
    assert got[3].text == "T & t 3\na b3 c\nd3 é\nx3\ny3\nin 3" and got[3].n_chars == len(got[3].text)
    assert got[7].text == "only" and got[8].text == got[9].text == "" and got[None].text == "text & boldword"
    salted = {r.page_id: r.text for r in page_text.main_text(pages_frame(spark, rows), few=-1).collect()}
    assert salted == {k: r.text for k, r in got.items()}
    assert page_text.main_text(pages_frame(spark, rows).limit(0)).count() == 0


def alone(page):
    nodes, blocks = page_text.parse(page)
    return page_text.pruned(nodes, blocks, {}, {}, 0.3)


def test_page_priors():
    """Names and tags that only look like something else stay, odd markup doesn't leak, and what says what it is goes."""
    body = "<article><h1>Shares</h1>{}<p>tail</p></article>"
    for part in ('<section class="share-capital">text</section>', '<section id="registration-form-history">text</section>', '<div class="legal">text</div>', '<p class="related">text</p>', "<math><mi>text</mi></math>", "<object>text</object>", "<header>text</header>"):
        assert alone(body.format(part)) == ["Shares", "text", "tail"], part
    for part in ('<div class="comments">c</div>', '<div class="share-buttons">s</div>', "<nav>n</nav>", '<div id="relatedAds">a</div>', "<textarea>t</textarea>", "<button>b</button>", '<div hidden>h</div>', '<ul role="navigation"><li>x</ul>'):
        assert alone(body.format(part)) == ["Shares", "tail"], part
    assert alone("<body><form action='/'><div><h1>H</h1><p>one two three</p><input name='x'></div></form></body>") == ["H", "one two three"]
    assert alone('<div class="newsletter-form"><p>Sign up</p></div><div class="content"><p>a much longer text of the article</p></div>') == ["a much longer text of the article"]
    assert alone('<p title="5" tall">first para</p><p a=\'x>y\' b>second') == ["first para", "second"]
    assert alone("<noscript>on</noscript><p>the text itself") == ["the text itself"] and alone("a < b and c<p>d") == ["a < b and c", "d"]
    assert alone("<nav>all of it</nav>") == []


def test_deep_page():
    """Time and memory grow with the page, not with its depth times its size."""
    n = 20_000
    nodes, blocks = page_text.parse("<div class='a'>x " * n)
    assert len(blocks) == n and len(page_text.features("<div>x " * n)) < 4 * n and len(page_text.pruned(nodes, blocks, {1: 0.0}, {}, 0.3)) == n


def test_pages_brute_force(spark):
    """The tree's importances by plain counting over all pairs of pages of a host, and with them the texts."""
    import math

    rows = [(1000 + i, f"http://site{i % 3}.org/p", PAGE.replace("{i}", str(i // (1 + i % 4)))) for i in range(30)] + [(1050, "http://site0.org/q", "<html><body><div class='zzz'>Same on all pages</div><p>new")]
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    hosts = {}
    for _, url, page in rows:
        if page and url and "://" in url:
            hosts.setdefault(url.split("/")[2].lower(), set()).add(page)
    trees = {}
    for host, pages in hosts.items():
        feats = [page_text.features(p) for p in pages]
        content, style = trees.setdefault(host, ({}, {}))
        for path in {f[0] for fs in feats for f in fs}:
            m = sum((path, 0, 2) in fs for fs in feats)
            if m >= 4:
                texts = [t for fs in feats for p, t, k in fs if p == path and k == 0]
                content[path] = sum(1 - math.log(sum((path, t, 0) in fs for fs in feats), m) for t in texts) / len(texts) if texts else 1.0
                kinds = [c for fs in feats for p, c, k in fs if p == path and k == 1]
                style[path] = sum(-math.log(kinds.count(c) / len(kinds), len(kinds)) for c in kinds) / len(kinds)
    want = {}
    for i, url, page in rows:
        tree = trees.get((url or "").split("/")[2].lower() if "://" in (url or "") else "", ({}, {}))
        want[i] = "\n".join(page_text.pruned(*page_text.parse(page), *tree, 0.3)) if page else ""
    got = {r.page_id: r.text for r in page_text.main_text(pages_frame(spark, rows)).collect()}
    assert got == want and "Same on all pages" not in "".join(got[1000 + i] for i in range(30)) and "Same" not in got[1050]
